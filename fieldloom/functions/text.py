"""Texts in a user's language: patterns by language and key, with {0}, {1} .. for arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(pattern: Column, arguments: list[Column]) -> Column:
    """The pattern with its {k} replaced; those without an argument stay."""
    for k, value in enumerate(arguments):
        pattern = F.replace(pattern, F.lit("{%d}" % k), F.coalesce(value.cast("string"), F.lit("")))
    return pattern


def localized(rows: DataFrame, bundle: DataFrame, key: str, language: str, arguments: list[Column], default: str = "en") -> DataFrame:
    """rows with text: the bundle's (language, key, pattern) in the row's language, else in the default one, else the key."""
    own = bundle.select(F.col("language").alias(language), F.col("key").alias(key), F.col("pattern").alias("own_"))
    other = bundle.where(F.col("language") == default).select(F.col("key").alias(key), F.col("pattern").alias("other_"))
    both = rows.join(own, [language, key], "left").join(other, key, "left")
    return both.withColumn("text", filled(F.coalesce("own_", "other_", key), arguments)).drop("own_", "other_")
