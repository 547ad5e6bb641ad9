"""A user's settings, kept between sessions as a small table of names and values in a folder of the caller's."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings and their defaults.
DEFAULTS = {"COLOR_MAP": "RAINBOW", "MEMORY_MANAGER": "DYNAMIC"}


def load(spark: SparkSession, path: str) -> DataFrame:
    """name, value: what was stored last, the defaults elsewhere; a folder that isn't there yet holds nothing."""
    rows = spark.createDataFrame(list(DEFAULTS.items()), "name string, fallback string")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return rows.withColumnRenamed("fallback", "value")
    stored = spark.read.schema("name string, value string, version long").json(path)
    last = stored.groupBy("name").agg(F.max_by("value", "version").alias("value"))
    return rows.join(last, "name", "full").select("name", F.coalesce("value", "fallback").alias("value"))


def store(spark: SparkSession, path: str, values: dict[str, str], version: int) -> None:
    """Adds values; of several for a name, that of the highest version counts."""
    lines = spark.createDataFrame([(json.dumps({"name": k, "value": v, "version": version}),) for k, v in values.items()], "value string")
    lines.coalesce(1).write.mode("append").text(path)
