"""Specifications of correlation kernels: five fields joined by semicolons, with ANY for all values of a field.

They say how a device would compute what a plan computes here; tasks name them, so they are read, written and expanded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("type", "input", "criterion", "limits", "weighted")
#: What the first three fields can be.
OPTIONS = {"type": ("CL1D", "CL2D", "CL15D", "JAVA"), "input": ("ARRAY", "IMAGE"), "criterion": ("ZNCC", "ZNSSD", "WZNSSD")}


def text(fields: tuple[str, ...] = tuple(OPTIONS)) -> Column:
    return F.concat_ws(";", *fields)


def parsed(spec: Column, fields: tuple[str, ...] = FIELDS) -> list[Column]:
    """The fields of a specification; null for those it lacks."""
    parts = F.split(spec, ";")
    return [F.get(parts, F.lit(k)).alias(name) for k, name in enumerate(fields)]


def expanded(specs: DataFrame, column: str) -> DataFrame:
    """A row for each kernel that a specification in ``column`` stands for, without those that don't exist."""
    out = specs
    for k, (name, values) in enumerate(OPTIONS.items()):
        asked = F.get(F.split(column, ";"), F.lit(k))
        out = out.withColumn(name, F.explode(F.when(asked == "ANY", F.array(*map(F.lit, values))).otherwise(F.array(asked))))
    return out.where(~((F.col("type") == "JAVA") & ((F.col("input") == "IMAGE") | (F.col("criterion") != "ZNCC"))))
