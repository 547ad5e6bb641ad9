"""Patches in batches: all at once, so many at a time, or as many as fit some memory."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def patch_bytes(half: Column, candidates: Column) -> Column:
    """What a patch takes: its pixels' places and levels, and a value for each candidate."""
    side = half * 2 + 1
    return side * side * 12 + candidates * 4


def numbered(patches: DataFrame, keys: list[str], order: str, count: int | None = None, limit: int | None = None, size: Column | None = None) -> DataFrame:
    """patches with batch: by ``count`` patches, or by ``limit`` bytes (``size`` of each), counted anew for each of ``keys``;
    neither: one batch.  A patch that is larger than the limit is a batch by itself."""
    if count is None and limit is None:
        return patches.withColumn("batch", F.lit(0).cast("long"))
    w = W.partitionBy(*keys).orderBy(order)
    if count is not None:
        return patches.withColumn("batch", F.floor((F.row_number().over(w) - 1) / count))
    return patches.withColumn("batch", F.floor((F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)) - size) / limit))


def each(patches: DataFrame) -> Iterator[DataFrame]:
    """The batches one after another; their numbers come to the driver."""
    for (k,) in sorted(patches.select("batch").distinct().collect()):
        yield patches.where(F.col("batch") == k).drop("batch")
