"""Values that hold until they change: regions, sizes and limits by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STRETCH = 4096


def carried(sparse: DataFrame, rounds: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each (keys, round) of ``rounds``: the value of the last round at or before it that has one (sparse: keys, round,
    value).  One shuffle by key and a running window, not a join by range."""
    both = rounds.select(*keys, "round", F.lit(None).cast(sparse.schema[value].dataType).alias(value), F.lit(1).alias("asked"))
    both = both.unionByName(sparse.select(*keys, "round", value, F.lit(0).alias("asked")))
    w = W.partitionBy(*keys).orderBy("round", "asked").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("asked = 1").select(*keys, "round", value)


def overridden(rows: DataFrame, own: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Parameters of a row's own key where given, the task's defaults elsewhere."""
    out = rows.join(own, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def round_pairs(frames: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """frames (frame_no) -> round_from, round_to of consecutive frames, within limits if given.  Frames are dealt by stretches
    of STRETCH numbers, each with the first of the next, so that ``lead`` needs no order over all of them."""
    f = frames.select("frame_no").distinct()
    f = f if first is None else f.where(F.col("frame_no") >= first)
    f = f if last is None else f.where(F.col("frame_no") <= last)
    part = F.floor(F.col("frame_no") / STRETCH)
    both = f.select("frame_no", F.explode(F.array_distinct(F.array(part, F.floor((F.col("frame_no") - 1) / STRETCH)))).alias("part"))
    nxt = both.withColumn("round_to", F.lead("frame_no").over(W.partitionBy("part").orderBy("frame_no")))
    return nxt.where((part == F.col("part")) & (F.col("round_to") == F.col("frame_no") + 1)).select(F.col("frame_no").alias("round_from"), "round_to")


def zipped(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """What belongs to the same region and patch, side by side."""
    return left.join(right, keys)


def edited(rows: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Edits replace what their key had; an edit without values leaves nulls."""
    return rows.join(edits, keys, "left_anti").unionByName(edits)
