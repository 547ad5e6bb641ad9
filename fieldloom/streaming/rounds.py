"""Votes as they arrive: displacement of each cell and time window, without waiting for the sequence to end.

Weighted sums are partial aggregates that Spark keeps as state; a watermark lets it drop windows that are over.  The batch
operator's modal vote needs all votes of a cell at once, so the stream gives the quality-weighted mean of all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vote_stream(spark: SparkSession, folder: str, schema: str = "ts timestamp, x long, y long, dx double, dy double, q double", files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def windowed_field(votes: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """votes (ts, x, y, dx, dy, q) -> start, x, y, dx, dy, quality, votes.  Works on streams and on batches."""
    sums = votes.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "x", "y").agg(
        F.sum(F.col("dx") * F.col("q")).alias("sx"), F.sum(F.col("dy") * F.col("q")).alias("sy"), F.sum("q").alias("s"), F.sum(F.col("q") * F.col("q")).alias("ss"), F.count(F.lit(1)).alias("votes")
    )
    s = F.nullif("s", F.lit(0.0))
    return sums.select(F.col("w.start").alias("start"), "x", "y", (F.col("sx") / s).alias("dx"), (F.col("sy") / s).alias("dy"), ((F.col("ss") / s + 1) / 2 * 100).alias("quality"), "votes")
