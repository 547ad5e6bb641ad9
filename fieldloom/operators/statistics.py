"""Histograms and summary statistics over correlation results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bad_ratio(results: DataFrame, keys: list[str], limit: float = 0.5) -> DataFrame:
    bad = F.col("quality").isNull() | (F.col("quality") < limit)
    return results.groupBy(*keys).agg(F.avg(F.when(bad, 1.0).otherwise(0.0)).alias("ratio"))


def deformation_usage(results: DataFrame, keys: list[str], min_quality: float) -> DataFrame:
    """How often each vector is the best, among good and bad results."""
    good = F.coalesce(F.col("quality") >= min_quality, F.lit(False))
    return results.groupBy(*keys, "deformation").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"), F.count(F.lit(1)).alias("n"))


def by_decile(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys, F.floor(F.col("quality") * 10).alias("decile"), "deformation").agg(F.count(F.lit(1)).alias("n"))


def fastest(times: DataFrame) -> DataFrame:
    """times (kernel, workload, ms) -> total time of the kernels with most samples, the least first."""
    sums = times.groupBy("kernel").agg(F.count(F.lit(1)).alias("samples"), F.sum("ms").alias("total_ms"))
    return sums.join(sums.agg(F.max("samples").alias("samples")), "samples").orderBy("total_ms", "kernel")


def combined_shift(left, right):
    """A pair of jaws moves by the smaller shift if either is negative, else by the larger."""
    return F.when((left < 0) | (right < 0), F.least(left, right)).otherwise(F.greatest(left, right))


def report(results: DataFrame, field: DataFrame, switches: list[str], min_quality: float) -> DataFrame:
    """statistic, key, n of all switched-on statistics: results (deformation, quality), field (round, q)."""
    n = F.count(F.lit(1)).alias("n")
    known = {
        "DEF_USAGE": results.groupBy(F.col("deformation").alias("key")).agg(n),
        "DEF_QUALITY": results.groupBy(F.floor(F.col("quality") * 10).cast("string").alias("key")).agg(n),
        "POINT_QUALITY": field.where(F.col("q") >= min_quality).groupBy(F.col("round").cast("string").alias("key")).agg(n),
    }
    parts = [known[name].select(F.lit(name).alias("statistic"), "key", "n") for name in switches]
    return reduce(DataFrame.unionByName, parts)
