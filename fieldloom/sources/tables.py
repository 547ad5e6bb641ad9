"""Frames, votes and fields as views of ordinary tables.

A frame is the long table ``pixels(x, y, g)`` with integer grey levels, so that moment sums are exact.  Where no images are
at hand, ``embeddings`` read as a raster (element index across, vec_id down) serve as frames and ``events`` as votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def half_up(c: Column) -> Column:
    """floor(x + 0.5): rounding that is the same for negative halves on every engine."""
    return F.floor(c + 0.5)


def frame_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    pix = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return pix.select(F.col("x").cast("long").alias("x"), "y", F.floor((F.col("e").cast("double") + 0.6) * 200).alias("g"))


def frame_b(spark: SparkSession, sf_dir: str, u: int = 2, v: int = -1) -> DataFrame:
    """The first frame moved by whole pixels: the ground truth of the solvers."""
    return frame_a(spark, sf_dir).select((F.col("x") + u).alias("x"), (F.col("y") + v).alias("y"), "g")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round, x, y, dx, dy, q: one vote an event, in binary fractions so that sums are exact."""
    e = table(spark, sf_dir, "events")
    return e.select(
        ((F.dayofmonth("ts") - 1) % 6).cast("long").alias("round"), (F.col("user_id") % 12).alias("x"), F.hour("ts").cast("long").alias("y"),
        ((F.floor(F.col("value") * 4) % 17 - 8) / 4.0).alias("dx"), ((F.col("event_id") % 13 - 6) / 4.0).alias("dy"), ((F.col("event_id") % 4 + 1) / 4.0).alias("q"),
    )


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round, x, y, dx, dy, q: the mean vote of each cell."""
    return votes(spark, sf_dir).groupBy("round", "x", "y").agg(F.avg("dx").alias("dx"), F.avg("dy").alias("dy"), F.avg("q").alias("q"))


def rois_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """roi_id, kind, x1, y1, x2, y2, cx, cy, r: a rectangle or a circle a supplier, here and there on the first frame."""
    k = F.col("s_suppkey")
    rect, none = k % 2 == 0, F.lit(None).cast("double")
    some = lambda c, c2: F.when(rect, c.cast("double")).otherwise(c2.cast("double"))
    x, y, w, h = k % 40, (k * 37) % 400, 8 + k % 17, 8 + (k * 3) % 29
    return table(spark, sf_dir, "supplier").select(
        k.cast("long").alias("roi_id"), F.when(rect, "rect").otherwise("circle").alias("kind"), some(x, none).alias("x1"), some(y, none).alias("y1"), some(x + w, none).alias("x2"), some(y + h, none).alias("y2"),
        some(none, x + 10).alias("cx"), some(none, y + 10).alias("cy"), some(none, 5 + k % 7).alias("r"),
    )


#: The same views in SQL, for oracles.
SQL = {
    "a": "a AS (SELECT i AS x, vec_id AS y, floor((embedding[i + 1]::DOUBLE + 0.6) * 200)::BIGINT AS g FROM (SELECT vec_id, embedding, unnest(generate_series(0, len(embedding) - 1)) AS i FROM embeddings))",
    "b": "b AS (SELECT x + 2 AS x, y - 1 AS y, g FROM a)",
    "votes": "votes AS (SELECT (day(ts) - 1) % 6 AS round, user_id % 12 AS x, hour(ts) AS y, (floor(value * 4)::BIGINT % 17 - 8) / 4.0::DOUBLE AS dx, (event_id % 13 - 6) / 4.0::DOUBLE AS dy, (event_id % 4 + 1) / 4.0::DOUBLE AS q FROM events)",
    "regions": "regions AS (SELECT s_suppkey AS roi_id, CASE WHEN k = 0 THEN 'rect' ELSE 'circle' END AS kind, CASE WHEN k = 0 THEN x END::DOUBLE AS x1, CASE WHEN k = 0 THEN y END::DOUBLE AS y1, CASE WHEN k = 0 THEN x + w END::DOUBLE AS x2, CASE WHEN k = 0 THEN y + h END::DOUBLE AS y2, CASE WHEN k = 1 THEN x + 10 END::DOUBLE AS cx, CASE WHEN k = 1 THEN y + 10 END::DOUBLE AS cy, CASE WHEN k = 1 THEN 5 + s_suppkey % 7 END::DOUBLE AS r FROM (SELECT s_suppkey, s_suppkey % 2 AS k, s_suppkey % 40 AS x, (s_suppkey * 37) % 400 AS y, 8 + s_suppkey % 17 AS w, 8 + (s_suppkey * 3) % 29 AS h FROM supplier))",
    "field": "field AS (SELECT round, x, y, avg(dx) AS dx, avg(dy) AS dy, avg(q) AS q FROM votes GROUP BY round, x, y)",
}


def with_sql(names: str, body: str) -> str:
    """``body`` after the named views, materialised so that DuckDB evaluates each once."""
    return "WITH " + ",\n".join(SQL[n].replace(" AS (", " AS MATERIALIZED (", 1) for n in names.split()) + "\n" + body
