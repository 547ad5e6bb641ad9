"""Intensities between pixels, and the pre-filter.

Positions and pixels are dealt to square tiles, pixels near a border to each tile whose positions may ask for them, and a
tile's positions are sampled together.  Positions whose neighbours with weight aren't all inside the frame have no sample."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Pixels along a side of a tile.
TILE = 256


def cubic_weights(t: np.ndarray) -> list[np.ndarray]:
    """Weights of the four neighbours of a Catmull-Rom segment at fraction t."""
    return [
        ((t * -0.5 + 1.0) * t - 0.5) * t,
        ((t * 1.5 - 2.5) * t) * t + 1.0,
        ((t * -1.5 + 2.0) * t + 0.5) * t,
        ((t * 0.5 - 0.5) * t) * t,
    ]


def linear_weights(t: np.ndarray) -> list[np.ndarray]:
    return [1.0 - t, t]


def sample(points: DataFrame, pixels: DataFrame, weights: Callable[[np.ndarray], list[np.ndarray]], first: int, taps: int, keys: list[str]) -> DataFrame:
    """points (keys, px, py), pixels (x, y, g) -> keys, px, py, s.  ``first``: offset of the first of ``taps`` neighbours."""
    after = first + taps - 1
    fx, fy = F.floor("px"), F.floor("py")
    asked = points.select(*keys, F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"), F.floor(fx / TILE).alias("tx_"), F.floor(fy / TILE).alias("ty_"))
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - after) / TILE), F.floor((F.col(c) - first) / TILE)))
    cells = pixels.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("g").cast("double").alias("g")).withColumn("tx_", span("x")).withColumn("ty_", span("y"))
    names = [*keys, "px", "py"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.select(*names).schema) + ", s double"
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def run(mine: pa.Table, held: pa.Table) -> pa.Table:
        if not mine.num_rows or not held.num_rows:
            return empty
        x0, y0 = (mine.column(c)[0].as_py() * TILE + first for c in ("tx_", "ty_"))
        grid = np.full((TILE + taps, TILE + taps), np.nan)
        grid[held.column("x").to_numpy() - x0, held.column("y").to_numpy() - y0] = held.column("g").to_numpy()
        px, py = (mine.column(c).to_numpy() for c in ("px", "py"))
        ix, iy = np.floor(px).astype(np.int64), np.floor(py).astype(np.int64)
        total = np.zeros(len(px))
        for i, a in enumerate(weights(px - ix)):
            for j, b in enumerate(weights(py - iy)):
                w = a * b
                total += np.where(w != 0, w * grid[ix + first + i - x0, iy + first + j - y0], 0.0)  # a tap without weight needs no pixel
        whole = np.flatnonzero(~np.isnan(total))
        own = mine.select(names).take(pa.array(whole))
        return pa.Table.from_arrays([*(own.column(c).combine_chunks() for c in names), pa.array(total[whole])], names=[*names, "s"])

    return asked.groupBy("tx_", "ty_").cogroup(cells.groupBy("tx_", "ty_")).applyInArrow(run, schema)


def bilinear(points: DataFrame, pixels: DataFrame, keys: list[str]) -> DataFrame:
    return sample(points, pixels, linear_weights, 0, 2, keys)


def bicubic(points: DataFrame, pixels: DataFrame, keys: list[str]) -> DataFrame:
    return sample(points, pixels, cubic_weights, -1, 4, keys)


def gauss_kernel(size: int) -> list[float]:
    """Normalised weights of an odd kernel whose width follows from its size; an even size is made odd, none below 1."""
    if size <= 0:
        return [1.0]
    size += 1 - size % 2
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [w / sum(raw) for w in raw]


def blur(pixels: DataFrame, size: int, keys: list[str] | None = None) -> DataFrame:
    """Separable Gaussian blur of a dense frame (keys, x, y, g), borders reflected without the edge.

    Each pass gathers one line of the frame as an array (bounded by the frame's width or height) and sums its taps."""
    kernel, keys = gauss_kernel(size), keys or []

    def one(df: DataFrame, along: str, across: str) -> DataFrame:
        line = F.transform(F.sort_array(F.collect_list(F.struct(F.col(along).alias("p"), F.col("g").cast("double").alias("g")))), lambda e: e["g"])
        lines = df.groupBy(*keys, across).agg(line.alias("line"), F.min(along).cast("long").alias("start"))
        n = F.size("line")
        reach = len(kernel) // 2

        def at(i: Column, t: int) -> Column:
            p = F.abs(i + t)
            return F.get("line", F.when(n == 1, F.lit(0)).otherwise(F.when(p >= n, 2 * (n - 1) - p).otherwise(p)))

        summed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: sum((at(i, t - reach) * w for t, w in enumerate(kernel)), F.lit(0.0)))
        return lines.select(*keys, across, "start", F.posexplode(summed).alias(along, "g")).withColumn(along, F.col(along) + F.col("start")).drop("start")

    return one(one(pixels, "x", "y"), "y", "x").select(*keys, "x", "y", "g")
