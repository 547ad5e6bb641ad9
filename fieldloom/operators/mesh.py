"""Meshes of square patches and tables of candidate deformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import deformation, regions, seeded


def axis_count(width: Column, half: Column, spacing: Column) -> Column:
    """Centres along one side of a region: none if a patch doesn't fit, one if less than a spacing is left."""
    room = width - half * 2
    return F.when(room <= 0, 0).when(room < spacing, 1).otherwise(F.floor(room / spacing)).cast("int")


def equal(rois: DataFrame, spacing: int, width: int, height: int | Column) -> DataFrame:
    """rois (roi_id, kind, x1, y1, x2, y2, cx, cy, r, s) -> roi_id, subset_id, cx, cy, s: a grid of patches that lie in the
    frame and in the region, numbered row by row."""
    if spacing <= 0:
        raise ValueError("spacing must be positive")
    circle = F.col("kind") == "circle"
    bx, by = F.when(circle, F.col("cx") - F.col("r")).otherwise(F.col("x1")), F.when(circle, F.col("cy") - F.col("r")).otherwise(F.col("y1"))
    w = F.when(circle, F.col("r") * 2).otherwise(F.col("x2") - F.col("x1") + 1)
    h = F.when(circle, F.col("r") * 2).otherwise(F.col("y2") - F.col("y1") + 1)
    base = rois.select("*", bx.alias("bx"), by.alias("by"), axis_count(w, F.col("s"), F.lit(spacing)).alias("nx"), axis_count(h, F.col("s"), F.lit(spacing)).alias("ny")).where("nx > 0 and ny > 0")
    grid = base.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    at = grid.withColumn("px", F.col("bx") + F.col("s") + F.col("i") * spacing).withColumn("py", F.col("by") + F.col("s") + F.col("j") * spacing)
    x1, y1, x2, y2 = F.col("px") - F.col("s"), F.col("py") - F.col("s"), F.col("px") + F.col("s"), F.col("py") + F.col("s")
    inside = F.when(circle, regions.circle_area(x1, y1, x2, y2, F.col("cx"), F.col("cy"), F.col("r"))).otherwise(regions.rect_area(x1, y1, x2, y2, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    kept = at.where((x1 >= 0) & (y1 >= 0) & (x2 < width) & (y2 < height) & inside)
    # the grid's own number, not a rank: no window over all patches
    return kept.select("roi_id", (F.col("j").cast("long") * F.col("nx") + F.col("i")).alias("subset_id"), F.col("px").cast("double").alias("cx"), F.col("py").cast("double").alias("cy"), F.col("s"))


def random(rois: DataFrame, count: int, width: int, height: int | Column, seed: int = 7, attempts: int = 20, attempt: bool = False) -> DataFrame:
    """Up to ``count`` patches a region at seeded random centres, at most as many as there are centres."""
    tried = rois.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(count * attempts - 1))))
    u, v = (seeded.unit([F.col("roi_id"), F.col("a")], seed + k) for k in (0, 1))
    high = height if isinstance(height, Column) else F.lit(height)
    px, py = F.floor(F.col("x1") + u * (F.col("x2") - F.col("x1") + 1)), F.floor(F.col("y1") + v * (F.col("y2") - F.col("y1") + 1))
    at = tried.select("roi_id", "a", "s", "x1", "y1", "x2", "y2", (high - 1).alias("last"), px.alias("cx"), py.alias("cy"))
    s = F.col("s")
    ok = at.where((F.col("cx") - s >= F.greatest(F.lit(0), "x1")) & (F.col("cy") - s >= F.greatest(F.lit(0), "y1")) & (F.col("cx") + s <= F.least(F.lit(width - 1), "x2")) & (F.col("cy") + s <= F.least("last", "y2")))
    first = ok.groupBy("roi_id", "s", "cx", "cy").agg(F.min("a").alias("a"))
    picked = first.groupBy("roi_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("a", "cx", "cy", "s"))), 1, count).alias("p"))  # at most all attempts
    out = picked.select("roi_id", F.posexplode("p").alias("subset_id", "p")).select("roi_id", "subset_id", F.col("p.cx").cast("double").alias("cx"), F.col("p.cy").cast("double").alias("cy"), "p.s", F.col("p.a").alias("attempt"))
    return out if attempt else out.drop("attempt")


def patch_pixels(subsets: DataFrame) -> DataFrame:
    """Every pixel of every patch, around its rounded centre, column by column."""
    span = F.sequence(-F.col("s"), F.col("s"))
    out = subsets.withColumn("ox", F.explode(span)).withColumn("oy", F.explode(span))
    return out.withColumn("x", F.floor(F.col("cx") + 0.5) + F.col("ox")).withColumn("y", F.floor(F.col("cy") + 0.5) + F.col("oy"))


def candidates(limits: DataFrame, total: str | None = None) -> DataFrame:
    """limits (.., limits ARRAY) -> .., cand_id, deformation: all combinations, the first axis fastest; with their number in
    a column ``total``, if it is named."""
    out = limits.withColumn("counts", deformation.axis_counts(F.col("limits")))
    out = out.withColumn(total, deformation.total(F.col("counts"))) if total else out
    out = out.withColumn("cand_id", F.explode(F.sequence(F.lit(0).cast("long"), deformation.total(F.col("counts")) - 1)))
    return out.withColumn("deformation", deformation.decode(F.col("cand_id"), F.col("limits"), F.col("counts"))).drop("counts", "limits")


def stencil(coefficients: int, kind: str) -> list[list[tuple[int, int]]]:
    """Probes of a finite-difference stencil as (axis, sign) steps.  central: 1 + 2c + 4c^2, forward: 1 + c + c(c+1)/2."""
    axes = range(coefficients)
    if kind == "central":
        pairs = [[(a, s), (b, t)] for s, t in ((1, 1), (-1, -1), (1, -1), (-1, 1)) for a in axes for b in axes]
        return [[], *[[(a, 1)] for a in axes], *[[(a, -1)] for a in axes], *pairs]
    if kind == "forward":
        return [[], *[[(a, 1)] for a in axes], *[[(a, 1), (b, 1)] for a in axes for b in axes if b >= a]]
    raise ValueError(kind)


def stencil_table(points: DataFrame, kind: str, coefficients: int, step: float) -> DataFrame:
    """points (.., deformation) -> .., probe, deformation moved by the stencil's steps."""
    probes = []
    for steps in stencil(coefficients, kind):
        shift = [0.0] * coefficients
        for axis, sign in steps:
            shift[axis] += sign * step
        probes.append(F.zip_with("deformation", F.array(*[F.lit(x) for x in shift]), lambda v, d: v + d))
    return points.select(*[c for c in points.columns if c != "deformation"], F.posexplode(F.array(*probes)).alias("probe", "deformation"))


def spgd_stencil(points: DataFrame, keys: list[str], coefficients: int, amplitude: list[float], seed: int = 11) -> DataFrame:
    """points (keys, deformation) -> keys, probe, deformation: itself, and both sides of one seeded random direction."""
    p = [(seeded.unit([*map(F.col, keys), F.lit(k)], seed) * 2 - 1) * amplitude[k] for k in range(coefficients)]
    probes = [F.array(*[F.get("deformation", F.lit(k)) + sign * p[k] for k in range(coefficients)]) for sign in (0.0, -1.0, 1.0)]
    return points.select(*keys, F.posexplode(F.array(*probes)).alias("probe", "deformation"))
