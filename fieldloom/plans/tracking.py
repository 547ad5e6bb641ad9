"""Tracked fixtures: four circular jaws that move with the specimen, followed frame by frame.

The state between rounds is four circles and a rectangle; it lives on the driver, each round is one small plan."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import deformation
from ..operators import fields, mesh
from ..shared import kept
from . import solvers, tasks
from .session import Cause, ComputationError

GAP, GOOD, MAX_BAD, TRIES, MOVED, MISMATCH = 5.0, 0.5, 0.5, 10, 0.5, 3.0


def valid(circles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, valid: whether there are exactly four circles."""
    return circles.groupBy(*keys).agg((F.count(F.lit(1)) == 4).alias("valid"))


def sorted_jaws(circles: DataFrame, keys: list[str]) -> DataFrame:
    """circles (keys, roi_id, cx, cy, r) with place 1..: the upper row by x, then the lower; a row is what overlaps vertically
    with nothing wholly above it."""
    from pyspark.sql import Window as W

    above = circles.select(*keys, F.col("roi_id").alias("o"), (F.col("cy") + F.col("r")).alias("bottom"), F.col("cy").alias("ocy"))
    pairs = circles.crossJoin(above) if not keys else circles.join(above, keys)  # four by four of each key
    low = pairs.where((F.col("o") != F.col("roi_id")) & (F.col("ocy") < F.col("cy")) & (F.col("bottom") < F.col("cy") - F.col("r"))).select(*keys, "roi_id").distinct().withColumn("low", F.lit(True))
    rows = circles.join(low, [*keys, "roi_id"], "left").withColumn("low", F.coalesce("low", F.lit(False)))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("low", "cx")).cast("long"))


def default_rectangle(circles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x1, x2, y1, y2: the specimen between the jaws, GAP off them, from the top of the upper to the bottom of the lower."""
    c = sorted_jaws(circles, keys)
    left, low = F.col("place") % 2 == 1, F.col("place") > 2
    least = lambda where, value: F.min(F.when(where, value))
    cx, cy, r = F.col("cx"), F.col("cy"), F.col("r")
    return c.groupBy(*keys).agg((least(left, cx + r) + GAP).alias("x1"), (least(~left, cx - r) - GAP).alias("x2"), least(~low, cy - r).alias("y1"), least(low, cy + r).alias("y2"))


def widened(limits: Column) -> Column:
    """Limits with a quarter of the candidates more on both sides of each axis."""
    counts = deformation.axis_counts(limits)
    parts = F.transform(F.arrays_zip(counts.alias("n"), F.sequence(F.lit(0), F.size(counts) - 1).alias("k")), lambda a: F.array(
        F.get(limits, a["k"] * 3) - F.floor(a["n"] / 4) * F.get(limits, a["k"] * 3 + 2), F.get(limits, a["k"] * 3 + 1) + F.floor(a["n"] / 4) * F.get(limits, a["k"] * 3 + 2), F.get(limits, a["k"] * 3 + 2)))
    return F.flatten(parts)


def _shift(circles: list[tuple], moves: dict[int, float], lower: bool) -> tuple[float, float, float]:
    """Shift of the lower or upper pair: the lesser if either is negative, else the greater; and those of both circles."""
    order = sorted(circles, key=lambda c: c[2])
    left, right = (moves.get(c[0], 0.0) for c in sorted(order[2:] if lower else order[:2], key=lambda c: c[1]))
    return (min(left, right) if min(left, right) < 0 else max(left, right)), left, right


@dataclass
class Round:
    number: int
    circles: list[tuple[int, float, float, float]]  # where they are after it
    moves: dict[int, float]
    bottom: float
    top: float
    bad_ratio: float
    moved: bool


def rounds(frames: list[DataFrame], jaws: list[tuple[int, float, float, float]], reach: int = 2) -> Iterator[Round]:
    """Follows four circles (roi_id, cx, cy, r) from frame to frame: each moves by its own best whole-pixel shift, looked for
    ever wider while too many have none of good quality.  The lower two may not differ by more than MISMATCH pixels."""
    if len(jaws) != 4:
        raise ComputationError(Cause.NOT_ENOUGH_ROIS, "four circles are needed")
    spark, circles = frames[0].sparkSession, list(jaws)
    for k in range(len(frames) - 1):
        rows = [(i, cx, cy, max(1, int((r * math.sqrt(2) - 1) / 2))) for i, cx, cy, r in circles]
        subsets = spark.createDataFrame(rows, "subset_id int, cx double, cy double, s int")
        wide = reach
        for _ in range(TRIES):
            best = solvers.brute_force(subsets, solvers.integer_candidates(spark, -wide, wide), frames[k], frames[k + 1], ["subset_id"])
            found = best.select("subset_id", "v", "quality").collect()  # one row a jaw
            ratio = (sum(r.quality is None or r.quality < GOOD for r in found) + len(circles) - len(found)) / len(circles)
            if ratio < MAX_BAD:
                break
            wide += max(1, (2 * wide + 1) // 4)
        moves = {r.subset_id: float(r.v) for r in found if r.quality is not None and r.quality >= GOOD}
        bottom, left, right = _shift(circles, moves, True)
        top, _, _ = _shift(circles, moves, False)
        if abs(left - right) > MISMATCH:
            raise ComputationError(Cause.FIXTURES_SHIFT_MISMATCH, f"lower jaws moved by {left} and {right}")
        circles = [(i, cx, cy + moves.get(i, 0.0), r) for i, cx, cy, r in circles]
        yield Round(k, circles, moves, bottom, top, ratio, abs(left) > MOVED or abs(right) > MOVED)


def track(frames: list[DataFrame], jaws: list[tuple[int, float, float, float]], reach: int = 2) -> DataFrame:
    """frames of pixels, jaws (roi_id, cx, cy, r) -> round, roi_id, cx, cy, shift, bottom_shift, ratio of each round."""
    out = [(r.number, i, cx, cy, r.moves.get(i, 0.0), r.bottom, r.bad_ratio, r.moved) for r in rounds(frames, jaws, reach) for i, cx, cy, _ in r.circles]
    return frames[0].sparkSession.createDataFrame(out, "round int, roi_id int, cx double, cy double, shift double, bottom_shift double, bad_ratio double, moved boolean")


def specimen(frames: list[DataFrame], jaws: list[tuple[int, float, float, float]], rect: tuple[float, float, float, float] | None = None, reach: int = 2, spacing: int = 5, half: int = 5, min_quality: float = 0.25, strain_mm: float = 20.0, ratio: float = 1.0) -> DataFrame:
    """The field of the rectangle between the jaws (x1, y1, x2, y2; by default where they leave it), as tasks.compute gives it.

    A round in which the lower jaws moved is solved with their shift as the largest one downwards, and the rectangle is then
    stretched by the shifts of its ends; in other rounds its displacement is nothing, without a quality."""
    spark = frames[0].sparkSession
    if rect is None:
        start = spark.createDataFrame(jaws, "roi_id int, cx double, cy double, r double")
        rect = tuple(default_rectangle(start, []).select("x1", "y1", "x2", "y2").first())
    size = frames[0].agg(F.max("x") + 1, F.max("y") + 1).first()
    steps = []
    for r in rounds(frames, jaws, reach):
        x1, y1, x2, y2 = rect
        none = F.lit(None).cast("double")
        roi = spark.createDataFrame([(1, "rect", x1, y1, x2, y2, half)], "roi_id int, kind string, x1 double, y1 double, x2 double, y2 double, s int").withColumns({"cx": none, "cy": none, "r": none})
        if r.moved:
            subsets = mesh.equal(roi, spacing, int(size[0]), int(size[1])).select("subset_id", "cx", "cy", "s")
            low, high = min(-reach, math.floor(r.bottom)), math.floor(r.bottom)
            best = solvers.brute_force(subsets, solvers.integer_candidates(spark, -reach, reach, low, high), frames[r.number], frames[r.number + 1], ["subset_id"])
            results = best.join(subsets, "subset_id").withColumn("deformation", F.array(F.col("u").cast("double"), F.col("v").cast("double")))
            votes = fields.patch_votes(results, min_quality, 0).select("x", "y", "dx", "dy", F.col("quality").alias("q"))
            field = fields.displacement(votes, ["x", "y"])
        else:
            inside = F.col("x").between(math.ceil(x1), math.floor(x2)) & F.col("y").between(math.ceil(y1), math.floor(y2))
            field = frames[r.number].where(inside).select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), none.alias("quality"))
        steps.append((r.number, r.number + 1, kept(field, "specimen")))
        rect = (x1, y1 + r.top, x2, y2 + r.bottom)
    single = [f.select(F.lit(a).cast("long").alias("round_from"), F.lit(b).cast("long").alias("round_to"), "x", "y", "dx", "dy", "quality") for a, b, f in steps]
    return tasks.with_strain(fields.union([*single, *tasks.cumulative(steps)]), strain_mm, ratio)
