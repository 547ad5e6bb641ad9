"""Whole tasks: all rounds of a sequence in one plan, as rounds don't depend on each other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sampling
from ..operators import correlate, fields, lookups
from ..shared import kept
from . import solvers

RESULT = ("round_from", "round_to", "x", "y", "dx", "dy", "quality")


def _solved(subsets: DataFrame, first: DataFrame, second: DataFrame, rounds: list[int], solver: str, order: int, reach: int) -> DataFrame:
    """round, subset_id, deformation, quality of each patch (round, subset_id, cx, cy, s)."""
    keys, spark = ["round", "subset_id"], subsets.sparkSession
    vector = F.array(F.col("u").cast("double"), F.col("v").cast("double")).alias("deformation")
    if solver == "BRUTE_FORCE":
        return correlate.best_moves(subsets, solvers.integer_candidates(spark, -reach, reach), first, second, keys, ["round"]).select(*keys, vector, "quality")
    if solver == "COARSE_FINE":
        one = lambda df, r: df.where(F.col("round") == r)
        parts = [solvers.coarse_fine(one(subsets, r), one(first, r).drop("round"), one(second, r).drop("round"), keys, -reach, reach) for r in rounds]
        return fields.union(parts).select(*keys, vector, "quality")
    windows = correlate.windows(subsets, first, second, keys, reach + 2, ["round"])
    return solvers.solve_patches(windows, keys, solver, order, reach + 2, reach).select(*keys, "deformation", "quality")


def with_strain(field: DataFrame, strain_mm: float, ratio: float) -> DataFrame:
    keys = ["round_from", "round_to"]
    return field.join(fields.strain(field, keys, strain_mm, ratio), [*keys, "x", "y"])


def cumulative(steps: list[tuple[int, int, DataFrame]]) -> list[DataFrame]:
    """From (round_from, round_to, field) of consecutive rounds: the fields since the first of them, from the second on."""
    out = []
    for k, walked in enumerate(fields.compositions(f.select("x", "y", "dx", "dy", "quality") for _, _, f in steps)):
        if k:
            out.append(walked.select(F.lit(steps[0][0]).cast("long").alias("round_from"), F.lit(steps[k][1]).cast("long").alias("round_to"), "x", "y", "dx", "dy", "quality"))
    return out


def compute(frames: DataFrame, subsets: DataFrame, reach: int, min_quality: float = 0.25, strain_mm: float = 20.0, ratio: float = 1.0, solver: str = "BRUTE_FORCE", order: int = 0, filter_size: int = 0, listener: Callable[[str], None] | None = None) -> DataFrame:
    """frames (frame_no, x, y, g), subsets (subset_id, cx, cy, s; with ``round`` if they differ by round) -> RESULT and the
    strain of every pair of consecutive frames, and, from the second on, of the first frame with each later one.

    The mesh is the caller's (see generators); solver: a key of solvers.SOLVERS; filter_size: blur before, 0 for none."""
    if solver not in solvers.SOLVERS:
        raise ValueError(f"unknown solver {solver}")
    tell = listener or (lambda _: None)
    if filter_size:
        frames = sampling.blur(frames, filter_size, ["frame_no"])
    pairs = lookups.round_pairs(frames.select("frame_no"))
    rounds = sorted(r.round_from for r in pairs.collect())  # a number a frame
    if not rounds:
        raise ValueError("no two consecutive frames")
    numbers = pairs.select(F.col("round_from").alias("round"))
    first = frames.select(F.col("frame_no").alias("round"), "x", "y", "g").join(F.broadcast(numbers), "round", "left_semi")
    second = frames.select((F.col("frame_no") - 1).alias("round"), "x", "y", "g").join(F.broadcast(numbers), "round", "left_semi")
    own = subsets if "round" in subsets.columns else subsets.crossJoin(F.broadcast(numbers))  # every patch in every round
    own = own.select(F.col("round").cast("long").alias("round"), "subset_id", "cx", "cy", "s")
    tell("solving")
    solved = _solved(own, first.withColumn("round", F.col("round").cast("long")), second.withColumn("round", F.col("round").cast("long")), rounds, solver, order, reach)
    results = solved.join(own, ["round", "subset_id"])
    votes = fields.patch_votes(results, min_quality, order).select("round", "x", "y", "dx", "dy", F.col("quality").alias("q"))
    found = kept(fields.displacement(votes, ["round", "x", "y"]), "task-field")
    tell("composing")
    steps = [(r, r + 1, found.where(F.col("round") == r)) for r in rounds]
    single = found.select(F.col("round").alias("round_from"), (F.col("round") + 1).alias("round_to"), "x", "y", "dx", "dy", "quality")
    tell("strain")
    return with_strain(fields.union([single, *cumulative(steps)]), strain_mm, ratio)
