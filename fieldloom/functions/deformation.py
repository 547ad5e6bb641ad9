"""Deformation vectors and limits as array columns; shape functions as column arithmetic.

A vector has 2, 6 or 12 coefficients in the order U, V, UX, UY, VX, VY, UXX, UYY, UXY, VXX, VYY, VXY (order 0, 1, 2);
limits have three numbers (least, largest, step) for each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths of vectors and limits for each order.
VALUES, LIMITS = (2, 6, 12), (6, 18, 36)


def axis_counts(limits: Column) -> Column:
    """Candidates along each axis: round((hi - lo) / step) + 1, one where the step is zero."""
    return F.transform(
        F.sequence(F.lit(0), F.floor(F.size(limits) / 3).cast("int") - 1),
        lambda k: F.when(F.get(limits, k * 3 + 2) == 0, F.lit(1).cast("long")).otherwise(
            F.floor((F.get(limits, k * 3 + 1) - F.get(limits, k * 3)) / F.nullif(F.get(limits, k * 3 + 2), F.lit(0.0)) + 0.5) + 1
        ),
    )


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(1).cast("long"), lambda a, n: a * n)


def decode(index: Column, limits: Column, counts: Column) -> Column:
    """The vector of a candidate's index, mixed radix with the first axis fastest; a negative index is an error."""
    state = F.struct(index.cast("long").alias("left"), F.expr("cast(array() as array<double>)").alias("v"))
    walked = F.aggregate(
        F.arrays_zip(counts.alias("n"), F.sequence(F.lit(0), F.size(counts) - 1).alias("k")),
        state,
        lambda s, c: F.struct(
            F.floor(s["left"] / c["n"]).alias("left"),
            F.concat(s["v"], F.array(F.get(limits, c["k"] * 3) + F.pmod(s["left"], c["n"]) * F.get(limits, c["k"] * 3 + 2))).alias("v"),
        ),
    )
    return F.when(index < 0, F.raise_error(F.lit("negative deformation index"))).otherwise(walked["v"])


def slice_at(packed: Column, index: Column, width: int) -> Column:
    return F.slice(packed, index.cast("int") * width + 1, F.lit(width))


def order(array: Column, lengths: tuple[int, int, int], lenient: bool = False) -> Column:
    """0, 1 or 2 by the array's length; another length is an error (or null, if lenient)."""
    out = F.when(F.size(array) == lengths[0], 0).when(F.size(array) == lengths[1], 1).when(F.size(array) == lengths[2], 2)
    return out if lenient else F.coalesce(out, F.raise_error(F.concat(F.lit("illegal length "), F.size(array).cast("string"))).cast("int"))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, v: a + v * v))


def warped(x: Column, y: Column, cx: Column, cy: Column, d: Column, degree: int) -> tuple[Column, Column]:
    """Where the pixel (x, y) of a patch centred at (cx, cy) goes under the vector d of the given order."""
    dx, dy = x - cx, y - cy
    px, py = x + F.get(d, F.lit(0)), y + F.get(d, F.lit(1))
    if degree >= 1:
        px, py = px + F.get(d, F.lit(2)) * dx + F.get(d, F.lit(3)) * dy, py + F.get(d, F.lit(4)) * dx + F.get(d, F.lit(5)) * dy
    if degree >= 2:
        px = px + F.get(d, F.lit(6)) * dx * dx / 2 + F.get(d, F.lit(7)) * dy * dy / 2 + F.get(d, F.lit(8)) * dx * dy
        py = py + F.get(d, F.lit(9)) * dx * dx / 2 + F.get(d, F.lit(10)) * dy * dy / 2 + F.get(d, F.lit(11)) * dx * dy
    return px, py
