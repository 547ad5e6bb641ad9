"""Regions of interest: rectangles with inclusive, ordered corners, and circles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """Three numbers joined by ';' are a circle, four a rectangle; anything else is an error.  A decimal comma is read too."""
    n = F.transform(F.split(F.regexp_replace(text, ",", "."), ";"), lambda t: F.trim(t).try_cast("double"))
    none = F.lit(None).cast("double")
    at = lambda k: F.get(n, F.lit(k))
    circle = F.struct(F.lit("circle").alias("kind"), none.alias("x1"), none.alias("y1"), none.alias("x2"), none.alias("y2"), at(0).alias("cx"), at(1).alias("cy"), at(2).alias("r"))
    rect = F.struct(F.lit("rect").alias("kind"), F.least(at(0), at(2)).alias("x1"), F.least(at(1), at(3)).alias("y1"), F.greatest(at(0), at(2)).alias("x2"), F.greatest(at(1), at(3)).alias("y2"), none.alias("cx"), none.alias("cy"), none.alias("r"))
    return F.when(F.size(n) == 3, circle).when(F.size(n) == 4, rect).otherwise(F.raise_error(F.concat(F.lit("not a region: "), text)))


def rect_point(x, y, x1, y1, x2, y2) -> Column:
    return x.between(x1, x2) & y.between(y1, y2)


def circle_point(x, y, cx, cy, r) -> Column:
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r


def rect_area(ax1, ay1, ax2, ay2, x1, y1, x2, y2) -> Column:
    """The box a lies within the rectangle."""
    return (ax1 >= x1) & (ay1 >= y1) & (ax2 <= x2) & (ay2 <= y2)


def circle_area(ax1, ay1, ax2, ay2, cx, cy, r) -> Column:
    """All four corners of the box lie within the circle."""
    out = F.lit(True)
    for x in (ax1, ax2):
        for y in (ay1, ay2):
            out = out & circle_point(x, y, cx, cy, r)
    return out


def point_in(x: Column, y: Column, roi: str = "") -> Column:
    """A point in a region row (kind, x1 .. r), as predicate of a join."""
    c = lambda n: F.col(roi + n)
    return ((c("kind") == "rect") & rect_point(x, y, c("x1"), c("y1"), c("x2"), c("y2"))) | ((c("kind") == "circle") & circle_point(x, y, c("cx"), c("cy"), c("r")))


def in_frame(x1, y1, x2, y2, width, height) -> Column:
    """Whether a box of pixels lies in a frame."""
    return (x1 >= 0) & (y1 >= 0) & (x2 < width) & (y2 < height)
