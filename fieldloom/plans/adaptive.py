"""Adaptive meshes: an equal grid, refined where the previous displacement changes within a triangle.

One Arrow group a region: the mesh of a region is small, and its refinement is a loop on that mesh alone."""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JUMP, SHORTEST, NEAREST = 0.25, 2.0, 0.25


def _pixel(p) -> tuple[int, int]:
    return math.floor(p[0] + 0.5), math.floor(p[1] + 0.5)


def _steepness(p, value) -> float:
    """How much the field changes at a vertex: dx to the right, dy downwards; what is missing doesn't change."""
    (x, y), total = _pixel(p), 0.0
    here = value((x, y))
    for axis, there in enumerate((value((x + 1, y)), value((x, y + 1)))):
        if here is not None and there is not None:
            total += abs(here[axis] - there[axis])
    return total


def _between(a, b, value):
    """The vertex that cuts an edge: the mean of its ends weighted by their steepness, or, if one end is much steeper or
    neither is steep, a quarter from the second end."""
    u, v = _steepness(a, value), _steepness(b, value)
    share = u / (u + v) if u + v > 0 else 0.0
    share = share if NEAREST <= share <= 1 - NEAREST else NEAREST
    return tuple(p * share + q * (1 - share) for p, q in zip(a, b, strict=True))


def _differs(a, b, value) -> bool:
    u, v = value(_pixel(a)), value(_pixel(b))
    return u is not None and v is not None and math.dist(u, v) > JUMP


def refined(points: list[tuple[float, float]], columns: int, value) -> list[tuple[float, float]]:
    """points: a grid row by row, value: (x, y) -> (dx, dy) or None.  A triangle in which the field jumps is cut on every edge
    that is long enough; triangles cut their edges by themselves, so a shared edge may be cut twice."""
    out, rows = list(points), len(points) // columns if columns else 0
    todo: deque = deque()
    for j in range(rows - 1):
        for i in range(columns - 1):
            a, b, c, d = (points[(j + y) * columns + i + x] for y in (0, 1) for x in (0, 1))
            todo += [(a, b, c), (b, c, d)]
    while todo:
        tri = todo.popleft()
        if not any(_differs(tri[i], tri[j], value) for i, j in ((0, 1), (0, 2), (1, 2))):
            continue
        cuts = {(i, j): _between(tri[i], tri[j], value) for i, j in ((0, 1), (1, 2), (0, 2)) if math.dist(tri[i], tri[j]) >= SHORTEST}
        out += cuts.values()
        if len(cuts) == 1:  # two halves
            (((i, j), m),) = cuts.items()
            todo += [(tri[3 - i - j], tri[i], m), (tri[3 - i - j], tri[j], m)]
        else:  # the corners between two cut edges, and what is left in the middle of three
            todo += [(tri[k], *[m for e, m in cuts.items() if k in e]) for k in range(3) if sum(k in e for e in cuts) == 2]
            if len(cuts) == 3:
                todo.append(tuple(cuts.values()))
    return out


TILE = 64


def refine(rois: DataFrame, previous: DataFrame | None, spacing: int, width: int | None, height: int | None, keys: list[str] | None = None) -> DataFrame:
    """rois (keys, roi_id, x1, y1, x2, y2, s), previous (keys, x, y, dx, dy) -> keys, roi_id, subset_id, cx, cy, s.

    Regions meet the field by the tiles of TILE x TILE cells that they touch, an equi-join.  width, height: of the frame;
    None leaves only the region as bound."""
    keys = keys or []
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rois.select(*keys).schema) + (", " if keys else "") + "roi_id int, subset_id int, cx double, cy double, s int"
    if previous is None:
        both = rois.withColumns({c: F.lit(None).cast("double") for c in ("x", "y", "dx", "dy")})
    else:
        tiles = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / TILE), F.floor((F.col(hi) + 1) / TILE)))
        touched = rois.withColumn("tx_", tiles("x1", "x2")).withColumn("ty_", tiles("y1", "y2"))
        cells = previous.select(*keys, "x", "y", "dx", "dy", F.floor(F.col("x") / TILE).alias("tx_"), F.floor(F.col("y") / TILE).alias("ty_"))
        both = touched.join(cells, [*keys, "tx_", "ty_"], "left").drop("tx_", "ty_")
        # each region with the cells that its mesh can ask about, and once without any
        inside = F.col("x").between(F.col("x1"), F.col("x2") + 1) & F.col("y").between(F.col("y1"), F.col("y2") + 1)
        both = both.where(inside | F.col("x").isNull())
        both = both.unionByName(rois.withColumns({c: F.lit(None).cast(both.schema[c].dataType) for c in ("x", "y", "dx", "dy")}))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        s, x1, y1, x2, y2 = (int(r[c]) for c in ("s", "x1", "y1", "x2", "y2"))

        def count(size: int) -> int:
            room = size - 2 * s
            return 0 if room <= 0 else 1 if room < spacing else room // spacing

        nx, ny = count(x2 - x1 + 1), count(y2 - y1 + 1)
        grid = [(x1 + s + i * spacing, y1 + s + j * spacing) for j in range(ny) for i in range(nx)]
        known = {(int(a), int(b)): (c, d) for a, b, c, d in pdf[["x", "y", "dx", "dy"]].dropna().itertuples(index=False)}
        points = refined(grid, nx, known.get) if known else grid
        right, bottom = (x2 if width is None else min(width - 1, x2)), (y2 if height is None else min(height - 1, y2))
        ok = [p for p in points if p[0] - s >= max(0, x1) and p[1] - s >= max(0, y1) and p[0] + s <= right and p[1] + s <= bottom]
        return pd.DataFrame({**{k: r[k] for k in keys}, "roi_id": int(r.roi_id), "subset_id": range(len(ok)), "cx": [float(p[0]) for p in ok], "cy": [float(p[1]) for p in ok], "s": s})

    return both.groupBy(*keys, "roi_id").applyInPandas(run, schema)
