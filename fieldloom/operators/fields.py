"""Votes to displacement fields, cumulative fields, strain.

Tables: votes and fields are sparse, (keys, x, y, dx, dy, quality); no row is no data."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import deformation
from ..shared import kept
from . import mesh


def patch_votes(results: DataFrame, min_quality: float, degree: int = 1) -> DataFrame:
    """results (keys, cx, cy, s, deformation, quality) -> a vote for each pixel of each good patch."""
    good = results.where((F.col("quality") >= min_quality) & F.col("deformation").isNotNull())
    pix = mesh.patch_pixels(good)
    px, py = deformation.warped(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"), F.col("deformation"), degree)
    return pix.withColumn("dx", px - F.col("x")).withColumn("dy", py - F.col("y")).drop("ox", "oy", "deformation")


def mode1d(df: DataFrame, keys: list[str], value: str, precision: float) -> DataFrame:
    """The centre of the most frequent bin, the smallest among equals."""
    bins = df.groupBy(*keys, F.floor(F.col(value) / precision + 0.5).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    out = bins.groupBy(*keys) if keys else bins.groupBy()
    return out.agg((F.coalesce(F.max_by("b", F.struct("n", -F.col("b"))), F.lit(0)) * precision).alias("mode"))


def mode2d(votes: DataFrame, keys: list[str], precision: float = 0.1) -> DataFrame:
    """keys, mx, my: the centre of the 2-D bin with most votes, then most quality, then the smallest bin."""
    bins = votes.groupBy(*keys, F.floor(F.col("dx") / precision + 0.5).alias("bx"), F.floor(F.col("dy") / precision + 0.5).alias("by")).agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("sq"))
    top = F.max_by(F.struct("bx", "by", "n", "sq"), F.struct("n", "sq", -F.col("bx"), -F.col("by")))
    return bins.groupBy(*keys).agg(top.alias("b")).select(*keys, (F.col("b.bx") * precision).alias("mx"), (F.col("b.by") * precision).alias("my"), F.col("b.n").alias("votes"), F.col("b.sq").alias("sum_q"))


def displacement(votes: DataFrame, keys: list[str], precision: float = 0.1, radius: float = 1.0) -> DataFrame:
    """Quality-weighted mean of the votes within ``radius`` of the modal vote, and its quality in per cent."""
    near = votes.join(mode2d(votes, keys, precision), keys)
    ex, ey, q = F.col("dx") - F.col("mx"), F.col("dy") - F.col("my"), F.col("q")
    # a hair over the radius, so that a distance of exactly the radius counts on every engine
    sums = near.where(ex * ex + ey * ey <= radius * radius + 1e-9).groupBy(*keys).agg(F.sum(F.col("dx") * q).alias("sx"), F.sum(F.col("dy") * q).alias("sy"), F.sum(q).alias("s"), F.sum(q * q).alias("ss"))
    return sums.where("s > 0").select(*keys, (F.col("sx") / F.col("s")).alias("dx"), (F.col("sy") / F.col("s")).alias("dy"), ((F.col("ss") / F.col("s") + 1) / 2 * 100).alias("quality"))


def sampled(points: DataFrame, field: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, px, py) -> with sx, sy, sq: the field (x, y, dx, dy, quality) between pixels; null where a neighbour with
    weight is missing.  A neighbour's missing quality counts as nothing."""
    fx, fy = F.floor("px"), F.floor("py")
    tx, ty = F.col("px") - fx, F.col("py") - fy
    taps = F.array(*[F.struct((fx + i).alias("tx"), (fy + j).alias("ty"), ((tx if i else 1 - tx) * (ty if j else 1 - ty)).alias("w")) for i in (0, 1) for j in (0, 1)])
    hit = points.select(*keys, "px", "py", F.explode(taps).alias("t")).select(*keys, "px", "py", "t.*").where("w > 0")
    f = field.select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("dx").alias("fx"), F.col("dy").alias("fy"), F.col("quality").alias("fq"))
    out = hit.join(f, ["tx", "ty"], "left").groupBy(*keys).agg(
        F.sum(F.col("w") * F.col("fx")).alias("sx"), F.sum(F.col("w") * F.col("fy")).alias("sy"), F.sum(F.col("w") * F.coalesce("fq", F.lit(0.0))).alias("sq"), F.max(F.col("fx").isNull()).alias("hole")
    )
    return out.select(*keys, *[F.when(~F.col("hole"), F.col(c)).alias(c) for c in ("sx", "sy", "sq")])


#: Rounds of a composition that are one plan; after that many, the walk is written down.
PLAN_ROUNDS = 4


def compositions(steps: Iterable[DataFrame]) -> Iterator[DataFrame]:
    """Cumulative fields over consecutive fields (x, y, dx, dy, quality), one after each step: each pixel walks through them
    and stops at the first hole; its displacement so far, the mean quality of its steps and their number.  A pixel that the
    first field lacks has no row."""
    walk = None
    for k, step in enumerate(steps):
        if walk is None:
            walk = step.select("x", "y", (F.col("x") + F.col("dx")).alias("px"), (F.col("y") + F.col("dy")).alias("py"), F.coalesce("quality", F.lit(0.0)).alias("q"), F.lit(1).alias("n"), F.lit(True).alias("going"))
        else:
            seen = sampled(walk.where("going").select("x", "y", "px", "py"), step, ["x", "y"])
            walk = walk.join(seen, ["x", "y"], "left")
            found = F.col("sx").isNotNull()
            walk = walk.select(
                "x", "y", F.when(found, F.col("px") + F.col("sx")).otherwise(F.col("px")).alias("px"), F.when(found, F.col("py") + F.col("sy")).otherwise(F.col("py")).alias("py"),
                F.when(found, F.col("q") + F.col("sq")).otherwise(F.col("q")).alias("q"), (F.col("n") + F.when(found, 1).otherwise(0)).alias("n"), (F.col("going") & found).alias("going"),
            )
            if k % PLAN_ROUNDS == 0:
                walk = kept(walk, "walk")
        yield walk.select("x", "y", (F.col("px") - F.col("x")).alias("dx"), (F.col("py") - F.col("y")).alias("dy"), (F.col("q") / F.col("n")).alias("quality"), "n")


def compose(steps: list[DataFrame]) -> DataFrame:
    """The cumulative field over all steps."""
    return list(compositions(steps))[-1]


def cascade(available: DataFrame, start: int, end: int) -> list[tuple[int, int]]:
    """The path from round ``start`` to ``end``: always the longest result available next.  available (round_from, round_to)."""
    have = {(r.round_from, r.round_to) for r in available.where(F.col("round_from").between(start, end) & F.col("round_to").between(start, end)).distinct().collect()}  # at most rounds squared
    path, at = [], start
    while at < end:
        to = max((b for a, b in have if a == at and b <= end), default=None)
        if to is None or to <= at:
            raise ValueError(f"no result from round {at} towards {end}")
        path.append((at, to))
        at = to
    return path


def cascades(available: DataFrame, keys: list[str], start: int, end: int) -> DataFrame:
    """``cascade`` for many sequences at once: available (keys, round_from, round_to) -> keys, round_from, round_to of each
    path, as far as it gets.  What is gathered for a key is a step a round."""
    inside = available.where(F.col("round_from").between(start, end) & F.col("round_to").between(start, end) & (F.col("round_to") > F.col("round_from")))
    steps = inside.groupBy(*keys, "round_from").agg(F.max("round_to").cast("long").alias("to")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("round_from").cast("long").alias("at"), "to"))).alias("next"))
    first = F.array(F.lit(start).cast("long"))

    def follow(path: Column, _: Column) -> Column:
        to = F.try_element_at("next", F.element_at(path, -1))
        return F.when(to.isNotNull(), F.array_append(path, to)).otherwise(path)

    path = steps.select(*keys, F.aggregate(F.sequence(F.lit(start), F.lit(end)), first, follow).alias("path"))
    pairs = F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("round_from"), F.slice("path", 2, F.size("path")).alias("round_to"))
    return path.where(F.size("path") > 1).select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def _reach(mm: float, ratio: float) -> int:
    import math

    return math.ceil(math.ceil(mm * ratio) / 2)


#: Cells along a side of a tile of window sums.
TILE = 256


def window_sums(field: DataFrame, keys: list[str], reach: int, values: dict[str, Column], offsets: bool = False) -> DataFrame:
    """keys, x, y and the sums of ``values`` over the cells at most ``reach`` away on both axes, for each cell of ``field``.

    Cells are dealt to tiles, those near a border to their neighbours too (some (1 + 2 reach / tile)^2 of them in all), and a
    tile's windows are differences of its running sums: one shuffle, whatever the reach.  offsets: adds n, sx, sy, xx, yy, xy,
    the moments of the places about the tile's corner, and for each value v xv and yv."""
    side = max(TILE, 4 * reach)
    names = list(values)
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    span = lambda c: F.explode(F.sequence(F.floor((c - reach) / side), F.floor((c + reach) / side)))
    cells = field.select(*keys, x.alias("x"), y.alias("y"), *[v.cast("double").alias(k) for k, v in values.items()])
    dealt = cells.withColumn("tx_", span(F.col("x"))).withColumn("ty_", span(F.col("y")))
    more = ["n", "sx", "sy", "xx", "yy", "xy", *[f"{a}{v}" for v in names for a in "xy"]] if offsets else []
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.select(*keys, "x", "y").schema)
    out_names = [*keys, "x", "y", *names, *more]
    width = side + 2 * reach

    def run(tile: pa.Table) -> pa.Table:
        gx, gy = (tile.column(c).to_numpy() for c in ("x", "y"))
        x0, y0 = (tile.column(c)[0].as_py() * side for c in ("tx_", "ty_"))
        lx, ly = gx - x0, gy - y0  # -reach .. side + reach - 1
        own = np.flatnonzero((lx >= 0) & (lx < side) & (ly >= 0) & (ly < side))
        held = {v: tile.column(v).to_numpy() for v in names}
        if offsets:
            fx, fy = lx.astype(float), ly.astype(float)
            held |= {"n": np.ones(len(fx)), "sx": fx, "sy": fy, "xx": fx * fx, "yy": fy * fy, "xy": fx * fy}
            held |= {f"{a}{v}": c * held[v] for v in names for a, c in (("x", fx), ("y", fy))}
        columns = []
        for v in (*names, *more):
            grid = np.zeros((width + 1, width + 1))
            np.add.at(grid, (lx + reach + 1, ly + reach + 1), held[v])
            grid = grid.cumsum(axis=0).cumsum(axis=1)
            a, b = lx[own], ly[own]
            c, d = a + 2 * reach + 1, b + 2 * reach + 1
            columns.append(pa.array(grid[c, d] - grid[a, d] - grid[c, b] + grid[a, b]))
        at = pa.array(own)
        return pa.Table.from_arrays([*(tile.column(k).combine_chunks().take(at) for k in (*keys, "x", "y")), *columns], names=out_names)

    schema = kinds + "".join(f", {v} double" for v in (*names, *more))
    return dealt.groupBy(*keys, "tx_", "ty_").applyInArrow(run, schema)


def strain(field: DataFrame, keys: list[str], mm: float = 20.0, ratio: float = 1.0) -> DataFrame:
    """Least-squares planes of dx and dy in a square window around each pixel: exx, eyy, exy in per cent, and the residual
    standard errors.  Windows with three points or fewer have null strain and error 1; collinear ones null strain, error 0."""
    u, v = F.col("dx"), F.col("dy")
    return plane_strain(window_sums(field, keys, _reach(mm, ratio), {"u": u, "v": v, "uu": u * u, "vv": v * v}, offsets=True), keys)


def plane_strain(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Normal equations about the window's mean, by Cramer's rule."""
    c = F.col
    n = c("n")

    def co(ab: str, a: str, b: str) -> Column:
        return c(ab) - c(a) * c(b) / n

    m = sums.withColumns({"cxx": co("xx", "sx", "sx"), "cyy": co("yy", "sy", "sy"), "cxy": co("xy", "sx", "sy"), "cxu": co("xu", "sx", "u"), "cyu": co("yu", "sy", "u"), "cxv": co("xv", "sx", "v"), "cyv": co("yv", "sy", "v"), "cuu": co("uu", "u", "u"), "cvv": co("vv", "v", "v")})
    m = m.withColumn("det", c("cxx") * c("cyy") - c("cxy") * c("cxy")).withColumn("few", n <= 3).withColumn("flat", F.abs(c("det")) < 1e-9)
    det = F.nullif(F.when(c("flat"), F.lit(0.0)).otherwise(c("det")), F.lit(0.0))
    a1, a2 = (c("cxu") * c("cyy") - c("cyu") * c("cxy")) / det, (c("cyu") * c("cxx") - c("cxu") * c("cxy")) / det
    b1, b2 = (c("cxv") * c("cyy") - c("cyv") * c("cxy")) / det, (c("cyv") * c("cxx") - c("cxv") * c("cxy")) / det
    m = m.withColumns({"a1": a1, "a2": a2, "b1": b1, "b2": b2})

    def error(ss: str, p: str, q: str, x: str, y: str) -> Column:
        rest = F.greatest(c(ss) - c(p) * c(x) - c(q) * c(y), F.lit(0.0))
        return F.when(c("few"), F.lit(1.0)).when(c("flat"), F.lit(0.0)).otherwise(F.sqrt(rest / F.nullif(n - 3, F.lit(0.0))))

    ok = ~c("few") & ~c("flat")
    return m.select(*keys, "x", "y", F.when(ok, c("a1") * 100).alias("exx"), F.when(ok, c("b2") * 100).alias("eyy"), F.when(ok, (c("b1") + c("a2")) * 50).alias("exy"), error("cuu", "a1", "a2", "cxu", "cyu").alias("err_u"), error("cvv", "b1", "b2", "cxv", "cyv").alias("err_v"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
