"""Correlation criteria as grouped moments, and the choice of the best candidate.

Whole-pixel candidates are tried tile by tile: patches and both frames' pixels are dealt to square tiles, pixels near a
border to each tile that may need them, and a tile's patches are scored together in arrays, with exact sums of integer grey
levels.  A flat patch (no variance on either side) correlates as 0."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def moments(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs (keys, f, g) -> keys, n and the sums sf, sg, sff, sgg, sfg."""
    f, g = F.col("f"), F.col("g")
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(f).alias("sf"), F.sum(g).alias("sg"), F.sum(f * f).alias("sff"), F.sum(g * g).alias("sgg"), F.sum(f * g).alias("sfg"))


def zncc() -> Column:
    """Zero-mean normalised cross-correlation of a row of moments."""
    n = F.col("n")
    vf, vg = n * F.col("sff") - F.col("sf") * F.col("sf"), n * F.col("sgg") - F.col("sg") * F.col("sg")
    return F.when((vf <= 0) | (vg <= 0), F.lit(0.0)).otherwise((n * F.col("sfg") - F.col("sf") * F.col("sg")) / (F.sqrt(vf.cast("double")) * F.sqrt(vg.cast("double"))))


def znssd(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """1 - sum((f'/|f'| - g'/|g'|)^2) / 2, from the definition: norms first, then the sum.  Equals ZNCC."""
    norms = centred(pairs, keys)
    term = (F.col("f") - F.col("mf")) / F.col("df") - (F.col("g") - F.col("mg")) / F.col("dg")
    return pairs.join(norms, keys).groupBy(*keys).agg(F.when((F.max("df") == 0) | (F.max("dg") == 0), F.lit(0.0)).otherwise(F.lit(1.0) - F.sum(F.when((F.col("df") > 0) & (F.col("dg") > 0), term * term)) / 2).alias("q"))


def centred(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, means mf, mg and centred norms df, dg; the norms from integer moments, so that a flat patch has exactly 0."""
    n = F.col("n")

    def norm(s: str, ss: str) -> Column:
        return F.sqrt((n * F.col(ss) - F.col(s) * F.col(s)) / n.cast("double"))

    return moments(pairs, keys).select(*keys, (F.col("sf") / n).alias("mf"), (F.col("sg") / n).alias("mg"), norm("sf", "sff").alias("df"), norm("sg", "sgg").alias("dg"))


def wznssd(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted: pairs also hold wf, wg, the weights of the pixel before and after the warp.

    r = sum((g'/|g'| wg - f'/|f'| wf)^2) / sum(wg^2), quality 1 - r / 2."""
    norms = centred(pairs, keys)
    flat = (F.col("df") == 0) | (F.col("dg") == 0)
    term = F.when(~flat, (F.col("g") - F.col("mg")) / F.nullif("dg", F.lit(0.0)) * F.col("wg") - (F.col("f") - F.col("mf")) / F.nullif("df", F.lit(0.0)) * F.col("wf"))
    out = pairs.join(norms, keys).groupBy(*keys).agg(F.max(flat).alias("flat"), F.sum(term * term).alias("r"), F.sum(F.col("wg") * F.col("wg")).alias("w"))
    return out.select(*keys, F.when(F.col("flat"), F.lit(0.0)).otherwise(1.0 - F.when(F.col("w") > 0, F.col("r") / F.nullif("w", F.lit(0.0))).otherwise(F.col("r")) / 2).alias("q"))


def best(scores: DataFrame, keys: list[str], candidate: str = "cand_id", quality: str = "q") -> DataFrame:
    """Each key's candidate of the highest quality (to nine decimals), the lowest index among equals."""
    rank = F.struct(F.round(quality, 9).alias("q"), (-F.col(candidate)).alias("i"))
    return scores.groupBy(*keys).agg(F.max_by(candidate, rank).alias(candidate), F.max(F.round(quality, 9)).alias(quality))


#: Pixels along a side of a tile.
TILE = 256
#: Whole-pixel moves that a search may have: they go to every task.
MAX_CANDIDATES = 5_000_000
_MOMENTS = ("n", "sf", "sg", "sff", "sgg", "sfg")


def _tiles(subsets: DataFrame, frame_a: DataFrame, frame_b: DataFrame, keys: list[str], frame_keys: list[str], reach: int):
    """Patches and pixels dealt to the same tiles, cogrouped, and the halo: how far a tile's grids reach beyond it.

    A patch is in one tile; a pixel in each tile that is at most the halo away, some (1 + 2 halo / tile)^2 of them."""
    halo = int(subsets.agg(F.max("s")).first()[0] or 0) + reach
    side = max(TILE, 4 * halo)
    px, py = F.floor(F.col("cx") + 0.5), F.floor(F.col("cy") + 0.5)
    patches = subsets.select(*dict.fromkeys([*keys, *frame_keys, "cx", "cy", "s"]), px.alias("px_"), py.alias("py_")).withColumn("tx_", F.floor(F.col("px_") / side)).withColumn("ty_", F.floor(F.col("py_") / side))
    one = lambda frame, which: frame.select(*frame_keys, F.lit(which).alias("which_"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("g").cast("double").alias("g"))
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side)))
    cells = one(frame_a, 0).unionAll(one(frame_b, 1)).withColumn("tx_", span("x")).withColumn("ty_", span("y"))
    by = [*frame_keys, "tx_", "ty_"]
    return patches.groupBy(*by).cogroup(cells.groupBy(*by)), side, halo


def _grids(patches: pa.Table, cells: pa.Table, side: int, halo: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Both frames of a tile (NaN: no pixel), and the patches' places in them and half sizes."""
    x0, y0 = (patches.column(c)[0].as_py() * side - halo for c in ("tx_", "ty_"))
    grids = [np.full((side + 2 * halo, side + 2 * halo), np.nan) for _ in range(2)]
    x, y, which, g = (cells.column(c).to_numpy() for c in ("x", "y", "which_", "g"))
    for k in (0, 1):
        at = which == k
        grids[k][x[at] - x0, y[at] - y0] = g[at]
    return grids, patches.column("px_").to_numpy() - x0, patches.column("py_").to_numpy() - y0, patches.column("s").to_numpy()


def _moves(cands: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cand_id, u, v, by cand_id: what the limits of a task say, a few thousand as a rule."""
    n = cands.count()
    if n > MAX_CANDIDATES:
        raise ValueError(f"{n} candidates: use an iterative solver or narrower limits")
    rows = sorted(tuple(r) for r in cands.select("cand_id", "u", "v").collect())
    return tuple(np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ((), (), ())))


def _tile_scores(grids, px, py, half, moves):
    """Rows of patches, candidate's place, and the moments of all candidates whose patch lies in both frames."""
    ids, u, v = moves
    for s in np.unique(half):
        n = 2 * int(s) + 1
        first, second = (np.lib.stride_tricks.sliding_window_view(g, (n, n)) for g in grids)
        rows = np.flatnonzero(half == s)
        f = first[px[rows] - s, py[rows] - s].reshape(len(rows), -1)
        whole = ~np.isnan(f).any(axis=1)
        rows, f = rows[whole], f[whole]
        sf, sff = f.sum(axis=1), (f * f).sum(axis=1)
        for k in range(len(ids)):
            g = second[px[rows] - s + u[k], py[rows] - s + v[k]].reshape(len(rows), -1)
            sg = g.sum(axis=1)
            ok = ~np.isnan(sg)
            if ok.any():
                yield rows[ok], k, (np.full(int(ok.sum()), float(n * n)), sf[ok], sg[ok], sff[ok], (g * g).sum(axis=1)[ok], (f * g).sum(axis=1)[ok])


def _zncc(n, sf, sg, sff, sgg, sfg) -> np.ndarray:
    vf, vg = n * sff - sf * sf, n * sgg - sg * sg
    flat = (vf <= 0) | (vg <= 0)
    return np.where(flat, 0.0, (n * sfg - sf * sg) / np.where(flat, 1.0, np.sqrt(np.abs(vf)) * np.sqrt(np.abs(vg))))


def _types(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*names).schema)


def integer_scores(subsets: DataFrame, cands: DataFrame, frame_a: DataFrame, frame_b: DataFrame, keys: list[str], frame_keys: list[str] | None = None) -> DataFrame:
    """keys, cand_id, u, v and moments of every whole-pixel candidate (cand_id, u, v) whose patch (keys, cx, cy, s) stays in
    both frames (frame_keys, x, y, g).  Only patches and pixels shuffle, by tile; candidates are tried in the tile."""
    frame_keys = frame_keys or []
    moves = _moves(cands)
    pairs, side, halo = _tiles(subsets, frame_a, frame_b, keys, frame_keys, int(max(np.abs(moves[1]).max(initial=0), np.abs(moves[2]).max(initial=0))))
    names = [*keys, "cand_id", "u", "v", *_MOMENTS]

    def run(patches: pa.Table, cells: pa.Table) -> pa.Table:
        parts = []
        if patches.num_rows and cells.num_rows:
            grids, px, py, half = _grids(patches, cells, side, halo)
            for rows, k, sums in _tile_scores(grids, px, py, half, moves):
                own = patches.select(keys).take(pa.array(rows))
                cand = [pa.array(np.full(len(rows), m[k])) for m in moves]
                parts.append(pa.Table.from_arrays([*(own.column(c).combine_chunks() for c in keys), *cand, *[pa.array(x.astype(np.int64)) for x in sums]], names=names))
        return pa.concat_tables(parts) if parts else empty

    schema = _types(subsets, keys) + ", cand_id long, u long, v long" + "".join(f", {m} long" for m in _MOMENTS)
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return pairs.applyInArrow(run, schema)


def best_moves(subsets: DataFrame, cands: DataFrame, frame_a: DataFrame, frame_b: DataFrame, keys: list[str], frame_keys: list[str] | None = None) -> DataFrame:
    """keys, cand_id, u, v, quality of each patch's best candidate: highest ZNCC to nine decimals, then lowest index."""
    frame_keys = frame_keys or []
    moves = _moves(cands)
    pairs, side, halo = _tiles(subsets, frame_a, frame_b, keys, frame_keys, int(max(np.abs(moves[1]).max(initial=0), np.abs(moves[2]).max(initial=0))))
    names = [*keys, "cand_id", "u", "v", "quality"]

    def run(patches: pa.Table, cells: pa.Table) -> pa.Table:
        if not patches.num_rows or not cells.num_rows:
            return empty
        grids, px, py, half = _grids(patches, cells, side, halo)
        top, at = np.full(patches.num_rows, -np.inf), np.zeros(patches.num_rows, np.int64)
        for rows, k, sums in _tile_scores(grids, px, py, half, moves):
            q = np.floor(_zncc(*sums) * 1e9 + 0.5) / 1e9
            better = q > top[rows]
            top[rows[better]], at[rows[better]] = q[better], k
        rows = np.flatnonzero(top > -np.inf)
        own = patches.select(keys).take(pa.array(rows))
        return pa.Table.from_arrays([*(own.column(c).combine_chunks() for c in keys), *[pa.array(m[at[rows]]) for m in moves], pa.array(top[rows])], names=names)

    schema = _types(subsets, keys) + ", cand_id long, u long, v long, quality double"
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return pairs.applyInArrow(run, schema)


def windows(subsets: DataFrame, frame_a: DataFrame, frame_b: DataFrame, keys: list[str], reach: int, frame_keys: list[str] | None = None) -> DataFrame:
    """keys, cx, cy, s, f: the patch's levels, w: the second frame's around it, ``reach`` pixels further; both column by
    column, without patches that the first frame cuts; -1 where the second frame ends."""
    pairs, side, halo = _tiles(subsets, frame_a, frame_b, keys, frame_keys or [], reach)
    names = [*keys, "cx", "cy", "s", "f", "w"]

    def run(patches: pa.Table, cells: pa.Table) -> pa.Table:
        parts = []
        if patches.num_rows and cells.num_rows:
            grids, px, py, half = _grids(patches, cells, side, halo)
            for s in np.unique(half):
                n, m = 2 * int(s) + 1, 2 * (int(s) + reach) + 1
                rows = np.flatnonzero(half == s)
                f = np.lib.stride_tricks.sliding_window_view(grids[0], (n, n))[px[rows] - s, py[rows] - s].reshape(len(rows), -1)
                w = np.lib.stride_tricks.sliding_window_view(grids[1], (m, m))[px[rows] - s - reach, py[rows] - s - reach].reshape(len(rows), -1)
                whole = np.flatnonzero(~np.isnan(f).any(axis=1))
                own = patches.select(names[:-2]).take(pa.array(rows[whole]))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.nan_to_num(x[whole], nan=-1.0).astype(np.float32).ravel())) for x in (f, w)]
                parts.append(pa.Table.from_arrays([*(own.column(c).combine_chunks() for c in names[:-2]), *lists], names=names))
        return pa.concat_tables(parts) if parts else empty

    schema = _types(subsets, names[:-2]) + ", f array<float>, w array<float>"
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return pairs.applyInArrow(run, schema)
