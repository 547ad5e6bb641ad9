"""From patches to their best deformation.

Exhaustive search is done tile by tile (``correlate``), coarse-to-fine search starts from it.  The iterative ones (Newton-Raphson in four
variants, stochastic gradient) optimise each patch by itself, in Arrow batches: a row carries the patch and the part of the
second frame that it can reach, so no frame is broadcast and memory follows the batch."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sampling
from ..operators import correlate, mesh

#: Solver -> (knows higher orders, knows weights).
SOLVERS = {
    "BRUTE_FORCE": (True, False), "COARSE_FINE": (False, False), "NEWTON_RHAPSON_CENTRAL": (True, False), "NEWTON_RHAPSON_FORWARD": (True, False),
    "NEWTON_RHAPSON_CENTRAL_HE": (True, False), "NEWTON_RHAPSON_FORWARD_HE": (True, False), "SPGD": (True, True),
}
#: Amplitude of the stochastic perturbation for displacement, first and second gradients.
AMPLITUDE = [0.1] * 2 + [0.01] * 4 + [0.01] * 6


def integer_candidates(spark, lo: int, hi: int, ylo: int | None = None, yhi: int | None = None) -> DataFrame:
    """cand_id, u, v of all whole-pixel moves, u fastest."""
    n, ylo, yhi = hi - lo + 1, lo if ylo is None else ylo, hi if yhi is None else yhi
    return spark.range(n * (yhi - ylo + 1)).select(F.col("id").alias("cand_id"), (F.col("id") % n + lo).alias("u"), (F.floor(F.col("id") / n) + ylo).alias("v"))


def brute_force(subsets: DataFrame, cands: DataFrame, frame_a: DataFrame, frame_b: DataFrame, keys: list[str], frame_keys: list[str] | None = None) -> DataFrame:
    """keys, cand_id, u, v, quality of each patch's best whole-pixel move."""
    return correlate.best_moves(subsets, cands, frame_a, frame_b, keys, frame_keys)


def refine(start: DataFrame, subsets: DataFrame, frame_a: DataFrame, frame_b: DataFrame, keys: list[str], step: float, reach: int) -> DataFrame:
    """The best move among those ``step`` apart, up to ``reach`` steps around each patch's start (keys, u, v)."""
    n = 2 * reach + 1
    offsets = F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("cand_id")
    cands = start.select(*keys, F.col("u").alias("u0"), F.col("v").alias("v0"), offsets)
    cands = cands.select(*keys, "cand_id", (F.col("u0") + (F.col("cand_id") % n - reach) * step).alias("u"), (F.col("v0") + (F.floor(F.col("cand_id") / n) - reach) * step).alias("v"))
    pixels = mesh.patch_pixels(subsets).select(*keys, "s", "x", "y").join(frame_a.select("x", "y", F.col("g").alias("f")), ["x", "y"])
    points = pixels.join(cands, keys).select(*keys, "s", "cand_id", "u", "v", "f", F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + F.col("u")).alias("px"), (F.col("y") + F.col("v")).alias("py"))
    seen = _sampled(points, frame_b, keys)
    full = correlate.moments(seen, [*keys, "half", "cand_id", "u", "v"]).where(F.col("n") == (F.col("half") * 2 + 1) * (F.col("half") * 2 + 1))
    scored = full.withColumn("q", _rounded_zncc())
    rank = F.struct(F.round("q", 6).alias("q"), (-F.col("cand_id")).alias("i"))
    return scored.groupBy(*keys).agg(F.max_by(F.struct("u", "v"), rank).alias("b"), F.max(F.round("q", 6)).alias("quality")).select(*keys, "b.*", "quality")


def _sampled(points: DataFrame, frame_b: DataFrame, keys: list[str]) -> DataFrame:
    own = [*keys, "half", "cand_id", "u", "v", "ax", "ay", "f"]
    out = sampling.bilinear(points.withColumnRenamed("s", "half"), frame_b, own)
    return out.withColumn("g", F.round("s", 6)).drop("s")


def _rounded_zncc():
    n = F.col("n")
    vf, vg = n * F.col("sff") - F.col("sf") * F.col("sf"), n * F.col("sgg") - F.col("sg") * F.col("sg")
    return F.when((vf <= 0) | (vg <= 1e-6), F.lit(0.0)).otherwise((n * F.col("sfg") - F.col("sf") * F.col("sg")) / F.sqrt(F.greatest(vf * vg, F.lit(1e-12))))


def coarse_fine(subsets: DataFrame, frame_a: DataFrame, frame_b: DataFrame, keys: list[str], lo: int, hi: int, steps: tuple[float, ...] = (0.1,), reach: int = 2) -> DataFrame:
    """Whole pixels first, then ever finer steps around the best; displacement only."""
    best = brute_force(subsets, integer_candidates(subsets.sparkSession, lo, hi), frame_a, frame_b, keys)
    for step in steps:
        best = refine(best, subsets, frame_a, frame_b, keys, step, reach)
    return best.select(*keys, "u", "v", "quality")


# --- iterative solvers ------------------------------------------------------------------------------------------


patch_windows = correlate.windows


def _cubic(t: np.ndarray) -> np.ndarray:
    return np.stack([((-0.5 * t + 1) * t - 0.5) * t, (1.5 * t - 2.5) * t * t + 1, ((-1.5 * t + 2) * t + 0.5) * t, (0.5 * t - 0.5) * t * t])


class Patch:
    """One patch: its levels, the window of the second frame, and the criterion as a function of the deformation."""

    def __init__(self, f, w, half: int, reach: int, weight_width: float | None = None):
        n, m = 2 * half + 1, 2 * (half + reach) + 1
        self.half, self.reach, self.size = half, reach, m
        self.f, self.w = np.asarray(f, float).reshape(n, n), np.asarray(w, float).reshape(m, m)
        o = np.arange(-half, half + 1, dtype=float)
        self.ox, self.oy = np.meshgrid(o, o, indexing="ij")
        c = self.f - self.f.mean()
        self.norm = np.sqrt((c * c).sum())
        self.unit = c / self.norm if self.norm > 0 else c
        self.weight = None if weight_width is None else np.exp(-(self.ox**2 + self.oy**2) / (2 * weight_width**2))

    def warp(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the patch's pixels go, for vectors in rows: probes x n x n."""
        c = [d[:, k, None, None] for k in range(d.shape[1])]
        x, y = self.ox + c[0], self.oy + c[1]
        if len(c) >= 6:
            x, y = x + c[2] * self.ox + c[3] * self.oy, y + c[4] * self.ox + c[5] * self.oy
        if len(c) >= 12:
            xx, yy, xy = self.ox**2 / 2, self.oy**2 / 2, self.ox * self.oy
            x, y = x + c[6] * xx + c[7] * yy + c[8] * xy, y + c[9] * xx + c[10] * yy + c[11] * xy
        return x, y

    def sample(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Catmull-Rom samples, and which probes have all their neighbours in the window and the frame."""
        x, y = x + self.half + self.reach, y + self.half + self.reach
        fx, fy = np.floor(x).astype(int), np.floor(y).astype(int)
        ok = (np.minimum(fx, fy).min(axis=(1, 2)) >= 1) & (np.maximum(fx, fy).max(axis=(1, 2)) <= self.size - 3)
        wx, wy = _cubic(x - fx), _cubic(y - fy)
        fx, fy = np.clip(fx, 1, self.size - 3), np.clip(fy, 1, self.size - 3)
        out, least = np.zeros_like(x), np.full(x.shape, np.inf)
        for i in range(4):
            for j in range(4):
                g = self.w[fx + i - 1, fy + j - 1]
                least = np.minimum(least, g)
                out += wx[i] * wy[j] * g
        return out, ok & (least.min(axis=(1, 2)) >= 0)

    def qualities(self, d: np.ndarray) -> np.ndarray:
        """The criterion for vectors in rows: -1 outside the frame, 0 for flat patches."""
        if self.norm == 0:
            return np.zeros(len(d))
        g, ok = self.sample(*self.warp(d))
        c = g - g.mean(axis=(1, 2), keepdims=True)
        norm = np.sqrt((c * c).sum(axis=(1, 2)))
        safe = np.maximum(norm, 1e-9)[:, None, None]
        if self.weight is None:
            q = (self.unit * c / safe).sum(axis=(1, 2))
        else:
            q = 1 - (((c / safe - self.unit) * self.weight) ** 2).sum(axis=(1, 2)) / (self.weight**2).sum() / 2
        return np.where(ok, np.where(norm > 1e-9, q, 0.0), -1.0)

    def quality(self, d: np.ndarray) -> float:
        return float(self.qualities(d[None])[0])

    def coarse(self, reach: int) -> np.ndarray:
        """Best whole-pixel move."""
        best, at = -2.0, (0, 0)
        n = 2 * self.half + 1
        for u in range(-reach, reach + 1):
            for v in range(-reach, reach + 1):
                a, b = self.reach + u, self.reach + v
                g = self.w[a : a + n, b : b + n]
                if g.shape != (n, n) or g.min() < 0:
                    continue
                c = g - g.mean()
                norm = np.sqrt((c * c).sum())
                q = float((self.unit * c).sum() / norm) if norm > 0 and self.norm > 0 else 0.0
                if q > best + 1e-12:
                    best, at = q, (u, v)
        return np.array(at, float)


def _derivatives(patch: Patch, d: np.ndarray, h: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    c = len(d)
    q = patch.qualities(d + _shifts(c, kind) * h)
    hess = np.zeros((c, c))
    if kind == "central":
        up, down = q[1 : c + 1], q[c + 1 : 2 * c + 1]
        grad = (up - down) / (2 * h)
        pp, mm, pm, mp = (q[2 * c + 1 + k * c * c : 2 * c + 1 + (k + 1) * c * c].reshape(c, c) for k in range(4))
        hess = (pp + mm - pm - mp) / (4 * h * h)
        np.fill_diagonal(hess, (up - 2 * q[0] + down) / (h * h))
        return grad, (hess + hess.T) / 2
    up = q[1 : c + 1]
    grad, k = (up - q[0]) / h, c + 1
    for a in range(c):
        for b in range(a, c):
            hess[a, b] = hess[b, a] = (q[k] - up[a] - up[b] + q[0]) / (h * h)
            k += 1
    return grad, hess


@functools.cache
def _shifts(c: int, kind: str) -> np.ndarray:
    """The stencil's probes as vectors of unit steps."""
    probes = mesh.stencil(c, kind)
    out = np.zeros((len(probes), c))
    for k, steps in enumerate(probes):
        for axis, sign in steps:
            out[k, axis] += sign
    return out


def _gradient_only(patch: Patch, d: np.ndarray, h: float, central: bool) -> np.ndarray:
    c, unit = len(d), np.eye(len(d)) * h
    if central:
        q = patch.qualities(np.concatenate((d + unit, d - unit)))
        return (q[:c] - q[c:]) / (2 * h)
    q = patch.qualities(np.concatenate((d[None], d + unit)))
    return (q[1:] - q[0]) / h


def _image_hessian(patch: Patch, d: np.ndarray) -> np.ndarray | None:
    """-2 / sum(g^2) * sum(gi gj) with gradients of the second frame by half-pixel differences."""
    x, y = patch.warp(d[None])
    around = np.array([(0, 0), (0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5)])
    parts, ok = patch.sample(x + around[:, 0, None, None], y + around[:, 1, None, None])
    if not ok.all():
        return None
    g, gx, gy = parts[0], parts[1] - parts[2], parts[3] - parts[4]
    basis = [gx, gy, gx * patch.ox, gx * patch.oy, gy * patch.ox, gy * patch.oy]
    xx, yy, xy = patch.ox**2 / 2, patch.oy**2 / 2, patch.ox * patch.oy
    basis = (basis + [gx * xx, gx * yy, gx * xy, gy * xx, gy * yy, gy * xy])[: len(d)]
    flat = np.stack([b.ravel() for b in basis])
    c = g - g.mean()
    flat = flat - flat.mean(axis=1, keepdims=True)
    return -(flat @ flat.T) / max((c * c).sum(), 1e-12)


def newton(patch: Patch, start: np.ndarray, kind: str, image_hessian: bool, rounds: int = 10) -> tuple[np.ndarray, float, int, str]:
    """Deformation, quality, iterations and why it ended."""
    d, q, h = start, patch.quality(start), 0.01
    for k in range(rounds):
        if q > 0.99999:
            return d, q, k, "quality reached"
        if image_hessian:
            grad, hess = _gradient_only(patch, d, h, kind == "central"), _image_hessian(patch, d)
            if hess is None:
                return d, q, k, "left the frame"
        else:
            grad, hess = _derivatives(patch, d, h, kind)
        try:
            move = np.linalg.solve(hess, -grad)
        except np.linalg.LinAlgError:
            return d, q, k, "singular"
        if not np.isfinite(move).all():
            return d, q, k, "singular"
        for _ in range(6):  # a move that doesn't improve is halved
            new = patch.quality(d + move)
            if new > q:
                break
            move = move / 2
        if new <= q:
            if h > 0.001:
                h = 0.001
                continue
            return d, q, k, "no gain"
        gain, d, q = new - q, d + move, new
        if gain <= 0.01:
            if h <= 0.001 and gain < 1e-7:
                return d, q, k + 1, "low gain"
            h = 0.001
    return d, q, rounds, "iterations used up"


def spgd(patch: Patch, start: np.ndarray, seed: int, rounds: int = 200, gain: float = 100.0) -> tuple[np.ndarray, float, int, str]:
    """Steps along seeded random directions, as long as their two sides differ by; keeps the best point seen."""
    rng, c = np.random.Generator(np.random.PCG64(seed)), len(start)
    amplitude = np.array(AMPLITUDE[:c])
    d, best, top = start, start, patch.quality(start)
    scale = 1.0
    for k in range(rounds):
        if top >= 0.999:
            return best, top, k, "quality reached"
        p = (rng.random(c) * 2 - 1) * amplitude
        up, down = patch.qualities(np.stack((d + p, d - p)))
        move = np.clip(gain * scale * p * (up - down), -0.5, 0.5)
        new = patch.quality(d + move)
        if new > top:
            best, top, d = d + move, new, d + move
        else:
            scale *= 0.95
            d = best
    return best, top, rounds, "iterations used up"


def solve_patches(windows: DataFrame, keys: list[str], solver: str, order: int = 1, reach: int = 6, coarse_reach: int = 4, weight: float | None = None) -> DataFrame:
    """windows (see patch_windows) -> keys, deformation, quality, iterations, ended."""
    if solver not in SOLVERS:
        raise ValueError(f"unknown solver {solver}")
    higher, weighted = SOLVERS[solver]
    if (order > 0 and not higher) or (weight is not None and not weighted):
        raise ValueError(f"{solver} can't do that")
    length = (2, 6, 12)[order]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in windows.select(*keys).schema) + ", deformation array<double>, quality double, iterations int, ended string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                half = int(r.s)
                patch = Patch(r.f, r.w, half, reach, None if weight is None else max(1.0, np.floor(half * weight * 3.2 + 0.5)))
                start = np.concatenate((patch.coarse(coarse_reach), np.zeros(length - 2)))
                if solver == "SPGD":
                    seed = sum((int(getattr(r, k)) + 1) * 1_000_003**i for i, k in enumerate(keys)) % (1 << 32)
                    got = spgd(patch, start, seed)
                else:
                    got = newton(patch, start, "forward" if "FORWARD" in solver else "central", solver.endswith("_HE"))
                out.append((*[getattr(r, k) for k in keys], got[0].tolist(), got[1], got[2], got[3]))
            yield pd.DataFrame(out, columns=[*keys, "deformation", "quality", "iterations", "ended"])

    spread = max(2, windows.sparkSession.sparkContext.defaultParallelism)
    return windows.select(*keys, "s", "f", "w").repartition(4 * spread, *keys).mapInPandas(run, schema)
