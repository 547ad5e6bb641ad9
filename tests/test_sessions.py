"""Sessions, batches, kernels, videos and seeded numbers on their own."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import seeded
from fieldloom.operators import correlate, fields
from fieldloom.plans import batches, generators, kernels, session, solvers, tasks, tracking
from fieldloom.sources import avi, settings


def test_a_session_stops_between_rounds(spark):
    run, heard = session.Session(spark), []

    def listen(event):
        heard.append((event.phase, event.round))
        if event.round == 2:
            run.stop()

    run.listeners.append(listen)
    done = run.run(range(5), lambda r: spark.range(r), lambda df, _: df.cache())
    assert sorted(done) == [0, 1] and heard[-1] == ("stopped", None) and run.stopped


@pytest.mark.parametrize(("error", "cause"), [(MemoryError(), "MEMORY_ERROR"), (FileNotFoundError("x"), "IO"), (ValueError("x"), "ILLEGAL_TASK_DATA"), (session.ComputationError(session.Cause.ILLEGAL_CONFIG), "ILLEGAL_CONFIG"), (RuntimeError("x"), "OPENCL_ERROR")])
def test_errors_say_their_cause(spark, error, cause):
    def fail(_):
        raise error

    with pytest.raises(session.ComputationError) as raised:
        session.Session(spark).run([1], fail, lambda df, _: df)
    assert raised.value.cause.name == cause


def test_batches(spark):
    patches = spark.range(10).select((F.col("id") % 2).alias("roi"), "id", (F.col("id") % 3 + 1).alias("s"))
    assert [b.count() for b in batches.each(batches.numbered(patches, ["roi"], "id"))] == [10]
    assert [b.count() for b in batches.each(batches.numbered(patches, ["roi"], "id", count=2))] == [4, 4, 2]
    sized = batches.numbered(patches, ["roi"], "id", limit=400, size=batches.patch_bytes(F.col("s"), F.lit(0)))
    assert sum(b.count() for b in batches.each(sized)) == 10 and sized.select("batch").distinct().count() > 1


def test_kernels(spark):
    specs = spark.createDataFrame([("ANY;ANY;ANY",), ("JAVA;ANY;ANY",)], "text string")
    got = kernels.expanded(specs, "text").select("text", kernels.text().alias("k")).collect()
    assert sum(r.text.startswith("ANY") for r in got) == 19 and [r.k for r in got if r.text.startswith("JAVA")] == ["JAVA;ARRAY;ZNCC"]


def test_video_round_trip():
    rng = np.random.default_rng(1)
    pictures = [rng.integers(0, 256, (5, 7)) for _ in range(4)]
    got = list(avi.decode(avi.encode(pictures, 25)))
    assert len(got) == 4 and all((g == p[:, :, None]).all() for g, p in zip(got, pictures, strict=True))
    assert list(avi.decode(avi.encode([], 25))) == []
    with pytest.raises(ValueError):
        list(avi.decode(b"no video"))


def test_settings(spark, tmp_path):
    path = str(tmp_path / "settings")
    assert {r.name: r.value for r in settings.load(spark, path).collect()} == settings.DEFAULTS
    settings.store(spark, path, {"COLOR_MAP": "a"}, 1)
    settings.store(spark, path, {"COLOR_MAP": "b", "other": "c"}, 2)
    assert {r.name: r.value for r in settings.load(spark, path).collect()} == {**settings.DEFAULTS, "COLOR_MAP": "b", "other": "c"}


def test_seeded_numbers(spark):
    got = np.array([r.u for r in spark.range(20000).select(seeded.unit([F.col("id") % 7, F.col("id")], 3).alias("u")).collect()])
    assert 0 <= got.min() and got.max() < 1 and abs(got.mean() - 0.5) < 0.02 and abs(np.corrcoef(got[1:], got[:-1])[0, 1]) < 0.05


def test_generators_by_name(spark):
    assert generators.select("RANDOM").name == "RANDOM" and generators.select("none such").name == "EQUAL"


def _random_frame(spark, width=80, height=70, seed=2):
    level = np.random.default_rng(seed).integers(0, 255, (width, height))
    return level, spark.createDataFrame([(x, y, int(level[x, y])) for x in range(width) for y in range(height)], "x long, y long, g long")


def test_scores_across_tiles(spark, monkeypatch):
    """Patches on the borders of tiles score as by hand."""
    level, a = _random_frame(spark)
    b = a.select((F.col("x") + 2).alias("x"), (F.col("y") - 1).alias("y"), "g")
    subsets = spark.createDataFrame([(k, float(5 + 7 * (k % 10)), float(5 + 6 * (k // 10)), 2 + k % 3) for k in range(100)], "subset_id int, cx double, cy double, s int")
    cands = solvers.integer_candidates(spark, -2, 2)
    whole = sorted(tuple(r) for r in correlate.integer_scores(subsets, cands, a, b, ["subset_id"]).collect())
    monkeypatch.setattr(correlate, "TILE", 8)
    assert sorted(tuple(r) for r in correlate.integer_scores(subsets, cands, a, b, ["subset_id"]).collect()) == whole
    best = {r.subset_id: (r.u, r.v, r.quality) for r in solvers.brute_force(subsets, cands, a, b, ["subset_id"]).collect()}
    assert best and set(best.values()) == {(2, -1, 1.0)}
    at = {(r[0], r[2], r[3]): r[4:] for r in whole}
    for k, u, v in ((11, 0, 0), (45, 2, -1), (57, -1, 2)):
        x, y, s = int(5 + 7 * (k % 10)), int(5 + 6 * (k // 10)), 2 + k % 3
        f, g = level[x - s : x + s + 1, y - s : y + s + 1], level[x - s + u - 2 : x + s + 1 + u - 2, y - s + v + 1 : y + s + 1 + v + 1]
        assert at[k, u, v] == (f.size, f.sum(), g.sum(), (f * f).sum(), (g * g).sum(), (f * g).sum())


def test_window_sums_across_tiles(spark, monkeypatch):
    cells = spark.createDataFrame([(x, y, float(x * y % 7), 0.0) for x in range(-9, 12) for y in range(-5, 9) if (x * 5 + y) % 4], "x long, y long, dx double, dy double")
    want = sorted((r.x, r.y, r.v) for r in fields.window_sums(cells, [], 2, {"v": F.col("dx")}).collect())
    monkeypatch.setattr(fields, "TILE", 4)
    got = sorted((r.x, r.y, r.v) for r in fields.window_sums(cells, [], 2, {"v": F.col("dx")}).collect())
    held = {(r.x, r.y): r.dx for r in cells.collect()}
    plain = sorted((x, y, sum(v for (a, b), v in held.items() if abs(a - x) <= 2 and abs(b - y) <= 2)) for x, y in held)
    assert got == want == plain


@pytest.mark.parametrize("solver", ["BRUTE_FORCE", "COARSE_FINE", "NEWTON_RHAPSON_CENTRAL_HE"])
def test_a_task_with_each_kind_of_solver(spark, solver):
    """Three frames that move by whole pixels: every round's field, and the first frame with the last."""
    _, a = _random_frame(spark, 60, 50)
    # smooth enough to be interpolated
    smooth = a.select("x", "y", (F.sin(F.col("x") * 0.5 + F.col("y") * 0.2) * 60 + F.cos(F.col("y") * 0.45 - F.col("x") * 0.1) * 50 + 120).alias("g"))
    frames = smooth.withColumn("frame_no", F.lit(0))
    for k, (u, v) in enumerate(((1, 0), (1, 1)), 1):
        frames = frames.unionByName(smooth.select((F.col("x") + u).alias("x"), (F.col("y") + v).alias("y"), "g", F.lit(k).alias("frame_no")))
    subsets = spark.createDataFrame([(k, 15.0 + 8 * (k % 4), 15.0 + 8 * (k // 4), 5) for k in range(12)], "subset_id int, cx double, cy double, s int")
    said: list[str] = []
    got = tasks.compute(frames, subsets, 2, solver=solver, strain_mm=4.0, listener=said.append)
    rows = got.groupBy("round_from", "round_to").agg(F.percentile("dx", 0.5).alias("u"), F.percentile("dy", 0.5).alias("v"), F.max(F.abs("exx")).alias("e")).collect()
    assert {(r.round_from, r.round_to): (round(r.u, 1), round(r.v, 1)) for r in rows} == {(0, 1): (1.0, 0.0), (1, 2): (0.0, 1.0), (0, 2): (1.0, 1.0)}
    assert said == ["solving", "composing", "strain"]


def test_tasks_and_tracking_refuse_what_they_cannot_do(spark):
    _, a = _random_frame(spark, 20, 20)
    one = a.withColumn("frame_no", F.lit(0))
    subsets = spark.createDataFrame([(0, 9.0, 9.0, 2)], "subset_id int, cx double, cy double, s int")
    for bad in (lambda: tasks.compute(one, subsets, 1, solver="no such"), lambda: tasks.compute(one, subsets, 1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(session.ComputationError) as raised:
        list(tracking.rounds([a, a], [(1, 5.0, 5.0, 2.0)]))
    assert raised.value.cause is session.Cause.NOT_ENOUGH_ROIS


def test_a_filtered_task(spark):
    _, a = _random_frame(spark, 40, 40)
    frames = a.withColumn("frame_no", F.lit(0)).unionByName(a.select((F.col("x") + 1).alias("x"), "y", "g").withColumn("frame_no", F.lit(1)))
    subsets = spark.createDataFrame([(0, 20.0, 20.0, 4)], "subset_id int, cx double, cy double, s int")
    got = tasks.compute(frames, subsets, 2, filter_size=3, strain_mm=2.0).select("dx", "dy").distinct().collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0)]
