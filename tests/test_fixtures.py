"""Literal expectations of the survey's fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import deformation, regions
from fieldloom.operators import exports, fields, mesh
from fieldloom.plans import adaptive, solvers, tracking
from fieldloom.sources import config, frames


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    ("limits", "counts"),
    [
        ([-1, 1, 1] * 2, [3, 3]), ([-1, 1, 1, 1, 1, 0], [3, 1]), ([-1, 1, 1] * 6, [3] * 6),
        ([-1, 1, 1, -1, -1, 0] + [-1, 1, 1] * 4 + [1, 1, 0] + [-1, 1, 1] * 5 + [-1, 1, 1], [3, 1, 3, 3, 3, 3, 1] + [3] * 6),
    ],
)
def test_counts(spark, limits, counts):
    df = spark.createDataFrame([([float(x) for x in limits],)], "l array<double>")
    got = df.select(deformation.axis_counts(F.col("l")).alias("c")).withColumn("t", deformation.total(F.col("c"))).first()
    total = 1
    for c in counts:
        total *= c
    assert (got.c, got.t) == (counts, total)


@pytest.mark.parametrize(("axes", "index", "want"), [(2, 0, [-1, -1]), (2, 7, [0, 1]), (2, 8, [1, 1]), (6, 0, [-1] * 6), (6, 20, [1, -1, 1, -1, -1, -1]), (6, 728, [1] * 6)])
def test_decode(spark, axes, index, want):
    df = spark.createDataFrame([([-1.0, 1.0, 1.0] * axes, index)], "l array<double>, i long")
    assert df.select(deformation.decode(F.col("i"), F.col("l"), deformation.axis_counts(F.col("l")))).first()[0] == want


def test_decode_rejects_negative(spark):
    df = spark.createDataFrame([([-1.0, 1.0, 1.0] * 2, -1)], "l array<double>, i long")
    with pytest.raises(Exception, match="negative"):
        df.select(deformation.decode(F.col("i"), F.col("l"), deformation.axis_counts(F.col("l")))).collect()


@pytest.mark.parametrize(("v", "norm"), [([], 0.0), ([3.0, 4.0], 5.0), ([-1.0, 2.0, 3.0, 1.0, 0.0, 1.0], 4.0)])
def test_norm(spark, v, norm):
    assert spark.createDataFrame([(v,)], "v array<double>").select(deformation.norm(F.col("v"))).first()[0] == norm


@pytest.mark.parametrize("n", [0, 1, 8])
def test_illegal_lengths(spark, n):
    with pytest.raises(Exception, match="illegal length"):
        spark.createDataFrame([([0.0] * n,)], "v array<double>").select(deformation.order(F.col("v"), deformation.VALUES)).collect()


def test_regions(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    one = spark.range(1)
    rect, circle = (0, 0, 12, 10), (5, 6, 5)
    checks = [(regions.rect_area(*lit(*a), *lit(*rect)), w) for a, w in (((1, 1, 2, 2), True), ((1, 1, 10, 10), True), ((1, 1, 13, 2), False))]
    checks += [(regions.rect_point(*lit(*p), *lit(*rect)), w) for p, w in (((5, 9), True), ((0, 0), True), ((10, 10), True), ((-1, 9), False), ((1, 11), False))]
    checks += [(regions.circle_area(*lit(*a), *lit(*circle)), w) for a, w in (((4, 4, 6, 6), True), ((1, 1, 5, 6), False), ((1, 1, 13, 18), False))]
    checks += [(regions.circle_point(*lit(*p), *lit(*circle)), w) for p, w in (((5, 9), True), ((0, 6), True), ((10, 6), True), ((-1, 9), False), ((1, 12), False))]
    assert list(one.select(*[c for c, _ in checks]).first()) == [w for _, w in checks]


ROI = "roi_id int, kind string, x1 double, y1 double, x2 double, y2 double, cx double, cy double, r double, s int"


@pytest.mark.parametrize(("box", "half", "spacing", "n"), [((75, 75, 103, 103), 14, 1, 1), ((75, 75, 103, 103), 13, 1, 9), ((75, 75, 103, 103), 9, 1, 121), ((75, 75, 103, 103), 8, 2, 36), ((85, 85, 95, 95), 6, 1, 0)])
def test_mesh_sizes(spark, box, half, spacing, n):
    rois = spark.createDataFrame([(1, "rect", *map(float, box), None, None, None, half)], ROI)
    assert mesh.equal(rois, spacing, 180, 180).count() == n


@pytest.mark.parametrize(("jump", "n"), [(0.25, 36), (2.0, 66)])
def test_adaptive_mesh(spark, jump, n):
    rois = spark.createDataFrame([(1, 75, 75, 103, 103, 8)], "roi_id int, x1 int, y1 int, x2 int, y2 int, s int")
    grid = spark.range(180 * 180).select((F.col("id") % 180).alias("x"), F.floor(F.col("id") / 180).alias("y"))
    previous = grid.withColumn("dx", F.when(F.col("x") >= 90, jump).otherwise(0.0)).withColumn("dy", F.lit(0.0))
    got = adaptive.refine(rois, previous, 2, 180, 180)
    assert got.count() == n


def test_adaptive_mesh_without_history(spark):
    rois = spark.createDataFrame([(1, 75, 75, 103, 103, 8)], "roi_id int, x1 int, y1 int, x2 int, y2 int, s int")
    assert adaptive.refine(rois, None, 2, 180, 180).count() == 36


@pytest.mark.parametrize(("d", "q", "want"), [([2.0, 0, 0, 0, 0, 0], 1.0, (2, 0, 100)), ([0, 2.0, 0, 0, 0, 0], 0.5, (0, 2, 75)), ([2.0, -2.0, 0, 0, 0, 0], 0.25, (2, -2, 62.5))])
def test_displacement(spark, d, q, want):
    res = spark.createDataFrame([(15.0, 15.0, 5, [float(x) for x in d], q)], "cx double, cy double, s int, deformation array<double>, quality double")
    v = fields.patch_votes(res, 0.25, 1).select("x", "y", "dx", "dy", F.col("quality").alias("q"))
    got = rows(fields.displacement(v, ["x", "y"]).select("dx", "dy", "quality"))
    assert len(got) == 121 and set(got) == {tuple(map(float, want))}


def test_low_quality_has_no_votes(spark):
    res = spark.createDataFrame([(15.0, 15.0, 5, [0.0] * 6, 0.2), (15.0, 15.0, 5, None, 0.9)], "cx double, cy double, s int, deformation array<double>, quality double")
    assert fields.patch_votes(res, 0.25, 1).count() == 0


def test_cumulative(spark):
    def step(d, q):
        g = spark.range(400).select((F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y"))
        return g.select("x", "y", F.lit(float(d)).alias("dx"), F.lit(float(d)).alias("dy"), F.lit(float(q)).alias("quality"))

    steps = [step(0, 100), step(0, 100), step(1, 50), step(1, 50)]
    for n, (d, q) in ((2, (0, 100)), (3, (1, 250 / 3)), (4, (2, 75))):
        out = fields.compose(steps[:n]).where("x < 18 and y < 18").select("dx", "dy", F.round("quality", 6)).distinct()
        assert rows(out) == [(float(d), float(d), round(q, 6))]


def test_composition_stops_at_a_hole(spark):
    one = spark.createDataFrame([(0, 0, 1.0, 0.0, 80.0), (5, 5, 3.0, 0.0, 60.0)], "x long, y long, dx double, dy double, quality double")
    two = spark.createDataFrame([(1, 0, 2.0, 1.0, 40.0)], "x long, y long, dx double, dy double, quality double")
    assert sorted(rows(fields.compose([one, two]))) == [(0, 0, 3.0, 1.0, 60.0, 2), (5, 5, 3.0, 0.0, 60.0, 1)]


def strain_of(spark, cells, mm):
    df = spark.createDataFrame([(x, y, float(u), float(v)) for (x, y), (u, v) in cells.items()], "x long, y long, dx double, dy double")
    return {(r.x, r.y): r for r in fields.strain(df, [], mm).collect()}


def test_strain_of_a_sparse_field(spark):
    got = strain_of(spark, {(1, 1): (0, 0), (2, 0): (0, 0), (2, 2): (2, 0.5), (2, 3): (2, 0), (3, 2): (0, 0)}, 1)
    assert {p for p, r in got.items() if r.exx is not None} == {(2, 2)}
    assert got[1, 1].err_u == 1.0


@pytest.mark.parametrize("u", [0, 5])
def test_strain_of_a_constant_field(spark, u):
    got = strain_of(spark, {(x, y): (u, u) for x in range(5) for y in range(5)}, 5)
    assert all(abs(r.exx) < 1e-9 and abs(r.eyy) < 1e-9 and abs(r.exy) < 1e-9 for r in got.values())


def test_strain_of_planes(spark):
    got = strain_of(spark, {(x, y): (x + 1, 1 - y / 2) for x in range(3) for y in range(3)}, 3)
    assert all(abs(r.exx - 100) < 1e-3 and abs(r.eyy + 50) < 1e-3 and abs(r.exy) < 1e-3 for r in got.values())
    got = strain_of(spark, {(x, y): (1 - y, 1 - x / 2) for x in range(3) for y in range(3)}, 3)
    assert all(abs(r.exx) < 1e-3 and abs(r.eyy) < 1e-3 and abs(r.exy + 75) < 1e-3 for r in got.values())


def test_collinear_window_has_no_strain(spark):
    got = strain_of(spark, {(x, 0): (x, 0) for x in range(5)}, 4)
    assert all(r.exx is None for r in got.values()) and got[2, 0].err_u == 0.0


def speckle(spark, d, size=40):
    """Two analytic frames, the second warped so that the patch at (20, 20) has the deformation d."""
    import numpy as np

    def level(x, y):
        return 120 + 40 * np.sin(0.55 * x + 0.2 * y) + 30 * np.cos(0.35 * y - 0.15 * x) + 20 * np.sin(0.9 * x) * np.cos(0.8 * y)

    c, (x, y) = size // 2, np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    d = np.concatenate((d, np.zeros(6 - len(d))))
    m = np.array([[1 + d[2], d[3]], [d[4], 1 + d[5]]])
    back = np.linalg.inv(m) @ np.stack([(x - c - d[0]).ravel(), (y - c - d[1]).ravel()])
    frames_ = []
    for g in (level(x, y), level(back[0] + c, back[1] + c).reshape(x.shape)):
        frames_.append(spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(x.ravel(), y.ravel(), g.ravel(), strict=True)], "x long, y long, g double"))
    subsets = spark.createDataFrame([(1, float(c), float(c), 8)], "subset_id int, cx double, cy double, s int")
    return subsets, *frames_


CASES = [[0, 0], [0.72, 0], [-0.25, 0.85], [0.5, -0.25, 0.05, 0, 0, -0.04], [1.0, 1.0, 0.0, 0.07, 0.05, 0.0]]


@pytest.mark.parametrize("solver", [s for s in solvers.SOLVERS if s.startswith("NEWTON")] + ["SPGD"])
def test_solvers_find_known_warps(spark, solver):
    near, rate = (0.2, 0.05) if solver == "SPGD" else (0.05, 0.02)  # the stochastic one ends at a correlation of 0.999
    for d in CASES:
        subsets, a, b = speckle(spark, d)
        got = solvers.solve_patches(solvers.patch_windows(subsets, a, b, ["subset_id"], 6), ["subset_id"], solver).first()
        want = d + [0] * (6 - len(d))
        close = all(abs(x - y) <= max(0.1 * abs(y), near if k < 2 else rate) for k, (x, y) in enumerate(zip(got.deformation, want, strict=True)))
        assert close, (solver, d, got)


def test_weighted_criterion_and_its_solver(spark):
    subsets, a, b = speckle(spark, [0.5, 0.25])
    got = solvers.solve_patches(solvers.patch_windows(subsets, a, b, ["subset_id"], 6), ["subset_id"], "SPGD", order=0, weight=0.75).first()
    assert got.quality > 0.95
    with pytest.raises(ValueError):
        solvers.solve_patches(solvers.patch_windows(subsets, a, b, ["subset_id"], 6), ["subset_id"], "NEWTON_RHAPSON_CENTRAL", weight=0.75)


def test_second_order(spark):
    subsets, a, b = speckle(spark, [0.3, 0.2])
    got = solvers.solve_patches(solvers.patch_windows(subsets, a, b, ["subset_id"], 6), ["subset_id"], "NEWTON_RHAPSON_CENTRAL_HE", order=2).first()
    assert len(got.deformation) == 12 and got.quality > 0.99


def test_tracked_jaws(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    level = rng.integers(0, 255, (70, 120))
    base = spark.createDataFrame([(x, y, int(level[x, y])) for x in range(70) for y in range(120)], "x long, y long, g long")
    seq = [base] + [base.select("x", (F.col("y") + k).alias("y"), "g") for k in (2, 4)]
    got = tracking.track(seq, [(1, 15.0, 20.0, 9.0), (2, 50.0, 20.0, 9.0), (3, 15.0, 90.0, 9.0), (4, 50.0, 90.0, 9.0)])
    assert {r.bottom_shift for r in got.collect()} == {2.0}
    with pytest.raises(ValueError):
        tracking.track(seq, [(1, 15.0, 20.0, 9.0)])


def test_images_round_trip(spark, tmp_path):
    import numpy as np

    for k in range(3):
        (tmp_path / f"f{k}.bmp").write_bytes(frames.encode_bmp(np.arange(35).reshape(5, 7) + k))
    got = frames.pixels(frames.read_images(spark, str(tmp_path))).where("frame_no = 2 and x = 6 and y = 4").collect()
    assert [r.g for r in got] == [36]
    with pytest.raises(ValueError):
        frames.loader_name("a.xyz")


def test_config_text(spark, tmp_path):
    (tmp_path / "t.config").write_text("# c\nPARAM_FPS = 2000\nPARAM_SUBSET_SIZE = abc\nPARAM_RESULT_QUALITY = 0,5\nROI_3 = 122.0;80.0;20.6-- -1.5; 1.5; 0.5--7;;1;2;3;4--NONE--NONE\nnonsense\n")
    lines = config.read_config(spark, str(tmp_path / "t.config"))
    assert sorted(rows(config.parameters(lines))) == [("FPS", "2000"), ("RESULT_QUALITY", "0,5")]
    assert rows(config.regions(lines).orderBy("roi_no")) == [(3, 0, "122.0;80.0;20.6", [-1.5, 1.5, 0.5], 7), (3, 1, "1;2;3;4", None, None)]
    fps = spark.createDataFrame([(0, "x"), (1, "Speed = [1500] fps")], "line_no int, value string")
    assert config.sidecar_fps(fps).first().fps == 1500
    assert config.sidecar_fps(fps.where("line_no = 0")).first().fps == 5000


def test_task_validation():
    task = config.validated({"IN": "x", "DEFORMATION_LIMITS": [0.0] * 36, "FILTER_KERNEL_SIZE": 4}, 7)
    assert (task["DEFORMATION_ORDER"], task["ROUND_LIMITS"], task["FILTER_KERNEL_SIZE"]) == ("SECOND", [0, 6], 5)
    for bad in ({}, {"IN": "x", "ROUND_LIMITS": [3, 1]}, {"IN": "x", "FPS": "a"}, {"IN": "x", "NO": 1}):
        with pytest.raises((ValueError, TypeError)):
            config.validated(bad, 7)


def test_export_sinks(spark, tmp_path):
    t = spark.createDataFrame([(0, 0, 0, 1.5), (0, 2, 0, -2.0), (1, 1, 1, 4.0)], "round int, x long, y long, value double")
    exports.write_sequence(t, str(tmp_path / "seq"), 3)
    assert {p.name: p.read_text() for p in (tmp_path / "seq").glob("*.csv")} == {"map-00.csv": "1.500000,NaN,-2.000000,\n", "map-01.csv": "NaN,4.000000,NaN,\n"}
    exports.write_map(t.where("round = 0").drop("round"), str(tmp_path / "map"), 3)
    assert spark.read.text(str(tmp_path / "map")).first()[0] == "1.500000,NaN,-2.000000,"


def test_no_finite_value(spark):
    t = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "value double")
    assert rows(exports.finite_range(t, [])) == [(0.0, 0.0)]
