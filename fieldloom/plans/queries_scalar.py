"""Scalar functions, predicates and regions as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import deformation, measures, regions, sampling
from ..operators import exports, mesh
from ..sources.tables import field, frame_a, half_up, r6, table
from .catalog import query

# --- deformation vectors; limits are made of lineitem's small integers -------------------------------------------

_LIMITS = "list_value(-l_linenumber, l_linenumber, (l_linenumber % 3) / 2.0, -1, l_suppkey % 5, 0.5)::DOUBLE[]"
_AXIS = "CASE WHEN lim[{2}] = 0 THEN 1 ELSE floor((lim[{1}] - lim[{0}]) / lim[{2}] + 0.5)::BIGINT + 1 END"
_NU, _NV = _AXIS.format(1, 2, 3), _AXIS.format(4, 5, 6)
_LIM_SQL = f"WITH l AS (SELECT l_orderkey, l_linenumber, {_LIMITS} AS lim FROM lineitem), c AS (SELECT *, {_NU} AS nu, {_NV} AS nv FROM l) "


def _limits(spark, sf_dir):
    n, q = F.col("l_linenumber"), F.col("l_suppkey") % 5
    lim = F.array(*[x.cast("double") for x in (-n, n, (n % 3) / 2.0, F.lit(-1), q, F.lit(0.5))])
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", lim.alias("lim"))
    counts = deformation.axis_counts(F.col("lim"))
    return df.withColumn("counts", counts)


@query("fn_def_count", _LIM_SQL + "SELECT l_orderkey, l_linenumber, nu AS n_u, nv AS n_v, nu * nv AS total FROM c")
def fn_def_count(spark, sf_dir):
    return _limits(spark, sf_dir).select("l_orderkey", "l_linenumber", F.get("counts", F.lit(0)).alias("n_u"), F.get("counts", F.lit(1)).alias("n_v"), deformation.total(F.col("counts")).alias("total"))


@query("fn_def_decode", _LIM_SQL + ", i AS (SELECT *, l_orderkey % (nu * nv) AS idx FROM c) SELECT l_orderkey, l_linenumber, idx, lim[1] + (idx % nu) * lim[3] AS u, lim[4] + ((idx // nu) % nv) * lim[6] AS v FROM i")
def fn_def_decode(spark, sf_dir):
    df = _limits(spark, sf_dir).withColumn("idx", F.col("l_orderkey") % deformation.total(F.col("counts")))
    d = df.withColumn("d", deformation.decode(F.col("idx"), F.col("lim"), F.col("counts")))
    return d.select("l_orderkey", "l_linenumber", "idx", F.get("d", F.lit(0)).alias("u"), F.get("d", F.lit(1)).alias("v"))


@query("fn_def_slice", "SELECT vec_id, (label % 10) AS idx, embedding[(label % 10) * 6 + 1]::DOUBLE AS first, embedding[(label % 10) * 6 + 6]::DOUBLE AS last, 6::INTEGER AS n FROM embeddings")
def fn_def_slice(spark, sf_dir):
    s = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 10).alias("idx"), deformation.slice_at(F.col("embedding"), F.col("label") % 10, 6).alias("s"))
    return s.select("vec_id", "idx", F.get("s", F.lit(0)).cast("double").alias("first"), F.get("s", F.lit(5)).cast("double").alias("last"), F.size("s").alias("n"))


@query("fn_def_max", _LIM_SQL + "SELECT l_linenumber, max(nu * nv) AS most FROM c GROUP BY l_linenumber")
def fn_def_max(spark, sf_dir):
    return _limits(spark, sf_dir).groupBy("l_linenumber").agg(F.max(deformation.total(F.col("counts"))).alias("most"))


@query(
    "fn_def_order",
    "WITH s AS (SELECT vec_id, vec_id % 40 AS n FROM embeddings) SELECT vec_id, CASE n WHEN 6 THEN 0 WHEN 18 THEN 1 WHEN 36 THEN 2 END AS by_limits, CASE n WHEN 2 THEN 0 WHEN 6 THEN 1 WHEN 12 THEN 2 END AS by_values FROM s",
)
def fn_def_order(spark, sf_dir):
    a = F.slice("embedding", F.lit(1), (F.col("vec_id") % 40).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", deformation.order(a, deformation.LIMITS, True).alias("by_limits"), deformation.order(a, deformation.VALUES, True).alias("by_values"))


@query("fn_def_abs", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) + 0 AS norm FROM embeddings")
def fn_def_abs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(deformation.norm(F.transform("embedding", lambda x: x.cast("double")))).alias("norm"))


_WARP = "WITH p AS (SELECT vec_id, unnest(generate_series(-2, 2)) AS o, list_transform(list_transform(embedding[1:12], lambda e: floor(e::DOUBLE * 16)), lambda e: e / 16) AS d FROM embeddings), q AS (SELECT vec_id, o, unnest(generate_series(-2, 2)) AS w, d FROM p) "
_PX = "10 + o + d[1] + d[3] * o + d[4] * w + d[7] * o * o / 2 + d[8] * w * w / 2 + d[9] * o * w"
_PY = "20 + w + d[2] + d[5] * o + d[6] * w + d[10] * o * o / 2 + d[11] * w * w / 2 + d[12] * o * w"


def _warped(spark, sf_dir):
    d = F.transform(F.slice("embedding", 1, 12), lambda e: F.floor(e.cast("double") * 16) / 16.0)
    subsets = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(10.0).alias("cx"), F.lit(20.0).alias("cy"), F.lit(2).alias("s"), d.alias("deformation"))
    pix = mesh.patch_pixels(subsets)
    px, py = deformation.warped(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"), F.col("deformation"), 2)
    return pix.select("vec_id", "x", "y", px.alias("px"), py.alias("py"))


@query("fn_deform", _WARP + f"SELECT vec_id, 10 + o AS x, 20 + w AS y, round({_PX}, 6) + 0 AS px, round({_PY}, 6) + 0 AS py FROM q")
def fn_deform(spark, sf_dir):
    return _warped(spark, sf_dir).select("vec_id", "x", "y", r6(F.col("px")).alias("px"), r6(F.col("py")).alias("py"))


@query("fn_deform_subset", _WARP + f"SELECT vec_id, count(*) AS n, round(min({_PX}), 6) + 0 AS min_x, round(max({_PX}), 6) + 0 AS max_x, round(min({_PY}), 6) + 0 AS min_y, round(max({_PY}), 6) + 0 AS max_y FROM q GROUP BY vec_id")
def fn_deform_subset(spark, sf_dir):
    w = _warped(spark, sf_dir)
    return w.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), *[r6(f(c)).alias(f"{n}_{c[1]}") for c in ("px", "py") for n, f in (("min", F.min), ("max", F.max))])


@query("fn_pixel_disp", _WARP + f"SELECT vec_id, 10 + o AS x, 20 + w AS y, round({_PX} - (10 + o), 6) + 0 AS dx, round({_PY} - (20 + w), 6) + 0 AS dy FROM q")
def fn_pixel_disp(spark, sf_dir):
    return _warped(spark, sf_dir).select("vec_id", "x", "y", r6(F.col("px") - F.col("x")).alias("dx"), r6(F.col("py") - F.col("y")).alias("dy"))


# --- intensities ------------------------------------------------------------------------------------------------

_POINTS = "pts AS (SELECT x AS id_x, y AS id_y, x + ((x + y) % 4) / 4.0::DOUBLE AS px, y + ((x * 3 + y) % 8) / 8.0::DOUBLE AS py FROM a), "


def _points(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return frame_a(spark, sf_dir).select(x.alias("id_x"), y.alias("id_y"), (x + ((x + y) % 4) / 4.0).alias("px"), (y + ((x * 3 + y) % 8) / 8.0).alias("py"))


def _sample_sql(taps: str, weights: str) -> str:
    return (
        ", " + _POINTS + f"t AS (SELECT id_x, id_y, floor(px)::BIGINT AS fx, floor(py)::BIGINT AS fy, px - floor(px) AS tx, py - floor(py) AS ty FROM pts), "
        f"k AS (SELECT unnest(generate_series({taps})) AS i), o AS (SELECT i, j FROM k, (SELECT i AS j FROM k)), "
        f"w AS (SELECT id_x, id_y, fx + i AS x, fy + j AS y, {weights} AS w FROM t, o), "
        "h AS (SELECT w.*, a.g FROM w LEFT JOIN a ON a.x = w.x AND a.y = w.y WHERE w <> 0) "
        "SELECT id_x, id_y, round(sum(w * g), 6) + 0 AS s FROM h GROUP BY id_x, id_y HAVING bool_and(g IS NOT NULL)"
    )


@query("fn_bilinear", _sample_sql("0, 1", "(CASE i WHEN 0 THEN 1 - tx ELSE tx END) * (CASE j WHEN 0 THEN 1 - ty ELSE ty END)"), "a")
def fn_bilinear(spark, sf_dir):
    return sampling.bilinear(_points(spark, sf_dir), frame_a(spark, sf_dir), ["id_x", "id_y"]).select("id_x", "id_y", r6(F.col("s")).alias("s"))


def _cubic(t: str, i: str) -> str:
    return f"(CASE {i} WHEN -1 THEN ((-0.5 * {t} + 1) * {t} - 0.5) * {t} WHEN 0 THEN (1.5 * {t} - 2.5) * {t} * {t} + 1 WHEN 1 THEN ((-1.5 * {t} + 2) * {t} + 0.5) * {t} ELSE (0.5 * {t} - 0.5) * {t} * {t} END)"


@query("fn_bicubic", _sample_sql("-1, 2", _cubic("tx", "i") + " * " + _cubic("ty", "j")), "a")
def fn_bicubic(spark, sf_dir):
    return sampling.bicubic(_points(spark, sf_dir), frame_a(spark, sf_dir), ["id_x", "id_y"]).select("id_x", "id_y", r6(F.col("s")).alias("s"))


def _blur_sql(size: int) -> str:
    kernel = sampling.gauss_kernel(size)
    rows = ", ".join(f"({i - len(kernel) // 2}, {w!r}::DOUBLE)" for i, w in enumerate(kernel))
    one = "{v} + t < 0 THEN -({v} + t) WHEN {v} + t >= n THEN 2 * (n - 1) - ({v} + t) ELSE {v} + t END"
    return (
        f", k(t, w) AS (VALUES {rows}), m AS (SELECT max(x) + 1 AS nx, max(y) + 1 AS ny FROM a), "
        "p AS (SELECT a.x, a.y, k.w, CASE WHEN " + one.format(v="x").replace(" n ", " nx ").replace("(n - 1)", "(nx - 1)") + " AS sx FROM a, k, m), "
        "h AS (SELECT p.x, p.y, sum(p.w * s.g) AS g FROM p JOIN a s ON s.x = p.sx AND s.y = p.y GROUP BY p.x, p.y), "
        "q AS (SELECT h.x, h.y, k.w, CASE WHEN " + one.format(v="y").replace(" n ", " ny ").replace("(n - 1)", "(ny - 1)") + " AS sy FROM h, k, m) "
        "SELECT q.x, q.y, round(sum(q.w * s.g), 6) + 0 AS g FROM q JOIN h s ON s.x = q.x AND s.y = q.sy GROUP BY q.x, q.y"
    )


@query("fn_gauss_blur", _blur_sql(5), "a")
def fn_gauss_blur(spark, sf_dir):
    return sampling.blur(frame_a(spark, sf_dir), 5).select("x", "y", r6(F.col("g")).alias("g"))


@query("fn_gray", ", c AS (SELECT x, y, g AS r, (g * 3) % 256 AS gg, (g * 7) % 256 AS b FROM a) SELECT x, y, (r + gg + b) // 3 AS grey FROM c", "a")
def fn_gray(spark, sf_dir):
    g = F.col("g")
    return frame_a(spark, sf_dir).select("x", "y", measures.grey(g, (g * 3) % 256, (g * 7) % 256).alias("grey"))


@query("fn_gauss_weight", ", o AS (SELECT x - 32 AS dx, (y % 41) - 20 AS dy FROM a) SELECT dx, dy, count(*) AS n, round(min(exp(-(dx * dx + dy * dy) / 288.0)), 6) + 0 AS w FROM o GROUP BY dx, dy", "a")
def fn_gauss_weight(spark, sf_dir):
    o = frame_a(spark, sf_dir).select((F.col("x") - 32).alias("dx"), (F.col("y") % 41 - 20).alias("dy"))
    return o.groupBy("dx", "dy").agg(F.count(F.lit(1)).alias("n")).withColumn("w", r6(measures.gauss_weight(F.col("dx"), F.col("dy"), F.lit(12.0))))


@query("fn_weight_width", "SELECT DISTINCT l_linenumber, floor(l_linenumber * 0.75::DOUBLE * 3.2::DOUBLE + 0.5)::BIGINT AS d0 FROM lineitem")
def fn_weight_width(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_linenumber").distinct().withColumn("d0", measures.weight_width(F.col("l_linenumber"), F.lit(0.75)))


# --- components, units, text ------------------------------------------------------------------------------------


@query("fn_disp_component", ", k(kind) AS (VALUES ('DX'), ('DY'), ('DABS')) SELECT round, x, y, kind, round(CASE kind WHEN 'DX' THEN dx WHEN 'DY' THEN dy ELSE sqrt(dx * dx + dy * dy) END, 6) + 0 AS value FROM field, k", "votes field")
def fn_disp_component(spark, sf_dir):
    f = field(spark, sf_dir).withColumn("kind", F.explode(F.array(*map(F.lit, ("DX", "DY", "DABS")))))
    return f.select("round", "x", "y", "kind", r6(measures.displacement(F.col("kind"), F.col("dx"), F.col("dy"))).alias("value"))


@query("fn_strain_component", ", k(kind) AS (VALUES ('EXX'), ('EYY'), ('EXY'), ('EABS')) SELECT round, x, y, kind, round(CASE kind WHEN 'EXX' THEN dx WHEN 'EYY' THEN dy WHEN 'EXY' THEN q ELSE sqrt(dx * dx + dy * dy + q * q) END, 6) + 0 AS value FROM field, k", "votes field")
def fn_strain_component(spark, sf_dir):
    f = field(spark, sf_dir).withColumn("kind", F.explode(F.array(*map(F.lit, ("EXX", "EYY", "EXY", "EABS")))))
    return f.select("round", "x", "y", "kind", r6(measures.strain(F.col("kind"), F.col("dx"), F.col("dy"), F.col("q"))).alias("value"))


@query("fn_speed_component", ", k(kind) AS (VALUES ('DX'), ('DY'), ('DABS')) SELECT round, x, y, 'R_' || kind AS kind, round((CASE kind WHEN 'DX' THEN dx WHEN 'DY' THEN dy ELSE sqrt(dx * dx + dy * dy) END) / (1000.0::DOUBLE / 5000), 6) + 0 AS value FROM field, k", "votes field")
def fn_speed_component(spark, sf_dir):
    f = field(spark, sf_dir).withColumn("kind", F.explode(F.array(*map(F.lit, ("DX", "DY", "DABS")))))
    return f.select("round", "x", "y", F.concat(F.lit("R_"), "kind").alias("kind"), r6(measures.speed(F.col("kind"), F.col("dx"), F.col("dy"), F.lit(5000))).alias("value"))


@query("fn_px_to_mm", " SELECT round, x, y, round(dx / 4.0, 6) + 0 AS dx, round(dy / 4.0, 6) + 0 AS dy FROM field", "votes field")
def fn_px_to_mm(spark, sf_dir):
    return field(spark, sf_dir).select("round", "x", "y", *[r6(measures.to_mm(F.col(c), F.lit(4.0))).alias(c) for c in ("dx", "dy")])


@query("fn_mm_ratio", "SELECT l_orderkey, l_linenumber, round(abs(l_partkey - l_suppkey) / l_quantity, 6) + 0 AS ratio FROM lineitem")
def fn_mm_ratio(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(measures.mm_ratio(F.col("l_suppkey"), F.col("l_partkey"), F.col("l_quantity"))).alias("ratio"))


@query("fn_time", "SELECT event_id, round(event_id * (1000.0::DOUBLE / 5000), 6) + 0 AS ms FROM events")
def fn_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", r6(measures.time_ms(F.col("event_id"), F.lit(5000))).alias("ms"))


@query("fn_format", "SELECT event_id, printf('%.2f', (event_id % 1000) / 4.0) AS dbl, CASE WHEN event_id < 100 THEN lpad(event_id::VARCHAR, 2, '0') ELSE event_id::VARCHAR END AS int FROM events")
def fn_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", measures.number_text((F.col("event_id") % 1000) / 4.0).alias("dbl"), measures.int_text(F.col("event_id")).alias("int"))


@query(
    "fn_roi_parse",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'circle' ELSE 'rect' END AS kind, CASE WHEN l_linenumber % 2 = 1 THEN least(l_partkey, l_suppkey)::DOUBLE END AS x1, CASE WHEN l_linenumber % 2 = 1 THEN greatest(l_partkey, l_suppkey)::DOUBLE END AS x2, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity + 0.5 END AS r FROM lineitem",
)
def fn_roi_parse(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    s = lambda c: F.col(c).cast("string")
    circle = F.concat_ws(";", s("l_partkey"), s("l_suppkey"), F.concat((F.col("l_quantity").cast("int")).cast("string"), F.lit(",5")))
    rect = F.concat_ws(" ; ", s("l_partkey"), F.lit("1"), s("l_suppkey"), F.lit("2"))
    return t.select("l_orderkey", "l_linenumber", regions.parse(F.when(F.col("l_linenumber") % 2 == 0, circle).otherwise(rect)).alias("p")).select("l_orderkey", "l_linenumber", "p.kind", "p.x1", "p.x2", "p.r")


@query("fn_subset_coord_count", "SELECT DISTINCT l_linenumber AS s, 2 * l_linenumber + 1 AS side, (2 * l_linenumber + 1) * (2 * l_linenumber + 1) AS area FROM lineitem")
def fn_subset_coord_count(spark, sf_dir):
    s = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(s.alias("s"), measures.side(s).alias("side"), measures.area(s).alias("area")).distinct()


# --- predicates -------------------------------------------------------------------------------------------------

_RECT = (10, 20, 40, 60)
_CIRC = (30.0, 50.0, 20.0)


@query("flt_rect_point", " SELECT x, y FROM a WHERE x BETWEEN 10 AND 40 AND y BETWEEN 20 AND 60", "a")
def flt_rect_point(spark, sf_dir):
    return frame_a(spark, sf_dir).where(regions.rect_point(F.col("x"), F.col("y"), *_RECT)).select("x", "y")


@query("flt_circle_point", " SELECT x, y FROM a WHERE (x - 30) * (x - 30) + (y - 50) * (y - 50) <= 400", "a")
def flt_circle_point(spark, sf_dir):
    return frame_a(spark, sf_dir).where(regions.circle_point(F.col("x"), F.col("y"), *_CIRC)).select("x", "y")


@query("flt_rect_area", " SELECT x, y FROM a WHERE x - 2 >= 10 AND y - 2 >= 20 AND x + 2 <= 40 AND y + 2 <= 60", "a")
def flt_rect_area(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return frame_a(spark, sf_dir).where(regions.rect_area(x - 2, y - 2, x + 2, y + 2, *_RECT)).select("x", "y")


@query("flt_circle_area", " SELECT x, y FROM a WHERE pow(abs(x - 30) + 2, 2) + pow(abs(y - 50) + 2, 2) <= 400", "a")
def flt_circle_area(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return frame_a(spark, sf_dir).where(regions.circle_area(x - 2, y - 2, x + 2, y + 2, *_CIRC)).select("x", "y")


@query("flt_image_bounds", ", size AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM a) SELECT x, y FROM a, size WHERE x - 3 >= 0 AND y - 3 >= 0 AND x + 3 < w AND y + 3 < h", "a")
def flt_image_bounds(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    a = frame_a(spark, sf_dir)
    size = a.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return a.join(F.broadcast(size)).where(regions.in_frame(x - 3, y - 3, x + 3, y + 3, F.col("w"), F.col("h"))).select("x", "y")  # one row


_ROIS = "rois(roi_id, kind, x1, y1, x2, y2, cx, cy, r) AS (VALUES (1, 'rect', 0, 0, 20, 30, NULL, NULL, NULL), (2, 'rect', 15, 25, 40, 60, NULL, NULL, NULL), (3, 'circle', NULL, NULL, NULL, NULL, 30.0, 80.0, 12.0))"


def _rois(spark):
    n = None
    rows = [(1, "rect", 0.0, 0.0, 20.0, 30.0, n, n, n), (2, "rect", 15.0, 25.0, 40.0, 60.0, n, n, n), (3, "circle", n, n, n, n, 30.0, 80.0, 12.0)]
    return spark.createDataFrame(rows, "roi_id int, kind string, x1 double, y1 double, x2 double, y2 double, cx double, cy double, r double")


_IN = "((kind = 'rect' AND a.x BETWEEN x1 AND x2 AND a.y BETWEEN y1 AND y2) OR (kind = 'circle' AND (a.x - cx) * (a.x - cx) + (a.y - cy) * (a.y - cy) <= r * r))"


@query("flt_roi_any", f", {_ROIS} SELECT x, y FROM a WHERE EXISTS (SELECT 1 FROM rois WHERE {_IN})", "a")
def flt_roi_any(spark, sf_dir):
    return frame_a(spark, sf_dir).join(F.broadcast(_rois(spark)), regions.point_in(F.col("x"), F.col("y")), "left_semi").select("x", "y")


@query("flt_subset_point", " SELECT a.x, a.y FROM a WHERE EXISTS (SELECT 1 FROM (SELECT 20 + 15 * unnest(generate_series(0, 2)) AS cx) WHERE abs(a.x - cx) <= 3 AND abs(a.y - 30) <= 3)", "a")
def flt_subset_point(spark, sf_dir):
    subsets = spark.range(3).select((F.col("id") * 15 + 20).cast("double").alias("cx"), F.lit(30.0).alias("cy"), F.lit(3).alias("s"))
    return frame_a(spark, sf_dir).join(F.broadcast(mesh.patch_pixels(subsets).select("x", "y")), ["x", "y"], "left_semi").select("x", "y")


@query("flt_subset_lines", "SELECT vec_id, vec_id - 4 AS low, vec_id + 4 AS high FROM embeddings WHERE vec_id - 4 <= 120 AND vec_id + 4 >= 100")
def flt_subset_lines(spark, sf_dir):
    s = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") - 4).alias("low"), (F.col("vec_id") + 4).alias("high"))
    return s.where((F.col("low") <= 120) & (F.col("high") >= 100))


@query("flt_quality", " SELECT round, x, y, q FROM votes WHERE q >= 0.75", "votes")
def flt_quality(spark, sf_dir):
    from ..sources.tables import votes

    return votes(spark, sf_dir).where("q is not null and q >= 0.75").select("round", "x", "y", "q")


@query("flt_valid_neighbor", ", size AS (SELECT max(x) AS w, max(y) AS h FROM field), o AS (SELECT i AS ox, j AS oy FROM (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j) WHERE i <> 0 OR j <> 0) SELECT f.round, f.x, f.y, count(*) AS neighbours FROM field f, o, size JOIN field g ON g.round = f.round AND g.x = f.x + ox AND g.y = f.y + oy WHERE f.x + ox BETWEEN 0 AND w AND f.y + oy BETWEEN 0 AND h GROUP BY f.round, f.x, f.y", "votes field")
def flt_valid_neighbor(spark, sf_dir):
    """How many of a cell's eight neighbours are in the frame and have data."""
    from ..operators import fields

    out = fields.window_sums(field(spark, sf_dir), ["round"], 1, {"n": F.lit(1)})
    return out.select("round", "x", "y", (F.col("n") - 1).cast("long").alias("neighbours")).where("neighbours > 0")


@query("flt_moved", " SELECT round, y, max(dx) AS bottom_left, min(dx) AS bottom_right FROM field GROUP BY round, y HAVING abs(max(dx)) > 0.5 OR abs(min(dx)) > 0.5", "votes field")
def flt_moved(spark, sf_dir):
    s = field(spark, sf_dir).groupBy("round", "y").agg(F.max("dx").alias("bottom_left"), F.min("dx").alias("bottom_right"))
    return s.where((F.abs("bottom_left") > 0.5) | (F.abs("bottom_right") > 0.5))


@query("flt_move_limit", " SELECT round, y, abs(max(dx) - min(dx)) > 3 AS mismatch FROM field GROUP BY round, y", "votes field")
def flt_move_limit(spark, sf_dir):
    return field(spark, sf_dir).groupBy("round", "y").agg((F.abs(F.max("dx") - F.min("dx")) > 3).alias("mismatch"))


@query("flt_coords_valid", " SELECT round, x, y FROM field WHERE x + dx BETWEEN 0 AND 11 AND y + dy BETWEEN 0 AND 23", "votes field")
def flt_coords_valid(spark, sf_dir):
    return field(spark, sf_dir).where((F.col("x") + F.col("dx")).between(0, 11) & (F.col("y") + F.col("dy")).between(0, 23)).select("round", "x", "y")


@query("flt_validate_task", "SELECT 0 AS round_lo, max(vec_id) AS round_hi, 10 AS subset_size, 5 AS spacing, 'NEWTON_RHAPSON_CENTRAL' AS solver, 0.25::DOUBLE AS min_quality, 5000 AS fps FROM embeddings")
def flt_validate_task(spark, sf_dir):
    from ..sources.config import validated

    last = table(spark, sf_dir, "embeddings").agg(F.max("vec_id").alias("last"))
    task = validated({"IN": "frames"}, frames=1)
    return last.select(F.lit(0).alias("round_lo"), F.col("last").alias("round_hi"), F.lit(task["SUBSET_SIZE"]).alias("subset_size"), F.lit(task["SUBSET_GENERATOR_PARAM"]).alias("spacing"), F.lit(task["SOLVER"]).alias("solver"), F.lit(task["RESULT_QUALITY"]).alias("min_quality"), F.lit(task["FPS"]).alias("fps"))


# --- names, colours, specs --------------------------------------------------------------------------------------


@query("exp_spec_parse", "SELECT DISTINCT l_linenumber AS n, 'MAP' AS mode, 'CSV' AS target, CASE WHEN l_linenumber % 2 = 0 THEN 'D_DY' ELSE 'EXX' END AS direction, 'out' || l_linenumber AS path, l_linenumber + 3 AS total FROM lineitem")
def exp_spec_parse(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("n")).distinct().select("n", exports.parse_spec(F.concat_ws(";", F.lit("MAP"), F.lit("CSV"), F.when(F.col("n") % 2 == 0, "null").otherwise("EXX"), F.concat(F.lit("out"), F.col("n").cast("string")), F.col("n").cast("string"), F.lit(" 3"))).alias("p"))
    return p.select("n", "p.mode", "p.target", "p.direction", "p.path", F.aggregate("p.arguments", F.lit(0), lambda a, x: a + x).alias("total"))


@query("exp_names", "SELECT event_id, printf('in-%02d-%s-%d.csv', event_id % 30, event_type, user_id) AS name FROM events")
def exp_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", exports.output_name([F.lit("in"), measures.int_text(F.col("event_id") % 30), F.col("event_type"), F.col("user_id").cast("string")], "csv").alias("name"))


@query("exp_clamp", " SELECT round, x, y, least(greatest(dx, -1.0), 1.5) AS value FROM field", "votes field")
def exp_clamp(spark, sf_dir):
    return field(spark, sf_dir).select("round", "x", "y", exports.clamped(F.col("dx"), -1.0, 1.5).alias("value"))


@query("exp_color", ", m AS (SELECT round, min(dx) AS lo, max(dx) AS hi FROM field GROUP BY round) SELECT f.round, x, y, CASE WHEN hi > lo THEN floor((dx - lo) / (hi - lo) * 1000) ELSE 500 END::BIGINT AS general, floor((dx / hi / 2 + 0.5) * 1000)::BIGINT AS absolute FROM field f JOIN m ON f.round = m.round WHERE dx / hi / 2 + 0.5 BETWEEN 0 AND 1", "votes field")
def exp_color(spark, sf_dir):
    f = field(spark, sf_dir)
    both = f.join(exports.finite_range(f, ["round"], "dx"), "round")
    out = both.select("round", "x", "y", exports.colour_index(F.col("dx"), F.col("low"), F.col("high")).alias("general"), exports.colour_index(F.col("dx"), F.col("low"), F.col("high"), absolute=True).alias("absolute"))
    return out.where("absolute is not null")


@query("ui_chart_map", "SELECT DISTINCT event_type, CASE event_type WHEN 'click' THEN 'EXX' WHEN 'view' THEN 'EYY' WHEN 'error' THEN 'EABS' WHEN 'signup' THEN 'D_EXX' ELSE 'EXY' END AS shown FROM events")
def ui_chart_map(spark, sf_dir):
    asked = {"click": "R_DX", "view": "DY", "error": "DABS", "signup": "D_DX", "purchase": "EXY"}
    mapping = F.create_map(*[F.lit(v) for k, d in asked.items() for v in (k, exports.CHART.get(d, d))])
    return table(spark, sf_dir, "events").select("event_type").distinct().withColumn("shown", F.element_at(mapping, F.col("event_type")))


@query("ui_click_fix", "SELECT event_id, round(user_id / 1.25::DOUBLE, 6) + 0 AS y FROM events")
def ui_click_fix(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", r6(F.col("user_id") / 1.25).alias("y"))


@query("fn_round", "SELECT event_id, floor(value - 250 + 0.5)::BIGINT AS r FROM events")
def fn_round(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", half_up(F.col("value") - 250).alias("r"))
