"""Meshes, joins, aggregates, windows, fields and exports as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import deformation, measures, seeded
from ..operators import correlate, exports, fields, lookups, mesh, statistics
from ..sources.tables import field, frame_a, frame_b, r6, rois_of, table, votes
from . import generators, solvers
from .catalog import query
from .queries_scalar import _blur_sql

# --- the mesh of the whole frame: half size 3, spacing 8 ---------------------------------------------------------

_MESH = """, dim AS (SELECT max(y) + 1 AS h FROM a), subs AS (
  SELECT j * 7 + i AS subset_id, 3 + 8 * i AS cx, 3 + 8 * j AS cy
  FROM (SELECT unnest(generate_series(0, 6)) AS i), (SELECT unnest(generate_series(0, (SELECT floor((h - 6) / 8)::BIGINT - 1 FROM dim))) AS j)
  WHERE 3 + 8 * j + 3 < (SELECT h FROM dim))"""
_CANDS = ", cands AS (SELECT k AS cand_id, k % 5 - 2 AS u, k // 5 - 2 AS v FROM (SELECT unnest(generate_series(0, 24)) AS k))"
_OFFS = ", offs AS (SELECT ox, oy FROM (SELECT unnest(generate_series(-3, 3)) AS ox), (SELECT unnest(generate_series(-3, 3)) AS oy))"
_PIX = ", spot AS MATERIALIZED (SELECT subset_id, cx, cy, cx + ox AS x, cy + oy AS y FROM subs, offs), pix AS MATERIALIZED (SELECT p.subset_id, cx, cy, p.x, p.y, a.g AS f FROM spot p JOIN a ON a.x = p.x AND a.y = p.y)"
_MOM = ", moved AS MATERIALIZED (SELECT subset_id, cand_id, u, v, f, x + u AS mx, y + v AS my FROM pix, cands), mom AS MATERIALIZED (SELECT subset_id, cand_id, u, v, count(*) AS n, sum(f)::BIGINT AS sf, sum(g)::BIGINT AS sg, sum(f * f)::BIGINT AS sff, sum(g * g)::BIGINT AS sgg, sum(f * g)::BIGINT AS sfg FROM moved JOIN b ON b.x = mx AND b.y = my GROUP BY ALL HAVING count(*) = 49)"
_Q = "CASE WHEN n * sff - sf * sf <= 0 OR n * sgg - sg * sg <= 0 THEN 0.0::DOUBLE ELSE (n * sfg - sf * sg) / (sqrt((n * sff - sf * sf)::DOUBLE) * sqrt((n * sgg - sg * sg)::DOUBLE)) END"
_BASE = _MESH + _CANDS + _OFFS + _PIX + _MOM


_RANDOM = f""", tried AS (SELECT a, floor(0 + {seeded.unit_sql(["1", "a"], 7)} * 64)::BIGINT AS cx, floor(0 + {seeded.unit_sql(["1", "a"], 8)} * h)::BIGINT AS cy, h
  FROM (SELECT unnest(generate_series(0, 999)) AS a), dim), fit AS (SELECT cx, cy, min(a) AS a FROM tried WHERE cx - 3 >= 0 AND cy - 3 >= 0 AND cx + 3 <= 63 AND cy + 3 <= h - 1 GROUP BY cx, cy),
picked AS (SELECT a, row_number() OVER (ORDER BY a) - 1 AS subset_id, cx, cy FROM fit QUALIFY row_number() OVER (ORDER BY a) <= 50)"""


def _whole(spark, sf_dir):
    """One region a frame: all of it."""
    last = table(spark, sf_dir, "embeddings").agg(F.max("vec_id").cast("double").alias("y2"))
    none = F.lit(None).cast("double")
    return last.select(F.lit(1).alias("roi_id"), F.lit("rect").alias("kind"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(63.0).alias("x2"), "y2", none.alias("cx"), none.alias("cy"), none.alias("r"), F.lit(3).alias("s"))


def _mesh(spark, sf_dir):
    return mesh.equal(_whole(spark, sf_dir), 8, 64, F.col("y2") + 1)


def _scores(spark, sf_dir):
    return correlate.integer_scores(_mesh(spark, sf_dir), solvers.integer_candidates(spark, -2, 2), frame_a(spark, sf_dir), frame_b(spark, sf_dir), ["subset_id"])


@query("gen_equal", _MESH + " SELECT subset_id, cx::DOUBLE AS cx, cy::DOUBLE AS cy FROM subs", "a")
def gen_equal(spark, sf_dir):
    return _mesh(spark, sf_dir).select("subset_id", "cx", "cy")


@query("gen_select", "WITH u AS (SELECT DISTINCT label FROM embeddings) SELECT label, CASE label % 5 WHEN 0 THEN 'EQUAL' WHEN 1 THEN 'RANDOM' WHEN 2 THEN 'DYNAMIC' ELSE 'EQUAL' END AS method FROM u")
def gen_select(spark, sf_dir):
    """By name, the equal spacing if the name is unknown; each label's generator is run on the frame."""
    names = ["EQUAL", "RANDOM", "DYNAMIC", "no such", ""]
    labels = [r.label for r in table(spark, sf_dir, "embeddings").select("label").distinct().collect()]  # the ten labels
    used = {names[k % 5]: generators.select(names[k % 5]) for k in labels}
    whole = _whole(spark, sf_dir)
    good = {name for name, g in used.items() if not g.mesh(whole, 8, 64, F.col("y2") + 1).isEmpty()}
    return spark.createDataFrame([(k, used[names[k % 5]].name) for k in labels if names[k % 5] in good], "label int, method string")


@query("gen_random", _MESH + _RANDOM + " SELECT 1 AS roi_id, subset_id, cx::DOUBLE AS cx, cy::DOUBLE AS cy, 3 AS s FROM picked", "a")
def gen_random(spark, sf_dir):
    return mesh.random(_whole(spark, sf_dir), 50, 64, F.col("y2") + 1).withColumn("subset_id", F.col("subset_id").cast("long"))


@query("gen_candidates", "WITH r AS (SELECT DISTINCT label, label % 3 + 1 AS k FROM embeddings), c AS (SELECT label, k, unnest(generate_series(0, (2 * k + 1) * 3 - 1)) AS cand_id FROM r) SELECT label, cand_id, (-k + cand_id % (2 * k + 1))::DOUBLE AS u, (-0.5 + (cand_id // (2 * k + 1)) * 0.5)::DOUBLE AS v FROM c")
def gen_candidates(spark, sf_dir):
    k = (F.col("label") % 3 + 1).cast("double")
    lim = table(spark, sf_dir, "embeddings").select("label", F.array(-k, k, *map(F.lit, (1.0, -0.5, 0.5, 0.5))).alias("limits")).distinct()
    d = mesh.candidates(lim)
    return d.select("label", "cand_id", F.get("deformation", F.lit(0)).alias("u"), F.get("deformation", F.lit(1)).alias("v"))


def _stencil(spark, sf_dir, kind):
    d = F.array((F.col("vec_id") % 5).cast("double"), (F.col("vec_id") % 7).cast("double"))
    points = table(spark, sf_dir, "embeddings").select("vec_id", d.alias("deformation"))
    return mesh.stencil_table(points, kind, 2, 0.25).select("vec_id", "probe", F.get("deformation", F.lit(0)).alias("u"), F.get("deformation", F.lit(1)).alias("v"))


def _stencil_sql(shifts: list[tuple[float, float]]) -> str:
    rows = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(shifts))
    return f"WITH s(probe, du, dv) AS (VALUES {rows}) SELECT vec_id, probe, (vec_id % 5 + du)::DOUBLE AS u, (vec_id % 7 + dv)::DOUBLE AS v FROM embeddings, s"


_H = 0.25
_FORWARD = [(0, 0), (_H, 0), (0, _H), (2 * _H, 0), (_H, _H), (0, 2 * _H)]
_CENTRAL = [(0, 0), (_H, 0), (0, _H), (-_H, 0), (0, -_H), (2 * _H, 0), (_H, _H), (_H, _H), (0, 2 * _H), (-2 * _H, 0), (-_H, -_H), (-_H, -_H), (0, -2 * _H), (0, 0), (_H, -_H), (-_H, _H), (0, 0), (0, 0), (-_H, _H), (_H, -_H), (0, 0)]


@query("gen_stencil_nrc", _stencil_sql(_CENTRAL))
def gen_stencil_nrc(spark, sf_dir):
    return _stencil(spark, sf_dir, "central")


@query("gen_stencil_nrf", _stencil_sql(_FORWARD))
def gen_stencil_nrf(spark, sf_dir):
    return _stencil(spark, sf_dir, "forward")


@query("gen_stencil_spgd", f"WITH p AS (SELECT vec_id, 0.1 * (2 * {seeded.unit_sql(['vec_id', '0'], 11)} - 1) AS a, 0.1 * (2 * {seeded.unit_sql(['vec_id', '1'], 11)} - 1) AS b FROM embeddings), s(probe, sign) AS (VALUES (0, 0), (1, -1), (2, 1)) SELECT vec_id, probe, round(1 + sign * a, 6) + 0 AS u, round(-1 + sign * b, 6) + 0 AS v FROM p, s")
def gen_stencil_spgd(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.lit(1.0), F.lit(-1.0)).alias("deformation"))
    return mesh.spgd_stencil(points, ["vec_id"], 2, solvers.AMPLITUDE).select("vec_id", "probe", r6(F.get("deformation", F.lit(0))).alias("u"), r6(F.get("deformation", F.lit(1))).alias("v"))


# --- joins ------------------------------------------------------------------------------------------------------


@query("join_subset_candidate", _MESH + _CANDS + " SELECT subset_id, cand_id, cx + u AS x, cy + v AS y FROM subs, cands", "a")
def join_subset_candidate(spark, sf_dir):
    both = _mesh(spark, sf_dir).crossJoin(F.broadcast(solvers.integer_candidates(spark, -2, 2)))  # the generated grid of both, as the operator asks
    return both.select("subset_id", "cand_id", (F.col("cx") + F.col("u")).cast("long").alias("x"), (F.col("cy") + F.col("v")).cast("long").alias("y"))


@query("join_subset_pixel", _MESH + _OFFS + " SELECT subset_id, cx + ox AS x, cy + oy AS y FROM subs, offs", "a")
def join_subset_pixel(spark, sf_dir):
    return mesh.patch_pixels(_mesh(spark, sf_dir)).select("subset_id", "x", "y")


@query("join_pixel_frame", _BASE + " SELECT subset_id, cand_id, n, sf, sg, sff, sgg, sfg FROM mom", "a b")
def join_pixel_frame(spark, sf_dir):
    return _scores(spark, sf_dir).select("subset_id", "cand_id", "n", "sf", "sg", "sff", "sgg", "sfg")


@query("join_roi_subset", "WITH s AS (SELECT label AS roi_id, vec_id AS subset_id FROM embeddings), r AS (SELECT event_id AS subset_id, user_id % 10 AS roi_id, value FROM events) SELECT s.roi_id, s.subset_id, r.value FROM s JOIN r ON s.roi_id = r.roi_id AND s.subset_id = r.subset_id")
def join_roi_subset(spark, sf_dir):
    s = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("subset_id")).withColumnRenamed("label", "roi_id")
    r = table(spark, sf_dir, "events").select(F.col("event_id").alias("subset_id"), (F.col("user_id") % 10).cast("int").alias("roi_id"), "value")
    return lookups.zipped(s, r, ["roi_id", "subset_id"]).select("roi_id", "subset_id", "value")


_CONTAIN = """, n0 AS (SELECT max(y) + 1 AS height FROM a), rois AS (SELECT * FROM regions), base AS (
  SELECT rois.*, height, CASE kind WHEN 'circle' THEN cx - r ELSE x1 END AS bx, CASE kind WHEN 'circle' THEN cy - r ELSE y1 END AS bj,
    CASE kind WHEN 'circle' THEN 2 * r ELSE x2 - x1 + 1 END - 4 AS rw, CASE kind WHEN 'circle' THEN 2 * r ELSE y2 - y1 + 1 END - 4 AS rh FROM rois, n0
), n AS (SELECT *, CASE WHEN rw <= 0 THEN 0 WHEN rw < 3 THEN 1 ELSE floor(rw / 3) END::BIGINT AS nx, CASE WHEN rh <= 0 THEN 0 WHEN rh < 3 THEN 1 ELSE floor(rh / 3) END::BIGINT AS ny FROM base
), g AS (SELECT *, unnest(generate_series(0, nx - 1)) AS i FROM n), h AS (SELECT *, unnest(generate_series(0, ny - 1)) AS j FROM g
), p AS (SELECT roi_id, height, kind, x1, y1, x2, y2, cx AS ox, cy AS oy, r, j * nx + i AS subset_id, bx + 2 + 3 * i AS cx, bj + 2 + 3 * j AS cy FROM h)
SELECT roi_id, subset_id, cx::DOUBLE AS cx, cy::DOUBLE AS cy FROM p
WHERE cx - 2 >= 0 AND cy - 2 >= 0 AND cx + 2 < 64 AND cy + 2 < height
  AND CASE kind WHEN 'rect' THEN cx - 2 >= x1 AND cy - 2 >= y1 AND cx + 2 <= x2 AND cy + 2 <= y2
      ELSE pow(abs(cx - ox) + 2, 2) + pow(abs(cy - oy) + 2, 2) <= r * r END"""


@query("join_containment", _CONTAIN, "a regions")
def join_containment(spark, sf_dir):
    """Patches of every region of a table that lie in it and in the frame."""
    rois = rois_of(spark, sf_dir).join(F.broadcast(frame_a(spark, sf_dir).agg((F.max("y") + 1).alias("height"))))  # one row
    return mesh.equal(rois.withColumn("s", F.lit(2)), 3, 64, F.col("height")).select("roi_id", "subset_id", "cx", "cy")


_ASOF = ", l AS (SELECT f.round, f.x, f.y, s.dx AS v FROM field f ASOF LEFT JOIN (SELECT * FROM field WHERE q >= 0.6) s ON f.x = s.x AND f.y = s.y AND f.round >= s.round)"


def _asof(spark, sf_dir):
    """Each cell's last value of good quality, at or before each of its rounds."""
    f = field(spark, sf_dir)
    return lookups.carried(f.where("q >= 0.6").select("x", "y", "round", F.col("dx").alias("v")), f.select("x", "y", "round"), ["x", "y"], "v")


@query("join_asof_round", _ASOF + " SELECT round, x, y, v FROM l", "votes field")
def join_asof_round(spark, sf_dir):
    return _asof(spark, sf_dir)


@query("win_locf", _ASOF + " SELECT x, y, count(v) AS known, round(sum(v), 6) + 0 AS total FROM l GROUP BY x, y", "votes field")
def win_locf(spark, sf_dir):
    return _asof(spark, sf_dir).groupBy("x", "y").agg(F.count("v").alias("known"), r6(F.sum("v")).alias("total"))


@query("join_lookup_override", "WITH o AS (SELECT DISTINCT label, label + 4 AS size FROM embeddings WHERE label % 3 = 0) SELECT e.vec_id, coalesce(o.size, 10) AS size FROM embeddings e LEFT JOIN o ON o.label = e.label")
def join_lookup_override(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    own = e.where("label % 3 = 0").select("label", (F.col("label") + 4).alias("size")).distinct()
    return lookups.overridden(e, own, ["label"], {"size": 10}).select("vec_id", "size")


@query("win_round_pairs", "SELECT vec_id AS round_from, vec_id + 1 AS round_to FROM embeddings WHERE vec_id + 1 IN (SELECT vec_id FROM embeddings)")
def win_round_pairs(spark, sf_dir):
    return lookups.round_pairs(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_no")))


@query("join_neighbor_window", " SELECT f.round, f.x, f.y, count(*) AS n, round(sum(g.dx), 6) + 0 AS su FROM field f JOIN field g ON g.round = f.round AND abs(g.x - f.x) <= 2 AND abs(g.y - f.y) <= 2 GROUP BY f.round, f.x, f.y", "votes field")
def join_neighbor_window(spark, sf_dir):
    out = fields.window_sums(field(spark, sf_dir), ["round"], 2, {"n": F.lit(1), "su": F.col("dx")})
    return out.select("round", "x", "y", F.col("n").cast("long").alias("n"), r6(F.col("su")).alias("su"))


def _step(spark, sf_dir, k):
    f = field(spark, sf_dir).where(F.col("round") == k)
    return f.select("x", "y", "dx", "dy", (F.col("q") * 100).alias("quality"))


def _steps_sql(n: int) -> str:
    parts = ", w0 AS MATERIALIZED (SELECT x, y, x + dx AS px, y + dy AS py, q * 100 AS q, 1 AS n, true AS going FROM field WHERE round = 0)"
    for k in range(1, n):
        parts += f""", t{k} AS (SELECT x, y, floor(px)::BIGINT + i AS tx, floor(py)::BIGINT + j AS ty, (CASE i WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) * (CASE j WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) AS w
          FROM w{k - 1}, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j) WHERE going),
        s{k} AS (SELECT t.x, t.y, sum(w * dx) AS sx, sum(w * dy) AS sy, sum(w * q * 100) AS sq, bool_and(f.x IS NOT NULL) AS ok FROM t{k} t LEFT JOIN (SELECT * FROM field WHERE round = {k}) f ON f.x = t.tx AND f.y = t.ty WHERE w > 0 GROUP BY t.x, t.y),
        w{k} AS MATERIALIZED (SELECT w.x, w.y, CASE WHEN ok THEN px + sx ELSE px END AS px, CASE WHEN ok THEN py + sy ELSE py END AS py, CASE WHEN ok THEN w.q + sq ELSE w.q END AS q, n + CASE WHEN ok THEN 1 ELSE 0 END AS n, going AND coalesce(ok, false) AS going FROM w{k - 1} w LEFT JOIN s{k} s ON s.x = w.x AND s.y = w.y)"""
    return parts + f" SELECT x, y, round(px - x, 6) + 0 AS dx, round(py - y, 6) + 0 AS dy, round(q / n, 6) + 0 AS quality, n FROM w{n - 1}"


def _composed(spark, sf_dir, n):
    out = fields.compose([_step(spark, sf_dir, k) for k in range(n)])
    return out.select("x", "y", *[r6(F.col(c)).alias(c) for c in ("dx", "dy", "quality")], "n")


@query("join_compose", _steps_sql(2), "votes field")
def join_compose(spark, sf_dir):
    return _composed(spark, sf_dir, 2)


@query("fld_compose", _steps_sql(6), "votes field")
def fld_compose(spark, sf_dir):
    """Over all rounds that there are."""
    return _composed(spark, sf_dir, 6)


@query("win_cumulative", _steps_sql(3), "votes field")
def win_cumulative(spark, sf_dir):
    return _composed(spark, sf_dir, 3)


@query("agg_cumulative_quality", _steps_sql(3).replace(" SELECT x, y, round(px - x, 6) + 0 AS dx, round(py - y, 6) + 0 AS dy,", " SELECT x, y,"), "votes field")
def agg_cumulative_quality(spark, sf_dir):
    return _composed(spark, sf_dir, 3).select("x", "y", "quality", "n")


@query("fld_cascade", "WITH RECURSIVE h AS (SELECT DISTINCT label AS chain, vec_id % 7 AS round_from, vec_id % 7 + 1 + (vec_id * 5) % 3 AS round_to FROM embeddings UNION SELECT DISTINCT label, k, k + 1 FROM embeddings, (SELECT unnest(generate_series(0, 9)) AS k)), p AS (SELECT chain, 0::BIGINT AS src, (SELECT max(round_to) FROM h WHERE h.chain = c.chain AND round_from = 0 AND round_to <= 9) AS step FROM (SELECT DISTINCT chain FROM h) c UNION ALL SELECT p.chain, p.step, (SELECT max(round_to) FROM h WHERE h.chain = p.chain AND round_from = p.step AND round_to <= 9) FROM p WHERE p.step < 9) SELECT chain, src AS round_from, step AS round_to FROM p WHERE step IS NOT NULL")
def fld_cascade(spark, sf_dir):
    """In each chain of results, the path from round 0 to 9 by the longest result available next."""
    e = table(spark, sf_dir, "embeddings")
    have = e.select(F.col("label").alias("chain"), (F.col("vec_id") % 7).alias("round_from"), (F.col("vec_id") % 7 + 1 + (F.col("vec_id") * 5) % 3).alias("round_to"))
    steps = e.select(F.col("label").alias("chain")).distinct().select("chain", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("round_from"))
    return fields.cascades(have.unionByName(steps.withColumn("round_to", F.col("round_from") + 1)), ["chain"], 0, 9)


@query("join_point_pair", " SELECT p.round, p.y, q.dx - p.dx AS du, q.dy - p.dy AS dv FROM field p JOIN field q ON p.round = q.round AND p.y = q.y AND p.x = 2 AND q.x = 9", "votes field")
def join_point_pair(spark, sf_dir):
    f = field(spark, sf_dir)
    p, q = (f.where(F.col("x") == x).select("round", "y", F.col("dx").alias(f"dx{x}"), F.col("dy").alias(f"dy{x}")) for x in (2, 9))
    return p.join(q, ["round", "y"]).select("round", "y", (F.col("dx9") - F.col("dx2")).alias("du"), (F.col("dy9") - F.col("dy2")).alias("dv"))


_MODE = ", bins AS (SELECT round, x, y, floor(dx / 0.1 + 0.5)::BIGINT AS bx, floor(dy / 0.1 + 0.5)::BIGINT AS bj, count(*) AS n, sum(q) AS sq FROM votes GROUP BY ALL), mode AS MATERIALIZED (SELECT round, x, y, bx * 0.1::DOUBLE AS mx, bj * 0.1::DOUBLE AS my, n, sq FROM bins QUALIFY row_number() OVER (PARTITION BY round, x, y ORDER BY n DESC, sq DESC, bx, bj) = 1)"
_NEAR = ", near AS (SELECT v.* FROM votes v JOIN mode m ON m.round = v.round AND m.x = v.x AND m.y = v.y WHERE (dx - mx) * (dx - mx) + (dy - my) * (dy - my) <= 1 + 1e-9)"
_KEYS = ["round", "x", "y"]


@query("agg_mode2d", _MODE + " SELECT round, x, y, round(mx, 6) + 0 AS mx, round(my, 6) + 0 AS my, n AS votes, sq AS sum_q FROM mode", "votes")
def agg_mode2d(spark, sf_dir):
    return fields.mode2d(votes(spark, sf_dir), _KEYS).select(*_KEYS, r6(F.col("mx")).alias("mx"), r6(F.col("my")).alias("my"), "votes", "sum_q")


@query("join_modal_radius", _MODE + _NEAR + " SELECT round, x, y, count(*) AS n FROM near GROUP BY round, x, y", "votes")
def join_modal_radius(spark, sf_dir):
    v = votes(spark, sf_dir)
    near = v.join(fields.mode2d(v, _KEYS).select(*_KEYS, "mx", "my"), _KEYS)
    ex, ey = F.col("dx") - F.col("mx"), F.col("dy") - F.col("my")
    return near.where(ex * ex + ey * ey <= 1 + 1e-9).groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"))


_DISP = _MODE + _NEAR + ", disp AS MATERIALIZED (SELECT round, x, y, sum(dx * q) / sum(q) AS dx, sum(dy * q) / sum(q) AS dy, ((sum(q * q) / sum(q) + 1) / 2 * 100) AS quality FROM near GROUP BY round, x, y)"


@query("fld_displacement", _DISP + " SELECT round, x, y, round(dx, 6) + 0 AS dx, round(dy, 6) + 0 AS dy, round(quality, 6) + 0 AS quality FROM disp", "votes")
def fld_displacement(spark, sf_dir):
    return fields.displacement(votes(spark, sf_dir), _KEYS).select(*_KEYS, *[r6(F.col(c)).alias(c) for c in ("dx", "dy", "quality")])


@query("agg_weighted_mean", _DISP + " SELECT round, x, y, round(dx, 6) + 0 AS dx, round(dy, 6) + 0 AS dy FROM disp", "votes")
def agg_weighted_mean(spark, sf_dir):
    return fields.displacement(votes(spark, sf_dir), _KEYS).select(*_KEYS, r6(F.col("dx")).alias("dx"), r6(F.col("dy")).alias("dy"))


@query("agg_quality_pct", _DISP + " SELECT round, x, y, round(quality, 6) + 0 AS quality FROM disp", "votes")
def agg_quality_pct(spark, sf_dir):
    return fields.displacement(votes(spark, sf_dir), _KEYS).select(*_KEYS, r6(F.col("quality")).alias("quality"))


@query("join_triangle_edges", " SELECT f.round, f.x, f.y, g.dx - f.dx AS right_dx, h.dx - f.dx AS down_dx FROM field f JOIN field g ON g.round = f.round AND g.x = f.x + 1 AND g.y = f.y JOIN field h ON h.round = f.round AND h.x = f.x AND h.y = f.y + 1", "votes field")
def join_triangle_edges(spark, sf_dir):
    f = field(spark, sf_dir).select("round", "x", "y", "dx")
    right = f.select("round", (F.col("x") - 1).alias("x"), "y", F.col("dx").alias("rx"))
    down = f.select("round", "x", (F.col("y") - 1).alias("y"), F.col("dx").alias("bx"))
    return f.join(right, _KEYS).join(down, _KEYS).select(*_KEYS, (F.col("rx") - F.col("dx")).alias("right_dx"), (F.col("bx") - F.col("dx")).alias("down_dx"))


# --- criteria ---------------------------------------------------------------------------------------------------


@query("agg_mean_center", _MESH + _OFFS + _PIX + " SELECT subset_id, round(avg(f), 6) + 0 AS mean, round(sqrt((count(*) * sum(f * f) - sum(f) * sum(f))::DOUBLE / count(*)), 6) + 0 AS norm FROM pix GROUP BY subset_id", "a")
def agg_mean_center(spark, sf_dir):
    pix = mesh.patch_pixels(_mesh(spark, sf_dir)).join(frame_a(spark, sf_dir), ["x", "y"])
    return correlate.centred(pix.select("subset_id", F.col("g").alias("f"), "g"), ["subset_id"]).select("subset_id", r6(F.col("mf")).alias("mean"), r6(F.col("df")).alias("norm"))


@query("agg_zncc", _BASE + f" SELECT subset_id, cand_id, round({_Q}, 6) + 0 AS q FROM mom", "a b")
def agg_zncc(spark, sf_dir):
    return _scores(spark, sf_dir).select("subset_id", "cand_id", r6(correlate.zncc()).alias("q"))


_PAIRS = "WITH e AS (SELECT vec_id, unnest(generate_series(0, 63)) AS k, embedding FROM embeddings), pairs AS MATERIALIZED (SELECT p.vec_id, p.k, floor((p.embedding[p.k + 1]::DOUBLE + 0.6) * 200)::BIGINT AS f, floor((n.embedding[p.k + 1]::DOUBLE + 0.6) * 200)::BIGINT AS g, exp(-((p.k % 8 - 3.5) * (p.k % 8 - 3.5) + (p.k // 8 - 3.5) * (p.k // 8 - 3.5))::DOUBLE / 50) AS wf, exp(-((p.k % 8 - 3) * (p.k % 8 - 3) + (p.k // 8 - 3.5) * (p.k // 8 - 3.5))::DOUBLE / 50) AS wg FROM e p JOIN embeddings n ON n.vec_id = p.vec_id + 1), nrm AS MATERIALIZED (SELECT vec_id, avg(f) AS mf, avg(g) AS mg, sqrt((count(*) * sum(f * f) - sum(f) * sum(f))::DOUBLE / count(*)) AS df, sqrt((count(*) * sum(g * g) - sum(g) * sum(g))::DOUBLE / count(*)) AS dg FROM pairs GROUP BY vec_id)"


def _pairs(spark, sf_dir):
    """Vectors as 8 x 8 patches, each against the next."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "e"))
    e = e.select("vec_id", "k", F.floor((F.col("e").cast("double") + 0.6) * 200).alias("f"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), "k", F.col("f").alias("g"))
    i, j = F.col("k") % 8, F.floor(F.col("k") / 8)
    weight = lambda c: F.exp(-((i - c) * (i - c) + (j - 3.5) * (j - 3.5)) / 50.0)
    return e.join(nxt, ["vec_id", "k"]).withColumn("wf", weight(3.5)).withColumn("wg", weight(3.0))


@query("agg_znssd", _PAIRS + " SELECT p.vec_id, round(CASE WHEN max(df) = 0 OR max(dg) = 0 THEN 0 ELSE 1 - sum(pow((f - mf) / df - (g - mg) / dg, 2)) / 2 END, 6) + 0 AS q FROM pairs p JOIN nrm ON nrm.vec_id = p.vec_id GROUP BY p.vec_id")
def agg_znssd(spark, sf_dir):
    return correlate.znssd(_pairs(spark, sf_dir), ["vec_id"]).select("vec_id", r6(F.col("q")).alias("q"))


@query("agg_wznssd", _PAIRS + " SELECT p.vec_id, round(CASE WHEN max(df) = 0 OR max(dg) = 0 THEN 0 ELSE 1 - sum(pow((g - mg) / dg * wg - (f - mf) / df * wf, 2)) / sum(wg * wg) / 2 END, 6) + 0 AS q FROM pairs p JOIN nrm ON nrm.vec_id = p.vec_id GROUP BY p.vec_id")
def agg_wznssd(spark, sf_dir):
    return correlate.wznssd(_pairs(spark, sf_dir), ["vec_id"]).select("vec_id", r6(F.col("q")).alias("q"))


_BEST = _BASE + f", sc AS (SELECT *, round({_Q}, 9) AS q FROM mom), best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY subset_id ORDER BY q DESC, cand_id) = 1)"


@query("agg_argmax", _BEST + " SELECT subset_id, cand_id, round(q, 6) + 0 AS q FROM best", "a b")
def agg_argmax(spark, sf_dir):
    s = _scores(spark, sf_dir).withColumn("q", correlate.zncc())
    return correlate.best(s, ["subset_id"]).select("subset_id", "cand_id", r6(F.col("q")).alias("q"))


@query("top1_candidate", _BEST + " SELECT cand_id, count(*) AS n FROM best GROUP BY cand_id", "a b")
def top1_candidate(spark, sf_dir):
    s = _scores(spark, sf_dir).withColumn("q", correlate.zncc())
    return correlate.best(s, ["subset_id"]).groupBy("cand_id").agg(F.count(F.lit(1)).alias("n"))


@query("slv_brute", _BEST + " SELECT b.subset_id, cx::DOUBLE AS cx, cy::DOUBLE AS cy, u, v, round(q, 6) + 0 AS quality FROM best b JOIN subs s ON s.subset_id = b.subset_id", "a b")
def slv_brute(spark, sf_dir):
    subs = _mesh(spark, sf_dir)
    best = solvers.brute_force(subs, solvers.integer_candidates(spark, -2, 2), frame_a(spark, sf_dir), frame_b(spark, sf_dir), ["subset_id"])
    return subs.join(best, "subset_id").select("subset_id", "cx", "cy", "u", "v", r6(F.col("quality")).alias("quality"))


@query("join_best_to_global", _BEST + " SELECT b.subset_id, cx + u AS x, cy + v AS y FROM best b JOIN subs s ON s.subset_id = b.subset_id", "a b")
def join_best_to_global(spark, sf_dir):
    return slv_brute(spark, sf_dir).select("subset_id", (F.col("cx") + F.col("u")).cast("long").alias("x"), (F.col("cy") + F.col("v")).cast("long").alias("y"))


def _results(spark, sf_dir):
    return slv_brute(spark, sf_dir).select(F.lit(0).alias("round"), "subset_id", "cx", "cy", F.lit(3).alias("s"), F.array(F.col("u").cast("double"), F.col("v").cast("double")).alias("deformation"), "quality")


_RES = _BEST + ", res AS MATERIALIZED (SELECT b.subset_id, cx, cy, u, v, round(q, 6) AS quality FROM best b JOIN subs s ON s.subset_id = b.subset_id)"


@query("fld_votes", _RES + " SELECT subset_id, cx + ox AS x, cy + oy AS y, u::DOUBLE AS dx, v::DOUBLE AS dy, quality FROM res, offs WHERE quality >= 0.25", "a b")
def fld_votes(spark, sf_dir):
    v = fields.patch_votes(_results(spark, sf_dir), 0.25, 0)
    return v.select("subset_id", "x", "y", "dx", "dy", "quality")


@query("orc_round", _RES + ", vv AS (SELECT cx + ox AS x, cy + oy AS y, u::DOUBLE AS dx, v::DOUBLE AS dy, quality AS q FROM res, offs WHERE quality >= 0.25), bins AS (SELECT x, y, floor(dx / 0.1 + 0.5) AS bx, floor(dy / 0.1 + 0.5) AS bj, count(*) AS n, sum(q) AS sq FROM vv GROUP BY ALL), m AS (SELECT * FROM bins QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY n DESC, sq DESC, bx, bj) = 1) SELECT v.x, v.y, round(sum(dx * q) / sum(q), 6) + 0 AS dx, round(sum(dy * q) / sum(q), 6) + 0 AS dy, round((sum(q * q) / sum(q) + 1) / 2 * 100, 6) + 0 AS quality FROM vv v JOIN m ON m.x = v.x AND m.y = v.y WHERE pow(dx - bx * 0.1, 2) + pow(dy - bj * 0.1, 2) <= 1 + 1e-9 GROUP BY v.x, v.y", "a b")
def orc_round(spark, sf_dir):
    """Mesh, solver, votes and displacement of one round, in one plan."""
    v = fields.patch_votes(_results(spark, sf_dir), 0.25, 0).select("x", "y", "dx", "dy", F.col("quality").alias("q"))
    return fields.displacement(v, ["x", "y"]).select("x", "y", *[r6(F.col(c)).alias(c) for c in ("dx", "dy", "quality")])


# --- modes, strain, statistics ----------------------------------------------------------------------------------


@query("agg_mode1d", ", b AS (SELECT round, floor(dy / 0.5 + 0.5)::BIGINT AS b, count(*) AS n FROM votes GROUP BY ALL) SELECT round, b * 0.5::DOUBLE AS mode FROM b QUALIFY row_number() OVER (PARTITION BY round ORDER BY n DESC, b) = 1", "votes")
def agg_mode1d(spark, sf_dir):
    return fields.mode1d(votes(spark, sf_dir), ["round"], "dy", 0.5)


@query("agg_roi_shift", ", b AS (SELECT round, x, floor(dy / 0.5 + 0.5)::BIGINT AS b, count(*) AS n FROM votes WHERE q >= 0.5 GROUP BY ALL) SELECT round, x AS roi_id, b * 0.5::DOUBLE AS shift FROM b QUALIFY row_number() OVER (PARTITION BY round, x ORDER BY n DESC, b) = 1", "votes")
def agg_roi_shift(spark, sf_dir):
    good = votes(spark, sf_dir).where("q >= 0.5").withColumnRenamed("x", "roi_id")
    return fields.mode1d(good, ["round", "roi_id"], "dy", 0.5).withColumnRenamed("mode", "shift")


@query("agg_shift_combine", ", s AS (SELECT round, y, min(dx) AS l, max(dy) AS r FROM field GROUP BY round, y) SELECT round, y, CASE WHEN l < 0 OR r < 0 THEN least(l, r) ELSE greatest(l, r) END AS shift FROM s", "votes field")
def agg_shift_combine(spark, sf_dir):
    s = field(spark, sf_dir).groupBy("round", "y").agg(F.min("dx").alias("l"), F.max("dy").alias("r"))
    return s.select("round", "y", statistics.combined_shift(F.col("l"), F.col("r")).alias("shift"))


_STRAIN = """, sm AS (SELECT f.round, f.x, f.y, count(*) AS n, sum(g.x - f.x)::DOUBLE AS sx, sum(g.y - f.y)::DOUBLE AS sy, sum((g.x - f.x) * (g.x - f.x))::DOUBLE AS xx, sum((g.y - f.y) * (g.y - f.y))::DOUBLE AS yy, sum((g.x - f.x) * (g.y - f.y))::DOUBLE AS xy,
    sum(g.dx) AS u, sum(g.dy) AS v, sum((g.x - f.x) * g.dx) AS xu, sum((g.y - f.y) * g.dx) AS yu, sum((g.x - f.x) * g.dy) AS xv, sum((g.y - f.y) * g.dy) AS yv, sum(g.dx * g.dx) AS uu, sum(g.dy * g.dy) AS vv
  FROM field f JOIN field g ON g.round = f.round AND abs(g.x - f.x) <= {r} AND abs(g.y - f.y) <= {r} GROUP BY f.round, f.x, f.y
), ce AS (SELECT round, x, y, n, xx - sx * sx / n AS cxx, yy - sy * sy / n AS cyy, xy - sx * sy / n AS cxy, xu - sx * u / n AS cxu, yu - sy * u / n AS cyu, xv - sx * v / n AS cxv, yv - sy * v / n AS cyv, uu - u * u / n AS cuu, vv - v * v / n AS cvv FROM sm
), de AS (SELECT *, CASE WHEN abs(cxx * cyy - cxy * cxy) < 1e-9 THEN NULL ELSE cxx * cyy - cxy * cxy END AS det FROM ce
), co AS (SELECT *, (cxu * cyy - cyu * cxy) / det AS a1, (cyu * cxx - cxu * cxy) / det AS a2, (cxv * cyy - cyv * cxy) / det AS b1, (cyv * cxx - cxv * cxy) / det AS b2 FROM de
), st AS MATERIALIZED (SELECT round, x, y, CASE WHEN n > 3 THEN 100 * a1 END AS exx, CASE WHEN n > 3 THEN 100 * b2 END AS eyy, CASE WHEN n > 3 THEN 50 * (b1 + a2) END AS exy,
  CASE WHEN n <= 3 THEN 1 WHEN det IS NULL THEN 0 ELSE sqrt(greatest(cuu - a1 * cxu - a2 * cyu, 0) / (n - 3)) END AS err_u, CASE WHEN n <= 3 THEN 1 WHEN det IS NULL THEN 0 ELSE sqrt(greatest(cvv - b1 * cxv - b2 * cyv, 0) / (n - 3)) END AS err_v FROM co)"""
_ST = " SELECT round, x, y, round(exx + 1e-8, 5) + 0 AS exx, round(eyy + 1e-8, 5) + 0 AS eyy, round(exy + 1e-8, 5) + 0 AS exy, round(err_u + 1e-8, 5) + 0 AS err_u, round(err_v + 1e-8, 5) + 0 AS err_v FROM st"


def _r5(c):
    """Five decimals; nudged, so that what lies halfway but for rounding errors falls to one side on every engine."""
    return F.round(c + 1e-8, 5) + F.lit(0.0)


def _strain(spark, sf_dir, mm):
    out = fields.strain(field(spark, sf_dir), ["round"], mm)
    return out.select(*_KEYS, *[_r5(F.col(c)).alias(c) for c in ("exx", "eyy", "exy", "err_u", "err_v")])


@query("win_strain", _STRAIN.format(r=2) + _ST, "votes field")
def win_strain(spark, sf_dir):
    return _strain(spark, sf_dir, 4.0)


@query("fld_strain", _STRAIN.format(r=3) + _ST, "votes field")
def fld_strain(spark, sf_dir):
    return _strain(spark, sf_dir, 6.0)


@query("fld_strain_recompute", _STRAIN.format(r=1) + _ST, "votes field")
def fld_strain_recompute(spark, sf_dir):
    return _strain(spark, sf_dir, 2.0)


@query("agg_ols_plane", _STRAIN.format(r=2) + " SELECT round, x, y, round(exx + 1e-8, 5) + 0 AS exx, round(eyy + 1e-8, 5) + 0 AS eyy, round(exy + 1e-8, 5) + 0 AS exy FROM st", "votes field")
def agg_ols_plane(spark, sf_dir):
    return _strain(spark, sf_dir, 4.0).select(*_KEYS, "exx", "eyy", "exy")


@query("dbg_regression_map", _STRAIN.format(r=2) + " SELECT round, x, y, round(err_u + 1e-8, 5) + 0 AS err_u, round(err_v + 1e-8, 5) + 0 AS err_v FROM st", "votes field")
def dbg_regression_map(spark, sf_dir):
    return _strain(spark, sf_dir, 4.0).select(*_KEYS, "err_u", "err_v")


@query("agg_minmax", " SELECT round, min(dx) AS low, max(dx) AS high FROM field GROUP BY round", "votes field")
def agg_minmax(spark, sf_dir):
    return exports.finite_range(field(spark, sf_dir), ["round"], "dx")


@query("exp_minmax", " SELECT min(dy) AS low, max(dy) AS high FROM field", "votes field")
def exp_minmax(spark, sf_dir):
    return exports.finite_range(field(spark, sf_dir), [], "dy")


@query("agg_bad_ratio", " SELECT round, round(avg(CASE WHEN q IS NULL OR q < 0.5 THEN 1.0 ELSE 0.0 END), 6) + 0 AS ratio FROM votes GROUP BY round", "votes")
def agg_bad_ratio(spark, sf_dir):
    return statistics.bad_ratio(votes(spark, sf_dir).withColumnRenamed("q", "quality"), ["round"]).select("round", r6(F.col("ratio")).alias("ratio"))


def _vectors(spark, sf_dir):
    return votes(spark, sf_dir).select("round", F.concat_ws(";", measures.number_text(F.col("dx")), measures.number_text(F.col("dy"))).alias("deformation"), F.col("q").alias("quality"))


_VEC = ", vec AS (SELECT round, printf('%.2f', dx) || ';' || printf('%.2f', dy) AS deformation, q AS quality FROM votes)"


@query("agg_hist_deformation", _VEC + " SELECT round, deformation, count(*) FILTER (quality >= 0.75) AS good, count(*) FILTER (quality < 0.75) AS bad, count(*) AS n FROM vec GROUP BY round, deformation", "votes")
def agg_hist_deformation(spark, sf_dir):
    return statistics.deformation_usage(_vectors(spark, sf_dir), ["round"], 0.75)


@query("agg_hist_quality", _VEC + " SELECT floor(quality * 10)::BIGINT AS decile, deformation, count(*) AS n FROM vec GROUP BY ALL", "votes")
def agg_hist_quality(spark, sf_dir):
    return statistics.by_decile(_vectors(spark, sf_dir), [])


@query("srt_counts", _VEC + " SELECT deformation, count(*) AS n FROM vec GROUP BY ALL ORDER BY n, deformation", "votes")
def srt_counts(spark, sf_dir):
    return _vectors(spark, sf_dir).groupBy("deformation").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "deformation")




@query("agg_sum_times", "WITH s AS (SELECT event_type AS kernel, count(*) AS samples, sum(event_id % 97)::BIGINT AS total_ms FROM events GROUP BY event_type) SELECT * FROM s WHERE samples = (SELECT max(samples) FROM s)")
def agg_sum_times(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("kernel"), F.col("user_id").alias("workload"), (F.col("event_id") % 97).alias("ms"))
    return statistics.fastest(t)


@query("top1_platform", "WITH s AS (SELECT event_type AS kernel, sum(event_id % 97)::BIGINT AS total_ms FROM events GROUP BY event_type) SELECT kernel, total_ms FROM s ORDER BY total_ms, kernel LIMIT 1")
def top1_platform(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kernel")).agg(F.sum(F.col("event_id") % 97).alias("total_ms"))
    return t.orderBy("total_ms", "kernel").limit(1)


# --- exports ----------------------------------------------------------------------------------------------------


def _wide(spark, sf_dir):
    f = field(spark, sf_dir).withColumn("quality", F.col("q") * 100)
    return f.join(fields.strain(field(spark, sf_dir), ["round"], 4.0), _KEYS)


_WIDE = _STRAIN.format(r=2) + ", wide AS MATERIALIZED (SELECT f.round, f.x, f.y, dx, dy, q * 100 AS quality, exx, eyy, exy, err_u, err_v FROM field f JOIN st ON st.round = f.round AND st.x = f.x AND st.y = f.y)"


def _value_sql(name: str) -> str:
    kind, m, unit, _ = exports.DIRECTIONS[name]
    v = {"dabs": "sqrt(dx * dx + dy * dy)", "eabs": "sqrt(exx * exx + eyy * eyy + exy * exy)"}.get(m, m)
    if unit.startswith("mm"):
        v = f"({v}) / 4.0"
    if unit == "mm/ms":
        v = f"({v}) / (1000.0::DOUBLE / 5000)"
    return v


_ALL = " UNION ALL ".join(f"SELECT round, x, y, '{d}' AS direction, round({_value_sql(d)} + 1e-8, 5) + 0 AS value FROM wide" for d in exports.DIRECTIONS)


@query("exp_map", _WIDE + f", al AS ({_ALL}) SELECT * FROM al", "votes field")
def exp_map(spark, sf_dir):
    """All 23 directions; the same table serves as cumulative and incremental field here."""
    w = _wide(spark, sf_dir)
    v = exports.values(w, w, list(exports.DIRECTIONS), 4.0, 5000.0)
    return v.withColumn("value", _r5(F.col("value")))


_SOME = ["DX", "D_DABS", "EXX", "Q_D"]


@query("exp_point", _WIDE + ", p AS (SELECT * FROM wide WHERE x = 5 AND y = 11) SELECT round, " + ", ".join(f'round(coalesce({_value_sql(d)}, 0) + 1e-8, 5) + 0 AS "{d}"' for d in _SOME) + " FROM p", "votes field")
def exp_point(spark, sf_dir):
    w = _wide(spark, sf_dir)
    out = exports.point_series(exports.values(w, w, _SOME, 4.0), _SOME, 5, 11)
    return out.select("round", *[_r5(F.col(d)).alias(d) for d in _SOME])


@query("win_series", " SELECT x, y, round, dx - lag(dx) OVER (PARTITION BY x, y ORDER BY round) AS change FROM field", "votes field")
def win_series(spark, sf_dir):
    return field(spark, sf_dir).select("x", "y", "round", (F.col("dx") - F.lag("dx").over(W.partitionBy("x", "y").orderBy("round"))).alias("change"))


_EXT = ", p AS (SELECT a.round, (b.dx - a.dx) * 100 / 7.0::DOUBLE AS exx, (b.dy - a.dy) * 100 / 12.0::DOUBLE AS eyy, ((b.dx - a.dx) / 12.0::DOUBLE + (b.dy - a.dy) / 7.0::DOUBLE) * 50 AS exy FROM field a JOIN field b ON a.round = b.round AND a.x = 2 AND a.y = 6 AND b.x = 9 AND b.y = 18)"


@query("exp_double_point", _EXT + " SELECT round, round(exx, 6) + 0 AS exx, round(eyy, 6) + 0 AS eyy, round(exy, 6) + 0 AS exy, round(sqrt(exx * exx + eyy * eyy + exy * exy), 6) + 0 AS eabs FROM p", "votes field")
def exp_double_point(spark, sf_dir):
    out = exports.extensometer(field(spark, sf_dir), (2, 6), (9, 18))
    return out.select("round", *[r6(F.col(c)).alias(c) for c in ("exx", "eyy", "exy", "eabs")])


@query("exp_sequence", " SELECT round, x, y, round(dx / 4.0, 6) + 0 AS value FROM field", "votes field")
def exp_sequence(spark, sf_dir):
    f = field(spark, sf_dir)
    return exports.values(f, f, ["DX"], 4.0).select(*_KEYS, r6(F.col("value")).alias("value"))


@query("exp_stretch", ", d AS (SELECT y, y / 1.25::DOUBLE AS p FROM (SELECT unnest(generate_series(0, 23)) AS y)), r AS (SELECT y, floor(p)::BIGINT AS lo, ceil(p)::BIGINT AS hi, p - floor(p) AS t FROM d WHERE ceil(p) <= 23) SELECT l.round, l.x, r.y, round(l.dx * (1 - t) + h.dx * t, 6) + 0 AS value FROM r JOIN field l ON l.y = r.lo JOIN field h ON h.y = r.hi AND h.x = l.x AND h.round = l.round", "votes field")
def exp_stretch(spark, sf_dir):
    f = field(spark, sf_dir).select(*_KEYS, F.col("dx").alias("value"))
    return exports.stretched(f, 1.25, 24, ["round"]).select(*_KEYS, r6(F.col("value")).alias("value"))




@query("exp_csv_map", ", k AS (SELECT DISTINCT round, y FROM field), c AS (SELECT k.round, k.y, i FROM k, (SELECT unnest(generate_series(0, 11)) AS i)) SELECT c.round, c.y, string_agg(coalesce(printf('%.6f', f.dx), 'NaN'), ',' ORDER BY i) || ',' AS line FROM c LEFT JOIN field f ON f.round = c.round AND f.y = c.y AND f.x = c.i GROUP BY c.round, c.y", "votes field")
def exp_csv_map(spark, sf_dir):
    return exports.csv_rows(field(spark, sf_dir).select(*_KEYS, F.col("dx").alias("value")), 12, ["round"])


@query("exp_csv_point", " SELECT printf('%.2f', (round + 1) * 0.25) AS time, printf('%.3f', floor(dx * 1000 + 0.5) / 1000) AS dx, printf('%.3f', floor(dy * 1000 + 0.5) / 1000) AS dy FROM field WHERE x = 5 AND y = 11", "votes field")
def exp_csv_point(spark, sf_dir):
    at = field(spark, sf_dir).where("x = 5 and y = 11")
    return at.select(measures.number_text(measures.time_ms(F.col("round") + 1, F.lit(4000))).alias("time"), *[F.format_string("%.3f", F.floor(F.col(c) * 1000 + 0.5) / 1000.0).alias(c) for c in ("dx", "dy")])


@query("exp_csv_keyed", " SELECT x, y, " + ", ".join(f'max(dx) FILTER (round = {k}) AS "{k}"' for k in range(6)) + " FROM field GROUP BY x, y", "votes field")
def exp_csv_keyed(spark, sf_dir):
    return exports.keyed(field(spark, sf_dir), ["x", "y"], "round", "dx", list(range(6)))


@query("exp_csv_shifts", ", s AS (SELECT round, max(dy) AS s FROM field GROUP BY round) SELECT printf('%.2f', (round + 1) * 0.2) AS time, round(s / 4.0, 6) + 0 AS shift_mm FROM s", "votes field")
def exp_csv_shifts(spark, sf_dir):
    s = field(spark, sf_dir).groupBy("round").agg(F.max("dy").alias("s"))
    return s.select(measures.number_text(measures.time_ms(F.col("round") + 1, F.lit(5000))).alias("time"), r6(measures.to_mm(F.col("s"), F.lit(4.0))).alias("shift_mm"))


# --- diagnostics ------------------------------------------------------------------------------------------------


@query("dbg_raw_dump", _BASE + f" SELECT subset_id, cand_id, u, v, round({_Q}, 6) + 0 AS q FROM mom", "a b")
def dbg_raw_dump(spark, sf_dir):
    """Every candidate's value of every patch."""
    return _scores(spark, sf_dir).select("subset_id", "cand_id", "u", "v", r6(correlate.zncc()).alias("q"))


@query("dbg_subset_quality", _RES + " SELECT cx AS x, cy AS y, quality FROM res", "a b")
def dbg_subset_quality(spark, sf_dir):
    return slv_brute(spark, sf_dir).select(F.floor(F.col("cx") + 0.5).alias("x"), F.floor(F.col("cy") + 0.5).alias("y"), "quality")


@query("dbg_point_quality", " SELECT round, x, y, q * 100 AS quality FROM field", "votes field")
def dbg_point_quality(spark, sf_dir):
    return field(spark, sf_dir).select(*_KEYS, (F.col("q") * 100).alias("quality"))


@query("dbg_votes_dump", " SELECT round, round(floor(dx / 0.1 + 0.5) * 0.1, 6) + 0 AS dx, round(floor(dy / 0.1 + 0.5) * 0.1, 6) + 0 AS dy, q FROM votes WHERE x = 5 AND y = 11", "votes")
def dbg_votes_dump(spark, sf_dir):
    bin_ = lambda c: r6(F.floor(F.col(c) / 0.1 + 0.5) * 0.1).alias(c)
    return votes(spark, sf_dir).where("x = 5 and y = 11").select("round", bin_("dx"), bin_("dy"), "q")


# --- tracked fixtures -------------------------------------------------------------------------------------------

_JAWS = """WITH c AS (SELECT c_custkey AS specimen FROM customer), j AS (
  SELECT specimen, (i + specimen) % 4 + 1 AS roi_id, (46 + 79 * (i % 2) + specimen % 7)::DOUBLE AS cx, (16 + 72 * (i // 2) + (specimen * 3 + i) % 5)::DOUBLE AS cy, 19.0::DOUBLE AS r
  FROM c, (SELECT unnest(generate_series(0, 3)) AS i) WHERE NOT (specimen % 5 = 0 AND i = 3)), ok AS (SELECT * FROM j WHERE specimen % 5 <> 0)"""


def _jaws(spark, sf_dir):
    """Four circles a specimen, in any order; every fifth specimen lacks one."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("specimen"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).where("not (specimen % 5 = 0 and i = 3)")
    s, i = F.col("specimen"), F.col("i")
    return c.select("specimen", ((i + s) % 4 + 1).alias("roi_id"), (46 + 79 * (i % 2) + s % 7).cast("double").alias("cx"), (16 + 72 * F.floor(i / 2) + (s * 3 + i) % 5).cast("double").alias("cy"), F.lit(19.0).alias("r"))


def _whole_jaws(spark, sf_dir):
    from . import tracking

    jaws = _jaws(spark, sf_dir)
    return jaws.join(tracking.valid(jaws, ["specimen"]).where("valid"), "specimen", "left_semi")


@query("orc_roi_sort", f"{_JAWS}, b AS (SELECT *, EXISTS (SELECT 1 FROM ok o WHERE o.specimen = ok.specimen AND o.roi_id <> ok.roi_id AND o.cy < ok.cy AND o.cy + o.r < ok.cy - ok.r) AS low FROM ok) SELECT specimen, roi_id, row_number() OVER (PARTITION BY specimen ORDER BY low, cx) AS place FROM b")
def orc_roi_sort(spark, sf_dir):
    from . import tracking

    return tracking.sorted_jaws(_whole_jaws(spark, sf_dir), ["specimen"]).select("specimen", "roi_id", "place")


@query("srt_roi", f"{_JAWS} SELECT specimen, roi_id, cx FROM j ORDER BY specimen, cx, roi_id")
def srt_roi(spark, sf_dir):
    return _jaws(spark, sf_dir).select("specimen", "roi_id", "cx").orderBy("specimen", "cx", "roi_id")


@query("orc_rect_default", f"{_JAWS}, b AS (SELECT *, cy > 50 AS low, cx > 80 AS rightmost FROM ok) SELECT specimen, min(cx + r) FILTER (NOT rightmost) + 5 AS x1, min(cx - r) FILTER (rightmost) - 5 AS x2, min(cy - r) FILTER (NOT low) AS y1, min(cy + r) FILTER (low) AS y2 FROM b GROUP BY specimen")
def orc_rect_default(spark, sf_dir):
    from . import tracking

    return tracking.default_rectangle(_whole_jaws(spark, sf_dir), ["specimen"])


@query("orc_validate", f"{_JAWS} SELECT specimen, count(*) = 4 AS valid FROM j GROUP BY specimen")
def orc_validate(spark, sf_dir):
    from . import tracking

    return tracking.valid(_jaws(spark, sf_dir), ["specimen"])


@query("orc_increase", "SELECT DISTINCT l_linenumber, -l_linenumber - (((2 * l_linenumber) / 0.5 + 1)::BIGINT // 4) * 0.5::DOUBLE AS lo, l_linenumber + (((2 * l_linenumber) / 0.5 + 1)::BIGINT // 4) * 0.5::DOUBLE AS hi FROM lineitem")
def orc_increase(spark, sf_dir):
    from . import tracking

    n = F.col("l_linenumber").cast("double")
    lim = F.array(-n, n, F.lit(0.5))
    w = table(spark, sf_dir, "lineitem").select("l_linenumber", tracking.widened(lim).alias("w")).distinct()
    return w.select("l_linenumber", F.get("w", F.lit(0)).alias("lo"), F.get("w", F.lit(1)).alias("hi"))


@query("orc_scenario", "SELECT * FROM (VALUES ('default', 5), ('precise', 1), ('coarse', 10)) t(scenario, spacing)")
def orc_scenario(spark, sf_dir):
    from ..sources.config import SCENARIOS

    return spark.createDataFrame(list(SCENARIOS.items()), "scenario string, spacing int")


@query("eng_kernel_enum", "WITH t AS (SELECT * FROM (VALUES ('CL1D'), ('CL2D'), ('CL15D'), ('JAVA')) t(type)), i AS (SELECT * FROM (VALUES ('ARRAY'), ('IMAGE')) t(input)), c AS (SELECT * FROM (VALUES ('ZNCC'), ('ZNSSD'), ('WZNSSD')) t(criterion)), w AS (SELECT DISTINCT label AS spec, CASE label % 3 WHEN 0 THEN 'ANY' WHEN 1 THEN 'JAVA' ELSE 'CL2D' END AS wt, CASE label % 2 WHEN 0 THEN 'ANY' ELSE 'ZNCC' END AS wc FROM embeddings) SELECT spec, type || ';' || input || ';' || criterion AS kernel FROM w, t, i, c WHERE (wt = 'ANY' OR wt = type) AND (wc = 'ANY' OR wc = criterion) AND NOT (type = 'JAVA' AND (input = 'IMAGE' OR criterion <> 'ZNCC'))")
def eng_kernel_enum(spark, sf_dir):
    """What specifications with wildcards stand for."""
    from . import kernels

    label = F.col("label")
    spec = F.concat_ws(";", F.when(label % 3 == 0, "ANY").when(label % 3 == 1, "JAVA").otherwise("CL2D"), F.lit("ANY"), F.when(label % 2 == 0, "ANY").otherwise("ZNCC"))
    specs = table(spark, sf_dir, "embeddings").select(label.alias("spec"), spec.alias("text")).distinct()
    return kernels.expanded(specs, "text").select("spec", kernels.text().alias("kernel"))


@query("eng_kernel_text", "SELECT DISTINCT event_type || ';ARRAY;ZNCC;YES;NO' AS text, event_type AS type, 'ARRAY' AS input, 'ZNCC' AS criterion, 'YES' AS limits, 'NO' AS weighted FROM events")
def eng_kernel_text(spark, sf_dir):
    """To text and back."""
    from . import kernels

    fields_ = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.lit("ARRAY").alias("input"), F.lit("ZNCC").alias("criterion"), F.lit("YES").alias("limits"), F.lit("NO").alias("weighted")).distinct()
    text = fields_.select(kernels.text(kernels.FIELDS).alias("text"))
    return text.select("text", *kernels.parsed(F.col("text")))


@query("lim_random", _MESH + _RANDOM + " SELECT 1 AS roi_id, count(*) AS n, max(a) + 1 AS attempts FROM picked", "a")
def lim_random(spark, sf_dir):
    """How many attempts it took to find as many patches as are wanted."""
    return mesh.random(_whole(spark, sf_dir), 50, 64, F.col("y2") + 1, attempt=True).groupBy("roi_id").agg(F.count(F.lit(1)).alias("n"), (F.max("attempt") + 1).cast("long").alias("attempts"))


# --- sources ----------------------------------------------------------------------------------------------------

_CONF = "WITH l AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'PARAM_FPS :: ' || (event_id % 7000) WHEN 1 THEN 'PARAM_RESULT_QUALITY = 0,' || (event_id % 100) WHEN 2 THEN 'ROI_' || (event_id % 32) || ' = ' || user_id || ';20;30--NONE--' || (event_id % 9) WHEN 3 THEN '# note' ELSE 'PARAM_SUBSET_SIZE = x' || event_id END AS value FROM events)"


def _conf(spark, sf_dir):
    i = F.col("event_id")
    s = lambda c: c.cast("string")
    text = F.when(i % 5 == 0, F.concat(F.lit("PARAM_FPS :: "), s(i % 7000))).when(i % 5 == 1, F.concat(F.lit("PARAM_RESULT_QUALITY = 0,"), s(i % 100)))
    text = text.when(i % 5 == 2, F.concat(F.lit("ROI_"), s(i % 32), F.lit(" = "), s(F.col("user_id")), F.lit(";20;30--NONE--"), s(i % 9))).when(i % 5 == 3, F.lit("# note")).otherwise(F.concat(F.lit("PARAM_SUBSET_SIZE = x"), s(i)))
    return table(spark, sf_dir, "events").select("event_id", text.alias("value"))


@query("src_config", _CONF + " SELECT event_id, CASE WHEN value LIKE 'PARAM_FPS%' THEN 'FPS' ELSE 'RESULT_QUALITY' END AS name, CASE WHEN value LIKE 'PARAM_FPS%' THEN split_part(value, ' :: ', 2) ELSE split_part(value, ' = ', 2) END AS value FROM l WHERE event_id % 5 < 2")
def src_config(spark, sf_dir):
    from ..sources import config

    lines = config.properties(_conf(spark, sf_dir))
    known = config.parameters(lines)
    return lines.select("event_id", "key", "value").join(known.select(F.concat(F.lit("PARAM_"), "name").alias("key"), "value").distinct(), ["key", "value"], "left_semi").select("event_id", F.substring("key", 7, 100).alias("name"), "value")


@query("src_config_rois", _CONF + " SELECT DISTINCT event_id % 32 AS round, split_part(split_part(value, ' = ', 2), '--', 1) AS region, event_id % 9 AS size FROM l WHERE event_id % 5 = 2")
def src_config_rois(spark, sf_dir):
    from ..sources import config

    return config.regions(config.properties(_conf(spark, sf_dir))).select(F.col("round").cast("long").alias("round"), "region", F.col("size").cast("long").alias("size")).distinct()


@query("src_cache_check", "SELECT event_id AS file FROM events WHERE event_id % 50 = 0")
def src_cache_check(spark, sf_dir):
    from ..sources import config

    live = table(spark, sf_dir, "events").select(F.col("event_id").alias("file"), F.col("user_id").alias("size"), F.col("ts").alias("mtime"))
    manifest = live.withColumn("size", F.when(F.col("file") % 50 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return config.stale_frames(manifest, live).select("file")


@query("src_dispatch", "SELECT DISTINCT event_type || '.' || CASE user_id % 6 WHEN 0 THEN 'BMP' WHEN 1 THEN 'avi' WHEN 2 THEN 'config' WHEN 3 THEN 'task' WHEN 4 THEN 'scr' ELSE 'pdf' END AS path, CASE user_id % 6 WHEN 0 THEN 'images' WHEN 1 THEN 'video' WHEN 2 THEN 'config' WHEN 3 THEN 'snapshot' WHEN 4 THEN 'script' END AS loader FROM events")
def src_dispatch(spark, sf_dir):
    """Paths and what reads them; null for what nothing reads."""
    from ..sources import frames

    ends = F.array(*map(F.lit, ("BMP", "avi", "config", "task", "scr", "pdf")))
    paths = table(spark, sf_dir, "events").select(F.concat_ws(".", "event_type", F.get(ends, (F.col("user_id") % 6).cast("int"))).alias("path")).distinct()
    return paths.select("path", frames.loader("path").alias("loader"))


@query("snk_config", ", z AS (SELECT round, y AS roi_id, max(x) AS size FROM field GROUP BY round, y), t AS (SELECT round, string_agg('0;0;9;9--NONE--' || size, ';;' ORDER BY roi_id) AS value FROM z GROUP BY round), l AS (SELECT *, lag(value) OVER (ORDER BY round) AS b FROM t) SELECT 'ROI_' || round AS key, value FROM l WHERE b IS DISTINCT FROM value", "votes field")
def snk_config(spark, sf_dir):
    from ..sources import config

    z = field(spark, sf_dir).groupBy("round", F.col("y").alias("roi_id")).agg(F.max("x").alias("size"))
    return config.config_lines(z.withColumn("region", F.lit("0;0;9;9")))


@query("win_gauss", _blur_sql(7), "a")
def win_gauss(spark, sf_dir):
    from ..functions import sampling

    return sampling.blur(frame_a(spark, sf_dir), 7).select("x", "y", r6(F.col("g")).alias("g"))


# --- iterative solvers: checked against known warps in the tests ---------------------------------------------------


def _windows(spark, sf_dir):
    return solvers.patch_windows(_mesh(spark, sf_dir), frame_a(spark, sf_dir), frame_b(spark, sf_dir), ["subset_id"], 6)


def _iterative(name: str, solver: str, order: int = 1):
    @query(name)
    def run(spark, sf_dir):
        return solvers.solve_patches(_windows(spark, sf_dir), ["subset_id"], solver, order)

    return run


for _name, _solver in (("slv_nr_central", "NEWTON_RHAPSON_CENTRAL"), ("slv_nr_forward", "NEWTON_RHAPSON_FORWARD"), ("slv_nr_central_he", "NEWTON_RHAPSON_CENTRAL_HE"), ("slv_nr_forward_he", "NEWTON_RHAPSON_FORWARD_HE"), ("slv_spgd", "SPGD")):
    _iterative(_name, _solver)


@query("slv_registry", "SELECT * FROM (VALUES ('BRUTE_FORCE', true, false), ('COARSE_FINE', false, false), ('NEWTON_RHAPSON_CENTRAL', true, false), ('NEWTON_RHAPSON_FORWARD', true, false), ('NEWTON_RHAPSON_CENTRAL_HE', true, false), ('NEWTON_RHAPSON_FORWARD_HE', true, false), ('SPGD', true, true)) t(solver, higher_order, weighted)")
def slv_registry(spark, sf_dir):
    return spark.createDataFrame([(k, *v) for k, v in solvers.SOLVERS.items()], "solver string, higher_order boolean, weighted boolean")


def _half_frame(spark, sf_dir):
    """The first frame moved by one and a half pixels: the mean of its moves by one and by two."""
    two = frame_b(spark, sf_dir, 2, 0).withColumnRenamed("g", "h")
    return frame_b(spark, sf_dir, 1, 0).join(two, ["x", "y"]).select("x", "y", ((F.col("g") + F.col("h")) / 2).alias("g"))


_FINE = (
    ", bh AS MATERIALIZED (SELECT p.x + 1 AS x, p.y, (p.g + o.g) / 2::DOUBLE AS g FROM a p JOIN a o ON o.x = p.x - 1 AND o.y = p.y)" + _BEST.replace("JOIN b ON b.x = mx AND b.y = my", "JOIN bh b ON b.x = mx AND b.y = my").replace("::BIGINT AS s", "::DOUBLE AS s")
    + """, fine AS (SELECT subset_id, k AS c, u + (k % 3 - 1) * 0.5::DOUBLE AS fu, v + (k // 3 - 1) * 0.5::DOUBLE AS fv FROM best, (SELECT unnest(generate_series(0, 8)) AS k)),
pt AS (SELECT p.subset_id, c, fu, fv, p.x, p.y, f, p.x + fu AS px, p.y + fv AS py FROM pix p JOIN fine ON fine.subset_id = p.subset_id),
tap AS (SELECT subset_id, c, fu, fv, x, y, f, floor(px)::BIGINT + i AS bx, floor(py)::BIGINT + j AS bj, (CASE i WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) * (CASE j WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) AS w FROM pt, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j)),
lv AS (SELECT subset_id, c, fu, fv, f, round(sum(w * g), 6) AS g FROM tap LEFT JOIN bh ON bh.x = bx AND bh.y = bj WHERE w <> 0 GROUP BY subset_id, c, fu, fv, tap.x, tap.y, f HAVING bool_and(g IS NOT NULL)),
fm AS (SELECT subset_id, c, fu, fv, count(*) AS n, sum(f) AS sf, sum(g) AS sg, sum(f * f) AS sff, sum(g * g) AS sgg, sum(f * g) AS sfg FROM lv GROUP BY subset_id, c, fu, fv HAVING count(*) = 49),
fq AS (SELECT subset_id, c, fu, fv, round(CASE WHEN n * sff - sf * sf <= 0 OR n * sgg - sg * sg <= 1e-6 THEN 0 ELSE (n * sfg - sf * sg) / sqrt(greatest((n * sff - sf * sf) * (n * sgg - sg * sg), 1e-12)) END, 6) AS q FROM fm)
SELECT subset_id, fu AS u, fv AS v, q + 0 AS quality FROM fq QUALIFY row_number() OVER (PARTITION BY subset_id ORDER BY q DESC, c) = 1"""
)


@query("slv_coarse_fine", _FINE, "a")
def slv_coarse_fine(spark, sf_dir):
    """Whole pixels, then halves around the best, against a frame that is moved by one and a half."""
    out = solvers.coarse_fine(_mesh(spark, sf_dir), frame_a(spark, sf_dir), _half_frame(spark, sf_dir), ["subset_id"], -2, 2, (0.5,), 1)
    return out.select("subset_id", r6(F.col("u")).alias("u"), r6(F.col("v")).alias("v"), r6(F.col("quality")).alias("quality"))


@query("slv_history")
def slv_history(spark, sf_dir):
    out = solvers.solve_patches(_windows(spark, sf_dir), ["subset_id"], "NEWTON_RHAPSON_CENTRAL_HE")
    return out.groupBy("ended").agg(F.count(F.lit(1)).alias("n"), F.max("iterations").alias("most"))


_TASK = (
    _MESH + _CANDS + _OFFS + """, fr AS MATERIALIZED (SELECT 0 AS no, x, y, g FROM a UNION ALL SELECT 1, x + 1, y, g FROM a UNION ALL SELECT 2, x + 2, y - 1, g FROM a),
spot AS MATERIALIZED (SELECT subset_id, cx, cy, cx + ox AS x, cy + oy AS y FROM subs, offs), pix AS MATERIALIZED (SELECT no AS round, p.subset_id, p.x, p.y, fr.g AS f FROM spot p JOIN fr ON fr.x = p.x AND fr.y = p.y WHERE no < 2),
moved AS MATERIALIZED (SELECT round, subset_id, cand_id, u, v, f, x + u AS mx, y + v AS my FROM pix, cands),
mom AS MATERIALIZED (SELECT round, subset_id, cand_id, u, v, count(*) AS n, sum(f)::BIGINT AS sf, sum(g)::BIGINT AS sg, sum(f * f)::BIGINT AS sff, sum(g * g)::BIGINT AS sgg, sum(f * g)::BIGINT AS sfg FROM moved JOIN fr ON fr.x = mx AND fr.y = my AND fr.no = round + 1 GROUP BY ALL HAVING count(*) = 49),
best AS (SELECT *, round(""" + _Q + """, 9) AS quality FROM mom QUALIFY row_number() OVER (PARTITION BY round, subset_id ORDER BY quality DESC, cand_id) = 1),
votes AS MATERIALIZED (SELECT round, cx + ox AS x, cy + oy AS y, u::DOUBLE AS dx, v::DOUBLE AS dy, quality AS q FROM best b JOIN subs s ON s.subset_id = b.subset_id, offs WHERE quality >= 0.25)"""
    + _DISP + ", steps AS MATERIALIZED (SELECT round, x, y, dx, dy, quality / 100 AS q FROM disp)" + _steps_sql(2).rsplit(" SELECT x, y,", 1)[0].replace("FROM field", "FROM steps")
    + ", field AS MATERIALIZED (SELECT round * 10 + round + 1 AS round, x, y, dx, dy, q * 100 AS quality FROM steps UNION ALL SELECT 2, x, y, px - x, py - y, q / n FROM w1)" + _STRAIN.format(r=2)
    + " SELECT (f.round // 10)::BIGINT AS round_from, (f.round % 10)::BIGINT AS round_to, f.x, f.y, round(dx, 6) + 0 AS dx, round(dy, 6) + 0 AS dy, round(quality + 1e-8, 5) + 0 AS quality, round(exx + 1e-8, 5) + 0 AS exx, round(eyy + 1e-8, 5) + 0 AS eyy, round(exy + 1e-8, 5) + 0 AS exy, round(err_u + 1e-8, 5) + 0 AS err_u, round(err_v + 1e-8, 5) + 0 AS err_v FROM field f JOIN st ON st.round = f.round AND st.x = f.x AND st.y = f.y"
)


def _three_frames(spark, sf_dir):
    a = frame_a(spark, sf_dir)
    return a.withColumn("frame_no", F.lit(0)).unionByName(frame_b(spark, sf_dir, 1, 0).withColumn("frame_no", F.lit(1))).unionByName(frame_b(spark, sf_dir, 2, -1).withColumn("frame_no", F.lit(2)))


@query("orc_task", _TASK, "a")
def orc_task(spark, sf_dir):
    """All rounds of a three-frame sequence, and the first frame with the last: solver, displacement, composition, strain."""
    from . import tasks

    out = tasks.compute(_three_frames(spark, sf_dir), _mesh(spark, sf_dir), reach=2, strain_mm=4.0)
    return out.select("round_from", "round_to", "x", "y", r6(F.col("dx")).alias("dx"), r6(F.col("dy")).alias("dy"), *[_r5(F.col(c)).alias(c) for c in ("quality", "exx", "eyy", "exy", "err_u", "err_v")])


def _moving(spark, sf_dir):
    """The first frame, still, then moving down by one pixel and another."""
    a = frame_a(spark, sf_dir)
    return [a, a, *(a.select("x", (F.col("y") + k).alias("y"), "g") for k in (1, 2))]


_FOUR = [(1, 14.0, 20.0, 5.0), (2, 46.0, 20.0, 5.0), (3, 14.0, 90.0, 5.0), (4, 46.0, 90.0, 5.0)]
_JAW_MOVES = ", r AS (SELECT unnest([0, 1, 2]) AS round), j AS (SELECT * FROM (VALUES (1, 14, 20), (2, 46, 20), (3, 14, 90), (4, 46, 90)) t(roi_id, cx, cy))"


@query("orc_jaws", _JAW_MOVES.replace(", r AS", "WITH r AS", 1) + " SELECT round::INTEGER AS round, roi_id, cx::DOUBLE AS cx, (cy + round)::DOUBLE AS cy, least(round, 1)::DOUBLE AS shift, least(round, 1)::DOUBLE AS bottom_shift, 0.0::DOUBLE AS bad_ratio, round > 0 AS moved FROM r, j")
def orc_jaws(spark, sf_dir):
    """Four circles followed through four frames: where they are after each round."""
    from . import tracking

    return tracking.track(_moving(spark, sf_dir), _FOUR)


@query("orc_complex", """, r0 AS (SELECT x, y FROM a WHERE x BETWEEN 24 AND 36 AND y BETWEEN 15 AND 95), c AS (SELECT x, y, x <= 34 AND y <= 90 AS solved FROM r0)
SELECT 0::BIGINT AS round_from, 1::BIGINT AS round_to, x, y, 0.0::DOUBLE AS dx, 0.0::DOUBLE AS dy, NULL::DOUBLE AS quality FROM r0
UNION ALL SELECT 1, 2, x, y, 0.0, 1.0, 100.0 FROM c WHERE solved
UNION ALL SELECT 2, 3, x, y + 1, 0.0, 1.0, 100.0 FROM c WHERE solved
UNION ALL SELECT 0, 2, x, y, 0.0, CASE WHEN solved THEN 1 ELSE 0 END, CASE WHEN solved THEN 50 ELSE 0 END FROM c
UNION ALL SELECT 0, 3, x, y, 0.0, CASE WHEN solved THEN 2 ELSE 0 END, CASE WHEN solved THEN round(200 / 3.0::DOUBLE, 6) ELSE 0 END FROM c""", "a")
def orc_complex(spark, sf_dir):
    """The specimen between four jaws: a round in which nothing moves, two in which all move down by one, and the sums since
    the first.  The SQL is the known motion."""
    from . import tracking

    out = tracking.specimen(_moving(spark, sf_dir), _FOUR, strain_mm=4.0)
    return out.select("round_from", "round_to", "x", "y", *[r6(F.col(c)).alias(c) for c in ("dx", "dy", "quality")])


@query("gen_dynamic")
def gen_dynamic(spark, sf_dir):
    """Of every round, the mesh that its field asks for."""
    from . import adaptive

    previous = field(spark, sf_dir).select("round", "x", "y", "dx", "dy")
    rois = previous.groupBy("round").agg(F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.max("x").cast("int").alias("x2"), F.max("y").cast("int").alias("y2"))
    return adaptive.refine(rois.select("round", F.lit(1).alias("roi_id"), "x1", "y1", "x2", "y2", F.lit(1).alias("s")), previous, 3, 12, 24, ["round"])
