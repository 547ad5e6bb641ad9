"""Files, snapshots, batch lists, switches, sessions, region edits and frame navigation as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import exports, lookups, mesh, statistics
from ..shared import fresh_path, kept
from ..sources import config, frames, settings
from ..sources.tables import field, frame_a, r6, table, votes
from . import batches, session, tracking
from .catalog import query


@query("snk_binary", " SELECT round, count(*) AS cells FROM field GROUP BY round", "votes field")
def snk_binary(spark, sf_dir):
    """A task's results as a Parquet snapshot, and what it holds."""
    path = fresh_path(spark, "task")
    config.save_task(field(spark, sf_dir), path)
    return config.load_task(spark, path).groupBy("round").agg(F.count(F.lit(1)).alias("cells"))


@query("src_binary", " SELECT round, x, y, dx, dy, q FROM field", "votes field")
def src_binary(spark, sf_dir):
    path = fresh_path(spark, "task")
    config.save_task(field(spark, sf_dir), path)
    return config.load_task(spark, path)


# --- files: written by the query to the shared folder, and read from there -----------------------------------------


def _text_file(lines, name: str) -> str:
    """One column of lines, as text files of a fresh folder."""
    path = fresh_path(lines.sparkSession, name)
    lines.write.text(path)
    return path


def _images(spark, sf_dir, stem: str) -> str:
    """Each vector as an image of 8 x 8 pixels in a fresh folder."""
    grey = F.transform("embedding", lambda e: F.pmod(F.floor((e.cast("double") + 0.6) * 200), F.lit(256)))
    raw = table(spark, sf_dir, "embeddings").select(F.format_string(stem + "%05d.bmp", "vec_id").alias("name"), F.lit(8).alias("width"), F.lit(8).alias("height"), grey.alias("g"))
    path = fresh_path(spark, "images")
    frames.write_images(raw, path)
    return path


_GREY = "(floor((embedding[k + 1]::DOUBLE + 0.6) * 200)::BIGINT % 256 + 256) % 256"
_PIXELS = f"WITH e AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS frame_no, embedding FROM embeddings), p AS (SELECT vec_id, frame_no, k, {_GREY} AS g FROM (SELECT *, unnest(generate_series(0, 63)) AS k FROM e))"


@query("src_images", _PIXELS + " SELECT frame_no::INTEGER AS frame_no, printf('f%05d.bmp', vec_id) AS name, 8 AS width, 8 AS height, count(*) AS pixels FROM p GROUP BY vec_id, frame_no")
def src_images(spark, sf_dir):
    """A folder of images, numbered by name."""
    return frames.read_images(spark, _images(spark, sf_dir, "f")).select("frame_no", "name", "width", "height", F.size("g").cast("long").alias("pixels"))


@query("src_decode", _PIXELS + " SELECT frame_no::INTEGER AS frame_no, k % 8 AS x, k // 8 AS y, g FROM p")
def src_decode(spark, sf_dir):
    """Every pixel of every image of a folder."""
    return frames.pixels(frames.read_images(spark, _images(spark, sf_dir, "f")))


@query("src_video", _PIXELS + " SELECT vec_id::INTEGER AS frame_no, printf('clip%05d.bmp', vec_id) AS name, sum(g)::BIGINT AS total FROM p GROUP BY vec_id")
def src_video(spark, sf_dir):
    """Frames that a splitter left beside a video: numbered by the digits of their names."""
    found = frames.read_split_video(spark, _images(spark, sf_dir, "clip"), "clip.avi")
    return found.select("frame_no", "name", F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("src_script", "SELECT 'task' || user_id || '.config' AS config, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY 1")
def src_script(spark, sf_dir):
    """A batch list: one task file a line; blank lines are left out."""
    name = F.concat(F.lit(" task"), F.col("user_id").cast("string"), F.lit(".config "))
    path = _text_file(table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, "  ").otherwise(name).alias("value")), "script")
    return config.read_script(spark, path).groupBy("config").agg(F.count(F.lit(1)).alias("n"))


def _manifest(spark, sf_dir) -> str:
    e, s = table(spark, sf_dir, "events"), lambda c: F.col(c).cast("string")
    line = lambda kind, value: F.concat(F.lit(kind + "_f"), F.lpad(s("event_id"), 7, "0"), F.lit(".bmp :: "), value)
    lines = e.select(F.explode(F.array(line("SIZE", s("user_id")), line("MOD", F.when(F.col("event_id") % 10 != 0, s("event_id"))), F.lit("TYPE = SEQUENCE"))).alias("value")).where("value is not null")
    return _text_file(lines, "manifest")


_MANIFEST = "SELECT 'f' || lpad(event_id::VARCHAR, 7, '0') || '.bmp' AS file, user_id AS size, CASE WHEN event_id % 10 <> 0 THEN event_id END AS mtime FROM events"


@query("src_sequence_config", _MANIFEST)
def src_sequence_config(spark, sf_dir):
    """The files that a sequence's manifest names, with what it says of them."""
    return config.read_manifest(spark, _manifest(spark, sf_dir))


@query("srt_manifest", _MANIFEST.replace("FROM events", "FROM events ORDER BY 1").replace(", user_id AS size, CASE WHEN event_id % 10 <> 0 THEN event_id END AS mtime", ", row_number() OVER (ORDER BY event_id) - 1 AS place"))
def srt_manifest(spark, sf_dir):
    """The manifest's files in order, with their places."""
    files = config.read_manifest(spark, _manifest(spark, sf_dir)).select(F.col("file").alias("name"))
    return frames.numbered(files).select(F.col("name").alias("file"), F.col("frame_no").cast("long").alias("place")).orderBy("file")


@query("src_uda_fps", "WITH l AS (SELECT user_id, min(event_id) FILTER (event_type = 'view') AS first FROM events GROUP BY user_id) SELECT user_id, coalesce(first % 9000, 5000)::INTEGER AS fps FROM l")
def src_uda_fps(spark, sf_dir):
    """A user's events as the lines of a sidecar; views tell a speed."""
    speed = F.concat(F.lit("Speed = ["), (F.col("event_id") % 9000).cast("string"), F.lit("] fps"))
    lines = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("line_no"), F.when(F.col("event_type") == "view", speed).otherwise(F.lit("Shutter 17")).alias("value"))
    return config.sidecar_fps(lines, keys=["user_id"])


@query("src_snapshot_prefs", "SELECT 'COLOR_MAP' AS name, 'MAP' || max(label) AS value FROM embeddings UNION ALL SELECT 'MEMORY_MANAGER', 'DYNAMIC' UNION ALL SELECT 'FOLDER', 'f' || count(*) FROM embeddings")
def src_snapshot_prefs(spark, sf_dir):
    """Settings as stored last, the defaults elsewhere."""
    e = table(spark, sf_dir, "embeddings").agg(F.max("label").alias("top"), F.count(F.lit(1)).alias("n")).first()
    path = fresh_path(spark, "settings")
    before = settings.load(spark, path).count()
    settings.store(spark, path, {"COLOR_MAP": "GREY", "FOLDER": f"f{e.n}"}, before)
    settings.store(spark, path, {"COLOR_MAP": f"MAP{e.top}"}, before + 1)
    return settings.load(spark, path)


_LINES = ", k AS (SELECT DISTINCT round, y FROM field), c AS (SELECT k.round, k.y, i FROM k, (SELECT unnest(generate_series(0, 11)) AS i))"


@query("exp_csv_sequence", _LINES + " SELECT 'map-' || lpad(c.round::VARCHAR, 2, '0') || '.csv' AS file, string_agg(coalesce(printf('%.6f', f.dx), 'NaN'), ',' ORDER BY i) || ',' AS line FROM c LEFT JOIN field f ON f.round = c.round AND f.y = c.y AND f.x = c.i GROUP BY c.round, c.y", "votes field")
def exp_csv_sequence(spark, sf_dir):
    """A file a round; what the files hold."""
    path = fresh_path(spark, "sequence")
    exports.write_sequence(field(spark, sf_dir).select("round", "x", "y", F.col("dx").alias("value")), path, 12)
    return spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("line"))


@query("exp_gui", " SELECT round, x, y, dx AS value FROM field WHERE round IN (1, 3) OR (x = 5 AND y = 11 AND round NOT IN (1, 3))", "votes field")
def exp_gui(spark, sf_dir):
    """Two maps and a point's series, asked for in turn while a viewer is open."""
    with exports.Viewer(field(spark, sf_dir).select("round", "x", "y", F.col("dx").alias("value"))) as viewer:
        asked = viewer.map(1).unionByName(viewer.map(3)).unionByName(viewer.series(5, 11)).distinct()
        return kept(asked, "viewed")


_JET = "floor(greatest(0, least(1, 1.5 - abs({t} * 4 - {m}))) * 255 + 0.5)"
_OVER = ", rg AS (SELECT round, min(dx) AS lo, max(dx) AS hi FROM field GROUP BY round), gr AS (SELECT round, lo, hi, x, y, greatest(0, least(255, g)) AS grey FROM a, rg WHERE x < 12 AND y < 24), t AS (SELECT gr.round, gr.x, gr.y, grey, CASE WHEN hi > lo THEN (dx - lo) / (hi - lo) WHEN dx IS NOT NULL THEN 0.5 END AS t FROM gr LEFT JOIN field f ON f.round = gr.round AND f.x = gr.x AND f.y = gr.y)"


@query(
    "exp_bmp",
    _OVER + " SELECT 'map-' || lpad(round::VARCHAR, 2, '0') || '.bmp' AS file, x, y, " + ", ".join(f"(CASE WHEN t IS NULL THEN grey ELSE floor({_JET.format(t='t', m=m)} * 0.75 + grey * 0.25 + 0.5) END)::BIGINT AS {c}" for m, c in ((1, "b"), (2, "g"), (3, "r")))
    + " FROM t UNION ALL SELECT 'map-' || lpad(round::VARCHAR, 2, '0') || '.bmp', 12 + j, i, " + ", ".join(f"{_JET.format(t='(1 - i / 23::DOUBLE)', m=m)}::BIGINT" for m in (1, 2, 3))
    + " FROM rg, (SELECT unnest(generate_series(0, 23)) AS i), (SELECT unnest(generate_series(0, 29)) AS j)",
    "a votes field",
)
def exp_bmp(spark, sf_dir):
    """Each round's map over the frame, with its colour bar, as a picture file; the pictures' pixels, read back."""
    maps = field(spark, sf_dir).select("round", "x", "y", F.col("dx").alias("value"))
    name = F.concat(F.lit("map-"), F.lpad(F.col("round").cast("string"), 2, "0"), F.lit(".bmp")).alias("name")
    path = fresh_path(spark, "overlay")
    drawn = exports.pictures(exports.overlay(frame_a(spark, sf_dir), maps, ["round"], 12, 24), ["round"])
    frames.write_images(drawn.select(name, "width", "height", "g"), path, colours=True)
    found = frames.read_images(spark, path, lambda data: frames.decode_colours(data).reshape(-1, 3 * (12 + exports.BAR_RIGHT)))
    k = F.col("k")
    levels = found.select(F.col("name").alias("file"), F.posexplode(F.col("g")).alias("k", "v")).select("file", F.floor(k / 3).alias("p"), (k % 3).alias("c"), "v")
    pixels = levels.groupBy("file", "p").agg(*[F.max(F.when(F.col("c") == i, F.col("v"))).alias(n) for i, n in enumerate("bgr")])
    return pixels.select("file", (F.col("p") % 42).cast("long").alias("x"), F.floor(F.col("p") / 42).alias("y"), "b", "g", "r")


@query("exp_avi", _PIXELS + " SELECT 'label' || label AS video, (row_number() OVER (PARTITION BY label ORDER BY p.vec_id) - 1)::INTEGER AS frame_no, total FROM (SELECT vec_id, sum(g)::BIGINT AS total FROM p GROUP BY vec_id) p JOIN embeddings e ON e.vec_id = p.vec_id")
def exp_avi(spark, sf_dir):
    """The images of each label as a video; its frames' sums, read back."""
    grey = F.transform("embedding", lambda e: F.pmod(F.floor((e.cast("double") + 0.6) * 200), F.lit(256)))
    raw = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("video"), F.col("vec_id").alias("frame_no"), F.lit(8).alias("width"), F.lit(8).alias("height"), grey.alias("g"))
    path = fresh_path(spark, "video")
    frames.write_video(raw, path, 25)
    return frames.read_videos(spark, path).select("video", "frame_no", F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("fn_lang", "WITH b(language, key, pattern) AS (VALUES ('en', 'click', 'user {0} clicked at {1}'), ('de', 'click', '{1}: Klick von {0}'), ('en', 'view', 'seen by {0}'), ('de', 'error', 'Fehler')), e AS (SELECT event_id, event_type, user_id, CASE user_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END AS lang FROM events) SELECT event_id, replace(replace(coalesce(o.pattern, d.pattern, event_type), '{0}', user_id::VARCHAR), '{1}', event_id::VARCHAR) AS text FROM e LEFT JOIN b o ON o.language = e.lang AND o.key = event_type LEFT JOIN b d ON d.language = 'en' AND d.key = event_type")
def fn_lang(spark, sf_dir):
    """Texts in each user's language, with arguments."""
    bundle = spark.createDataFrame([("en", "click", "user {0} clicked at {1}"), ("de", "click", "{1}: Klick von {0}"), ("en", "view", "seen by {0}"), ("de", "error", "Fehler")], "language string, key string, pattern string")
    u = F.col("user_id") % 3
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.when(u == 0, "en").when(u == 1, "de").otherwise("fr").alias("lang"))
    return text.localized(rows, bundle, "event_type", "lang", [F.col("user_id"), F.col("event_id")]).select("event_id", "text")


# --- sessions -------------------------------------------------------------------------------------------------------


def _session(spark, sf_dir, debug=None, stop_at: int | None = None):
    """The field of each round, computed round by round: results, events, and the rounds whose statistics were taken."""
    run, events, stats = session.Session(spark, debug), [], []

    def listen(event):
        events.append(event)
        if stop_at is not None and event.round == stop_at:
            run.stop()

    run.listeners.append(listen)
    f = field(spark, sf_dir)
    numbers = [r.round for r in f.select("round").distinct().orderBy("round").collect()]  # a number a round
    done = run.run(numbers, lambda r: f.where(F.col("round") == r), kept, lambda r, found: stats.append((r, found.count())))
    return done, events, stats


_ROUNDS = ", rounds AS (SELECT DISTINCT round FROM field), numbered AS (SELECT round, row_number() OVER (ORDER BY round) - 1 AS k, count(*) OVER () AS n FROM rounds)"


@query("orc_progress", _ROUNDS + " SELECT 'round' AS phase, round, round(k / n, 6) AS fraction FROM numbered UNION ALL SELECT 'done', NULL, 1", "votes field")
def orc_progress(spark, sf_dir):
    """What a listener hears of a task."""
    _, events, _ = _session(spark, sf_dir)
    assert all(e.ms >= 0 for e in events)
    return spark.createDataFrame([(e.phase, e.round, round(e.fraction, 6)) for e in events], "phase string, round long, fraction double")


@query("orc_stop", " SELECT round, x, y, dx, dy, q FROM field WHERE round < 2", "votes field")
def orc_stop(spark, sf_dir):
    """What is there of a task that is stopped when its round 2 begins."""
    done, events, _ = _session(spark, sf_dir, stop_at=2)
    assert events[-1].phase == "stopped"
    return done[0].unionByName(done[1])


@query("dbg_mode", " SELECT round, count(*) AS cells FROM field WHERE round NOT IN (1, 4) GROUP BY round", "votes field")
def dbg_mode(spark, sf_dir):
    """Statistics are taken in all rounds but those that pause them."""
    _, _, stats = _session(spark, sf_dir, session.Debug(True, {1, 4}))
    return spark.createDataFrame(stats, "round long, cells long")


_VEC = ", vec AS (SELECT round, printf('%.2f', dx) || ';' || printf('%.2f', dy) AS deformation, q AS quality FROM votes)"


@query("dbg_all", _VEC + " SELECT 'DEF_USAGE' AS statistic, deformation AS key, count(*) AS n FROM vec GROUP BY deformation UNION ALL SELECT 'DEF_QUALITY', floor(quality * 10)::BIGINT::VARCHAR, count(*) FROM vec GROUP BY floor(quality * 10) UNION ALL SELECT 'POINT_QUALITY', round::VARCHAR, count(*) FROM field WHERE q >= 0.5 GROUP BY round", "votes field")
def dbg_all(spark, sf_dir):
    """All switched-on statistics of a task in one table."""
    from ..functions import measures

    v = votes(spark, sf_dir).select("round", F.concat_ws(";", measures.number_text(F.col("dx")), measures.number_text(F.col("dy"))).alias("deformation"), F.col("q").alias("quality"))
    return statistics.report(v, field(spark, sf_dir), ["DEF_USAGE", "DEF_QUALITY", "POINT_QUALITY"], 0.5)


_NAMES = ", ".join(f"({k}, '{name}')" for k, name in enumerate(config.SWITCHES))


@query("dbg_switches", f"SELECT s.name, coalesce(o.value, false) AS value FROM (VALUES {_NAMES}) s(k, name) LEFT JOIN (SELECT label, max(vec_id) % 2 = 0 AS value FROM embeddings WHERE label % 2 = 0 GROUP BY label) o ON o.label = s.k")
def dbg_switches(spark, sf_dir):
    """Seven switches, off unless a properties file says otherwise."""
    own = table(spark, sf_dir, "embeddings").where("label % 2 = 0").groupBy("label").agg((F.max("vec_id") % 2 == 0).alias("on"))
    name = F.get(F.array(*map(F.lit, config.SWITCHES)), F.col("label"))
    path = _text_file(own.select(F.concat(F.coalesce(name, F.lit("OTHER")), F.lit(" = "), F.col("on").cast("string")).alias("value")).unionByName(spark.createDataFrame([("# switches",), ("no line",)], "value string")), "switches")
    return config.switches(config.read_config(spark, path))


@query("eng_errors", "SELECT DISTINCT label, CASE label % 4 WHEN 0 THEN 'ILLEGAL_TASK_DATA' WHEN 1 THEN 'IO' WHEN 2 THEN 'NOT_ENOUGH_ROIS' ELSE 'MEMORY_ERROR' END AS cause FROM embeddings")
def eng_errors(spark, sf_dir):
    """What tasks that can't be computed end with."""

    def no_memory(_):
        raise MemoryError

    bad = [lambda _: spark.createDataFrame([config.validated({}, 3)]), lambda _: spark.read.parquet(fresh_path(spark, "missing")), lambda _: tracking.track([table(spark, sf_dir, "embeddings")] * 2, [(1, 9.0, 9.0, 3.0)]), no_memory]

    def cause(compute) -> str:
        try:
            session.Session(spark).run([0], compute, lambda df, _: df)
        except session.ComputationError as error:
            return error.cause.name
        return "none"

    causes = [cause(c) for c in bad]
    return table(spark, sf_dir, "embeddings").select("label").distinct().withColumn("cause", F.get(F.array(*map(F.lit, causes)), F.col("label") % 4))


# --- limits, batches, edits -------------------------------------------------------------------------------------------


@query("slv_limits_adapt", "WITH r AS (SELECT DISTINCT label, label % 3 + 1 AS k FROM embeddings), c AS (SELECT label, k, (2 * k + 1) * (2 * k + 1) AS total, unnest(generate_series(0, (2 * k + 1) * (2 * k + 1) - 1)) AS cand_id FROM r) SELECT label, cand_id, (cand_id % (2 * k + 1) - k)::DOUBLE AS u, (cand_id // (2 * k + 1) - k)::DOUBLE AS v, total FROM c")
def slv_limits_adapt(spark, sf_dir):
    """Limits as explicit lists of candidates, with their lengths."""
    k = (F.col("label") % 3 + 1).cast("double")
    limits = table(spark, sf_dir, "embeddings").select("label", F.array(-k, k, F.lit(1.0), -k, k, F.lit(1.0)).alias("limits")).distinct()
    d = mesh.candidates(limits, "total")
    return d.select("label", "cand_id", F.get("deformation", F.lit(0)).alias("u"), F.get("deformation", F.lit(1)).alias("v"), "total")


@query("eng_batching", "WITH e AS (SELECT label, vec_id, (2 * (label % 4 + 2) + 1) * (2 * (label % 4 + 2) + 1) * 12 + 100 AS size FROM embeddings), b AS (SELECT label, vec_id, floor((sum(size) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) - size) / 4000)::BIGINT AS batch, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 7 AS by_count FROM e) SELECT label, batch, count(*) AS n, min(vec_id) AS first, max(by_count) AS by_count FROM b GROUP BY label, batch")
def eng_batching(spark, sf_dir):
    """Patches of each region in batches that fit some memory, and in batches of seven."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.col("label") % 4 + 2).alias("s"))
    by_size = batches.numbered(e, ["label"], "vec_id", limit=4000, size=batches.patch_bytes(F.col("s"), F.lit(25)))
    both = by_size.join(batches.numbered(e, ["label"], "vec_id", count=7).select("vec_id", F.col("batch").alias("by_count")), "vec_id")
    return both.groupBy("label", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), F.max("by_count").alias("by_count"))


@query("ui_edit_roi", "WITH r AS (SELECT vec_id AS round, label AS x1 FROM embeddings), e AS (SELECT vec_id AS round, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE label + 100 END AS x1 FROM embeddings WHERE vec_id % 2 = 0) SELECT r.round, CASE WHEN e.round IS NULL THEN r.x1 ELSE e.x1 END AS x1 FROM r LEFT JOIN e ON e.round = r.round")
def ui_edit_roi(spark, sf_dir):
    """Edits replace a frame's regions; an empty edit leaves null."""
    rois = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("round"), F.col("label").alias("x1"))
    return lookups.edited(rois, rois.where("round % 2 = 0").select("round", F.when(F.col("round") % 4 != 0, F.col("x1") + 100).alias("x1")), ["round"])


@query("ui_frame_nav", "WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT vec_id AS frame_no, (vec_id + 1) % n AS next, (vec_id - 1 + n) % n AS previous, greatest(0, least(vec_id * 3 - 5, n - 1)) AS typed FROM embeddings, n")
def ui_frame_nav(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_no"))
    both = e.join(F.broadcast(e.agg(F.count(F.lit(1)).alias("n"))))  # one row
    after, before, typed = frames.navigation(F.col("n"), F.col("frame_no"), F.col("frame_no") * 3 - 5)
    return both.select("frame_no", after.alias("next"), before.alias("previous"), typed.alias("typed"))


@query("exp_stretch_factor", ", fa AS (SELECT (SELECT max(y) FROM field WHERE round = 1)::DOUBLE / (SELECT max(y) FROM field WHERE y <= 20)::DOUBLE AS f) SELECT round(f, 6) + 0 AS factor FROM fa", "votes field")
def exp_stretch_factor(spark, sf_dir):
    f = field(spark, sf_dir)
    return exports.stretch_factor(f.where("round = 1"), f.where("y <= 20")).select(r6(F.col("factor")).alias("factor"))
