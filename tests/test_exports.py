"""Exports against plain formatting."""

from __future__ import annotations

from fieldloom.operators import exports

#: 13/128 and 9/128 lie half way between two texts; 1/640's shortest decimal does, its exact value doesn't.
HALVES = [13 / 128, 9 / 128, -13 / 128, 1 / 640, 3 / 640, 1.0000005, 0.25, -1e-7, None, float("nan"), float("inf")]
TEXTS = ["0.101562", "0.070312", "-0.101562", *["%.6f" % v for v in (1 / 640, 3 / 640, 1.0000005)], "0.250000", "-0.000000", "NaN", "NaN", "Infinity"]


def _maps(spark):
    return spark.createDataFrame([(r, x, r, v) for r in (0, 1) for x, v in enumerate(HALVES)], "round long, x long, y long, value double")


def test_map_lines_round_the_exact_value(spark):
    got = exports.csv_rows(_maps(spark), len(HALVES) + 1, ["round"]).orderBy("round").collect()
    assert [(r.round, r.y, r.line) for r in got] == [(k, k, ",".join([*TEXTS, "NaN"]) + ",") for k in (0, 1)]


def test_files_of_a_sequence_round_the_exact_value(spark, tmp_path):
    exports.write_sequence(_maps(spark), str(tmp_path / "seq"), len(HALVES))
    line = ",".join(TEXTS) + ",\n"
    assert {p.name: p.read_text() for p in (tmp_path / "seq").glob("*.csv")} == {"map-00.csv": line, "map-01.csv": line}


def test_files_of_a_sequence_agree_with_sql_half_way_between_texts(spark, tmp_path):
    """Means of 32 votes, +-1/128, +-3/128 .. +-23/128: each half way between two texts; every other one goes up."""
    import __spark_entry__ as entry
    import duckdb

    db, events = duckdb.connect(), tmp_path / "events.parquet"
    votes = "SELECT s, r, x, i, 2 + CASE WHEN i <= 2 * x THEN s * 0.25 ELSE 0 END AS value FROM (VALUES (-1), (1)) AS a(s), range(2) AS b(r), range(12) AS c(x), range(32) AS d(i)"
    db.sql(f"COPY (SELECT row_number() OVER (ORDER BY s, r, x, i) AS event_id, TIMESTAMP '2024-01-01 07:00:00' + to_days(r::INT) + to_hours(s) AS ts, x AS user_id, value::DOUBLE AS value FROM ({votes})) TO '{events}' (FORMAT parquet)")
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{events}'")
    want = db.sql(f"SELECT file, line FROM ({entry.oracle_sql()['exp_csv_sequence']})").fetchall()
    got = entry.queries()["exp_csv_sequence"](spark, str(tmp_path)).select("file", "line").collect()
    assert len(want) == 4 and sorted(map(tuple, got)) == sorted(want)
