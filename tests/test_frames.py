"""The order of frames."""

from __future__ import annotations

from fieldloom.sources import frames

ORDERED = ["a.bmp", "f.bmp", "f2.bmp", "f00010.bmp", "f10.bmp", "f99999.bmp", "f100000.bmp", "f100000b2.bmp", "f100000b10.bmp", "f123456789012345678901234567890.bmp"]


def test_numbers_in_names_sort_as_numbers(spark):
    names = spark.createDataFrame([(n,) for n in reversed(ORDERED)], "name string")
    got = {r.name: r.frame_no for r in frames.numbered(names).collect()}
    assert got == {n: k for k, n in enumerate(ORDERED)}


def test_images_are_numbered_beyond_five_digits(spark, tmp_path):
    import numpy as np

    ids = [2, 10001, 99999, 100000, 1000000]
    for k in ids:
        (tmp_path / f"f{k:05d}.bmp").write_bytes(frames.encode_bmp(np.full((2, 3), k % 256)))
    got = frames.read_images(spark, str(tmp_path)).collect()
    assert {(r.frame_no, r.name, r.width, r.height, tuple(r.g)) for r in got} == {(i, f"f{k:05d}.bmp", 3, 2, (k % 256,) * 6) for i, k in enumerate(ids)}


def test_images_of_vectors_agree_with_sql_beyond_five_digits(spark, tmp_path):
    import __spark_entry__ as entry
    import duckdb

    db, vectors = duckdb.connect(), tmp_path / "embeddings.parquet"
    db.sql(f"COPY (SELECT vec_id, list((k / 64 - 0.5)::FLOAT ORDER BY k) AS embedding FROM (VALUES (1000000), (2), (100000), (0), (99999), (10001), (123456789012)) AS v(vec_id), range(64) AS r(k) GROUP BY vec_id) TO '{vectors}' (FORMAT parquet)")
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{vectors}'")
    want = db.sql(f"SELECT frame_no, name, width, height, pixels FROM ({entry.oracle_sql()['src_images']})").fetchall()
    got = entry.queries()["src_images"](spark, str(tmp_path)).select("frame_no", "name", "width", "height", "pixels").collect()
    assert len(want) == 7 and sorted(map(tuple, got)) == sorted(want)
