from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.streaming import rounds

SCHEMA = "ts timestamp, x long, y long, dx double, dy double, q double"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(60 * (k // 8) + k, k % 3, k % 2, k / 4, -k / 8, (k % 4 + 1) / 4) for k in range(64)]
    votes = spark.createDataFrame(rows, "s long, x long, y long, dx double, dy double, q double").select(F.timestamp_seconds("s").alias("ts"), "x", "y", "dx", "dy", "q")
    votes.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = rounds.windowed_field(rounds.vote_stream(spark, str(tmp_path / "in"), SCHEMA, 1), late="1 hour")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("fields").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: (r[0], r[1], r[2])
    got = sorted((tuple(r) for r in spark.table("fields").collect()), key=key)
    want = sorted((tuple(r) for r in rounds.windowed_field(votes).collect()), key=key)
    assert len(got) == len(want) > 10
    assert all(g[:3] == w[:3] and all(abs(a - b) < 1e-12 for a, b in zip(g[3:], w[3:], strict=True)) for g, w in zip(got, want, strict=True))
