"""Line dedup: two Bloom filters find suspected repeats; only those shuffle, and are confirmed exactly.

1. Every task folds its documents' line keys into a once-seen and a twice-seen Bloom filter (``twice``).
2. A second scan sends on only the lines whose key the merged twice filter knows, as SHA-256 of the key.
3. Grouped minimum and maximum of doc_id confirm the keys of two or more documents and choose the first holder;
   the others' keys are gathered by document and joined to the texts, from which those lines are dropped.

Defined results.  Null or empty text: one empty line.  A null doc_id: the row keeps all its lines and isn't a
holder.  Repeated rows, and rows that share a doc_id, are one holder; each row is returned.  A text of any length is held
by one task at a time, a line of any length is one key.  An empty table gives an empty table.  More lines than one pair of
filters serves take more scans, with the same result.
Other columns are carried by ``dedup_lines`` as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import state, twice
from . import textblocks as tb

MIN_CODE_POINTS = 10


def _lines(block: tb.Block):
    """Line starts, ends (without the line feed), first line of each row."""
    feeds = np.flatnonzero(block.buf == 10)
    # each row begins one line, each feed begins another in the row that holds the feed
    counts = np.searchsorted(feeds, block.offs[1:]) - np.searchsorted(feeds, block.offs[:-1]) + 1
    first = np.concatenate(([0], np.cumsum(counts)))
    starts = np.empty(first[-1], np.int64)
    row_start = np.zeros(first[-1], bool)
    row_start[first[:-1]] = True
    starts[row_start] = block.offs[:-1]
    starts[~row_start] = feeds + 1
    ends = np.empty(first[-1], np.int64)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = block.offs[1:]
    return starts, ends, first


def _keys(block: tb.Block, min_code_points: int):
    """Lines, the stripped range of each, and which are long enough to count."""
    starts, ends, first = _lines(block)
    solid = np.flatnonzero(~tb.SPACE[block.buf])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = b > a
    s, e = starts.copy(), starts.copy()
    s[some], e[some] = solid[a[some]], solid[b[some] - 1] + 1
    points = np.concatenate(([0], np.cumsum((block.buf & 0xC0) != 0x80)))
    return starts, ends, first, s, e, points[e] - points[s] >= min_code_points


def _hashed(column, min_code_points: int):
    for block in tb.blocks(column):
        starts, ends, first, s, e, long = _keys(block, min_code_points)
        lower = tb.LOWER[block.buf]
        at = np.flatnonzero(long)
        yield block, lower, (starts, ends, first, s, e), at, tb.row_of(first, first[-1])[at], tb.range_hashes(lower, s[at], e[at])


def first_holders(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """doc_id, drop: SHA-256 of the line keys that the document loses; documents that lose none are left out."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    n_lines = held.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0]

    def distinct_keys(batch):
        for _, _, _, _, row, h in _hashed(batch.column(0), min_code_points):
            yield tb.distinct_in_rows(row, h)[1]

    def suspects(filter_):
        def run(batches):
            seen = filter_.value
            for batch in batches:
                for block, lower, (_, _, _, s, e), at, row, h in _hashed(batch.column(1), min_code_points):
                    hit = np.flatnonzero(seen.test(h))
                    rows, whole, ids = row[hit], lower.tobytes(), batch.column(0).slice(block.lo, block.rows).to_numpy(zero_copy_only=False)
                    out = list({(int(ids[r]), hashlib.sha256(whole[s[i] : e[i]]).digest()) for r, i in zip(rows.tolist(), at[hit].tolist(), strict=True)})
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int64()), pa.array([k for _, k in out], pa.binary())], names=["doc_id", "key"])

        return held.mapInArrow(run, "doc_id long, key binary")

    spark = held.sparkSession
    filters = (twice.build(held.select("text"), distinct_keys, n_lines or 1, share) for share in twice.shares(n_lines or 1))
    parts = []
    for f in filters:
        held_filter = spark.sparkContext.broadcast(f)
        parts.append(state.keep(suspects(held_filter), "line-suspects"))  # read twice
        held_filter.unpersist()
    rows = reduce(DataFrame.unionAll, parts)
    firsts = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    firsts = state.keep(firsts.select("key", "first"), "line-firsts")  # so that the join deals out both sides, and a hot key can be split
    return rows.join(firsts, "key").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("key").alias("drop"))


def _with_drops(docs: DataFrame, min_code_points: int) -> DataFrame:
    """``docs`` with one more column, the keys that the row loses (null: none), whatever its columns are called."""
    names = docs.columns
    doc, drop = state.free_name("__doc", names), state.free_name("__drop", names)
    drops = first_holders(docs, min_code_points).select(F.col("doc_id").alias(doc), F.col("drop").alias(drop))
    return docs.join(drops.hint("shuffle_hash"), docs["doc_id"].cast("long") == drops[doc], "left").select(*[docs[c] for c in names], drops[drop])


def _kept(batch, text_at: int, drop_at: int, min_code_points: int):
    """For each row: kept text as bytes, lines before, lines dropped."""
    drops = batch.column(drop_at)
    for block in tb.blocks(batch.column(text_at)):
        starts, ends, first, s, e, long = _keys(block, min_code_points)
        whole, lower = block.buf.tobytes(), tb.LOWER[block.buf].tobytes()
        for i in range(block.rows):
            gone = drops[block.lo + i].as_py()
            n = int(first[i + 1] - first[i])
            if not gone:
                yield whole[block.offs[i] : block.offs[i + 1]], n, 0
                continue
            gone = set(gone)
            lines = range(int(first[i]), int(first[i + 1]))
            stay = [j for j in lines if not (long[j] and hashlib.sha256(lower[s[j] : e[j]]).digest() in gone)]
            yield b"\n".join(whole[starts[j] : ends[j]] for j in stay), n, n - len(stay)


def line_digest(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of ``docs``."""
    joined = _with_drops(docs.select("doc_id", F.col("text").cast("string").alias("text")), min_code_points)

    def digest(batches):
        for batch in batches:
            got = [(n, d, hashlib.sha256(t).hexdigest()) for t, n, d in _kept(batch, 1, 2, min_code_points)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return joined.mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS, keep_emptied: bool = True) -> DataFrame:
    """``docs`` with the dropped lines gone from ``text``; the other columns as they are (a null text stays null).

    keep_emptied: whether rows stay that lost lines and have nothing but white space left, copies throughout."""
    names = docs.columns
    joined = _with_drops(docs, min_code_points)
    text_at = names.index("text")

    def rewrite(batches):
        for batch in batches:
            kept = list(_kept(batch, text_at, len(names), min_code_points))
            text = pa.array([t.decode("utf-8") for t, _, _ in kept], pa.string(), mask=np.asarray(batch.column(text_at).is_null()))
            out = pa.RecordBatch.from_arrays([text if i == text_at else batch.column(i) for i in range(len(names))], names=names)
            yield out if keep_emptied else out.filter(pa.array([not n or bool(t.strip()) for t, _, n in kept], pa.bool_()))

    return joined.mapInArrow(rewrite, docs.schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), k AS (
  SELECT doc_id, line, i,
    translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.doc_id, k.line, k.i, f.first IS NOT NULL AND k.doc_id > f.first AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
