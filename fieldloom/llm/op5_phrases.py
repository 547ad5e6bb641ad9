"""Substring dedup of repeated passages by phrase automata.

Windows of WINDOW words recur if their words also stand at another place, in the same document or another.  Phrases of
PHRASE words that may recur are found by ``anchors`` and dealt to shards with the pieces of text around them.  A shard
confirms its phrases, compiles them into an Aho-Corasick automaton and streams its pieces through it, which locates
every occurrence; the windows that hold an occurrence are compared exactly, by ranks of 1, 2, 4 .. 32 words.  All words
of recurring windows are removed, at every place; windows are judged on the input.

Defined results.  Null or empty text: no words; the digest of nothing.  Null doc_id: the text takes part, id null.
Repeated rows, and rows that share a doc_id, are places of their own; each is returned with its own counts.  A text of any
length is held by one task at a time.  An empty table gives an empty table.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors
from . import textblocks as tb

WINDOW, PHRASE = 35, 8
SIZES = anchors.Sizes(mean=800, owner=800, hot=800)


def _grams(column: pa.Array):
    for block in tb.blocks(column):
        s, e, first = tb.tokens(block.buf, block.offs, tb.WORD_BYTE)
        words = tb.range_hashes(block.buf, s, e)
        yield block, first, tb.gram_hashes(words, PHRASE), lambda at, words=words: tb.gram_hashes(words, WINDOW)[at]


def _cut(texts: list[bytes], row: np.ndarray, pos: np.ndarray, n: np.ndarray, shard: np.ndarray) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """Pieces as words joined by single spaces; the note holds where in the piece phrases stand."""
    split = [t.split() for t in texts]
    length = np.array([len(w) for w in split])
    order = np.lexsort((pos, row))
    row, pos, n, shard = row[order], pos[order], n[order], shard[order]
    phrase = np.flatnonzero(n == 0)
    places, begin_of = pos[phrase], np.searchsorted(row[phrase], np.arange(len(texts) + 1))
    for r, s, begin, end in zip(*(x.tolist() for x in anchors.spans(row, pos, n, shard, PHRASE, WINDOW, length)), strict=True):
        # phrases whose windows are in the piece: the same for equal pieces, as windows choose them
        own = places[begin_of[r] : begin_of[r + 1]]
        inside = own[np.searchsorted(own, begin) : np.searchsorted(own, end - PHRASE, side="right")] - begin
        if s >= anchors.RUN_SHARDS:  # of a run: the first phrase of each window
            inside = np.arange(end - begin - WINDOW + 1)
        yield r, s, begin, b" ".join(split[r][begin:end]), inside.astype("<u4").tobytes()


def _ranks(ids: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Equal numbers for equal windows of ids; -1 where no window fits before the piece's end (ends, by item)."""
    rank, have, n = ids, 1, len(ids)

    def pair(shift: int, size: int) -> np.ndarray:
        fits = np.arange(n) + size <= ends
        at = np.flatnonzero(fits)
        key = rank[at].astype(np.int64) * (int(rank.max(initial=0)) + 2) + rank[at + shift]
        out = np.full(n, -1, np.int64)
        out[at] = np.unique(key, return_inverse=True)[1]
        return out

    while have * 2 <= window:
        rank = pair(have, have * 2)
        have *= 2
    return pair(window - have, window) if have < window else rank


def solve(pieces: list[tuple[int, int, bytes, bytes]]) -> Iterator[tuple[int, int, int, int]]:
    """pieces (smallest doc, count, content, note) -> (piece, lo, hi, 1): words of recurring windows."""
    split = [content.split(b" ") for _, _, content, _ in pieces]
    counts: Counter[bytes] = Counter()
    for words, (_, count, _, note) in zip(split, pieces, strict=True):
        for p in np.frombuffer(note, "<u4").tolist():
            counts[b" ".join(words[p : p + PHRASE])] += count
    automaton = ahocorasick.Automaton()
    for phrase, n in counts.items():
        if n > 1:  # confirmed, word by word
            # bytes as code points of their own: the automaton works on text
            automaton.add_word(" " + phrase.decode("latin-1") + " ", len(phrase))
    if not len(automaton):
        return
    automaton.make_automaton()
    begin = np.cumsum([0] + [len(w) for w in split])
    near = np.zeros(begin[-1] + 1, np.int32)
    for i, (_, _, content, _) in enumerate(pieces):
        text = " " + content.decode("latin-1") + " "
        found = [end - length for end, length in automaton.iter(text)]
        if not found:
            continue
        # a phrase of `length` bytes that ends before the space at `end` begins at end - length; count the spaces before it
        spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
        p = np.searchsorted(spaces, np.unique(found)) - 1
        lo, hi = np.maximum(0, p + PHRASE - WINDOW), np.minimum(p, len(split[i]) - WINDOW)
        fits = hi >= lo
        np.add.at(near, begin[i] + lo[fits], 1)
        np.add.at(near, begin[i] + hi[fits] + 1, -1)
    wanted = np.cumsum(near[:-1]) > 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for words in split for w in words), np.int64, begin[-1])
    rank = _ranks(ids, np.repeat(begin[1:], np.diff(begin)), WINDOW)
    at = np.flatnonzero(wanted & (rank >= 0))
    owner = np.searchsorted(begin, at, side="right") - 1
    weight = np.array([count for _, count, _, _ in pieces])[owner]
    total = np.bincount(rank[at], weights=weight)
    at, owner = at[total[rank[at]] > 1], owner[total[rank[at]] > 1]
    # runs of neighbouring starts
    if not len(at):
        return
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (np.diff(owner) > 0))))
    last = np.concatenate((new[1:], [len(at)])) - 1
    for a, b in zip(new, last, strict=True):
        i = int(owner[a])
        yield i, int(at[a] - begin[i]), int(at[b] - begin[i]) + WINDOW, 1


def _prepared(docs: DataFrame) -> DataFrame:
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    own = -1 - F.pmod(F.xxhash64(text), F.lit(1 << 62))  # stands in for a null id; equal texts share it, which is as good
    return docs.select(F.coalesce(doc, own).alias("doc"), doc.alias("doc_id"), text.alias("text"))


def removable(docs: DataFrame) -> DataFrame:
    """docs (doc, doc_id, text) -> doc, ranges: [(mark, lo, hi)], words of recurring windows."""
    size = docs.select(F.sum(F.length("text"))).first()[0] or 0
    at = anchors.recurring(docs, _grams, PHRASE, WINDOW, size // 80 + 1, across=False, sizes=SIZES)
    return anchors.by_shard(anchors.pieces(docs, at, _cut), solve, "value = 1")


def phrase_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    docs = _prepared(docs)

    def digest(batches):
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8")
                words = raw.split()
                gone = anchors.covered(raw, ranges.as_py(), len(words))
                kept = words if gone is None else list(compress(words, (~gone).tolist()))
                out.append((len(words), len(words) - len(kept), sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return anchors.with_ranges(docs, removable(docs), digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op5_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), x AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)
), r AS (
  SELECT doc_id, i FROM x WHERE s IN (SELECT s FROM x GROUP BY s HAVING count(*) > 1)
), g AS (
  SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(generate_series(0, 34)) AS k)
), t AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), m AS (
  SELECT t.doc_id, t.word, t.i, g.i IS NOT NULL AS gone FROM t LEFT JOIN g ON t.doc_id = g.doc_id AND t.i = g.i
), a AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN a ON w.doc_id = a.doc_id
"""
