"""Licence scans by diagonal voting.

Every rolling word k-gram hash of every document is joined, in Spark, to the positions of that k-gram in the licence
templates (a fixed list, a few hundred rows, so the broadcast has a proven bound).  A hit at document word p and
template word q votes for the diagonal p - q; votes are summed by document, template and diagonal.  Insertions and
deletions move a copy from one diagonal to others near it, so neighbouring diagonals are merged: votes are summed over
stretches as wide as the template is long, one beginning every half of that.  A copy whose insertions come to half its
length at most lies in one stretch with all its votes.  Stretches with enough votes are verified against the document's
own words, by an order-keeping alignment: MIN_COVER of the template's words must stand there, and be MIN_DENSITY of the
words from the first to the last of them.  Places of the base phrases are counted exactly in the same scan.

A stretch spans twice the template's words at most, and all steps are grouped sums, so work grows with the words of a
document however long it is.

Defined results.  Null or empty text: no words, no labels ('' and score 0).  Null doc_id: judged like others, id null.
Rows that share a doc_id are judged each by its own text; repeated rows have equal results.  An empty table gives an empty
table.  Extra columns are ignored.
"""

from __future__ import annotations

import difflib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_texts, semi, state
from . import textblocks as tb

K = 3
#: Share of the template's words that must match, and share that these must be of the words they span.
MIN_COVER, MIN_DENSITY = 0.8, 2 / 3


def words(text: bytes) -> list[bytes]:
    buf = tb.LOWER[np.frombuffer(text, np.uint8)]
    s, e, _ = tb.tokens(buf, np.array([0, len(buf)]), tb.ALNUM_BYTE)
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(s, e, strict=True)]


def _template_words(templates) -> list[list[bytes]]:
    return [words(text.encode("utf-8")) for _, text in templates]


def _word_hash(word: bytes) -> np.uint64:
    return tb.range_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]


def _scan(column: pa.Array):
    for block in tb.blocks(column):
        buf = tb.LOWER[block.buf]
        s, e, first = tb.tokens(buf, block.offs, tb.ALNUM_BYTE)
        yield block, buf, s, e, first, tb.range_hashes(buf, s, e)


def base_places(docs: DataFrame, phrases=license_texts.PHRASES) -> DataFrame:
    """docs (key, doc_id, text) -> key, doc_id, n_words, n_base, first_word, last_word, base_labels of every row."""
    wanted = [(phrase.encode().split(b" "), label) for phrase, label in phrases]
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string())])

    def run(batches):
        last = {w[-1]: _word_hash(w[-1]) for w, _ in wanted}
        for batch in batches:
            n_words, places = [], {}
            for block, buf, s, e, first, h in _scan(batch.column(2)):
                n_words.append(np.diff(first))
                row = tb.row_of(first, len(s))
                raw = None
                for phrase, label in wanted:
                    back = len(phrase) - 1
                    for i in np.flatnonzero(h == last[phrase[-1]]).tolist():
                        if i - back >= first[row[i]]:
                            raw = buf.tobytes() if raw is None else raw
                            if all(raw[s[i - back + j] : e[i - back + j]] == w for j, w in enumerate(phrase)):
                                places.setdefault(block.lo + int(row[i]), []).append((i - back - int(first[row[i]]), label))
            count = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            n = [len(places.get(i, ())) for i in range(batch.num_rows)]
            lo = [min(places[i])[0] if i in places else None for i in range(batch.num_rows)]
            hi = [max(places[i])[0] if i in places else None for i in range(batch.num_rows)]
            labels = [",".join(sorted({x for _, x in places.get(i, ())})) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count, pa.int64()), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(labels, pa.string())], schema=schema)

    return docs.select("key", "doc_id", "text").mapInArrow(run, "key long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string")


def _votes(docs: DataFrame, templates, k: int) -> DataFrame:
    """key, doc_id, template, diagonal, votes, low, high (document words of the votes)."""
    spark = docs.sparkSession
    rows = []
    for t, ws in enumerate(_template_words(templates)):
        h = tb.gram_hashes(np.array([_word_hash(w) for w in ws], np.uint64), k)
        rows += [(int(x), t, q) for q, x in enumerate(tb.as_long(h).tolist())]
    grams = F.broadcast(spark.createDataFrame(rows, "h long, template int, q int"))  # of the fixed templates only

    def run(batches):
        for batch in batches:
            for block, _, s, _, first, h in _scan(batch.column(2)):
                g = tb.as_long(tb.gram_hashes(h, k))
                n = np.maximum(np.diff(first) - (k - 1), 0)
                at = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(block.lo, block.rows) for i in (0, 1)), tb.list_array(n, g[at], pa.int64())], names=["key", "doc_id", "grams"])

    hits = docs.select("key", "doc_id", "text").mapInArrow(run, "key long, doc_id long, grams array<long>").select("key", "doc_id", F.posexplode("grams").alias("p", "h")).join(grams, "h")
    return hits.groupBy("key", "doc_id", "template", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.min("p").alias("low"), F.max("p").alias("high"))


def _least_votes(n: int, k: int, min_cover: float) -> int:
    """A word that differs spoils k grams at most, so a copy that covers enough of n words has at least so many votes."""
    return max(1, math.floor(n * (1 - k * (1 - min_cover))) - (k - 1))


def _spans(votes: DataFrame, sizes: list[int], k: int, min_cover: float) -> DataFrame:
    """key, doc_id, spans: [(template, low, high)] of the stretches of diagonals that might cover enough of the template."""
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("template") + 1)
    half = of([max(1, n // 2) for n in sizes])
    last = F.floor(F.col("diagonal") / half)
    stretches = votes.withColumn("stretch", F.explode(F.array(last - 1, last)))
    sums = stretches.groupBy("key", "doc_id", "template", "stretch").agg(F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"))
    enough = sums.where(F.col("votes") >= of([_least_votes(n, k, min_cover) for n in sizes]))
    return enough.groupBy("key", "doc_id").agg(F.collect_set(F.struct("template", "low", "high")).alias("spans"))  # fewer than the document's words


def alignment(template: list[bytes], part: list[bytes]) -> tuple[float, float, int, int]:
    """Share of the template's words that an order-keeping alignment with the part matches, their share of the words they
    span, and where in the part the first and last stand."""
    blocks = [b for b in difflib.SequenceMatcher(None, template, part, autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return 0.0, 0.0, 0, 0
    n, first, last = sum(b.size for b in blocks), blocks[0].b, blocks[-1].b + blocks[-1].size - 1
    return n / len(template), n / (last - first + 1), first, last


def method_labels(docs: DataFrame, templates=license_texts.TEMPLATES, k: int = K, min_cover: float = MIN_COVER, min_density: float = MIN_DENSITY) -> DataFrame:
    """docs (key, doc_id, text) -> key, doc_id, found: [(label, first word, last word, cover)] of verified spans."""
    sizes = [len(w) for w in _template_words(templates)]
    spans = state.keep(_spans(_votes(docs, templates, k), sizes, k, min_cover), "license-spans")
    might = semi.might_hold(spans.select("key"), spans.count())
    kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))

    def run(batches):
        known = _template_words(templates)
        for batch in batches:
            out = []
            for text, spans_ in zip(batch.column(2), batch.column(3), strict=True):
                w, found = words((text.as_py() or "").encode("utf-8")), {}
                for x in spans_.as_py():
                    t = known[x["template"]]
                    lo = max(0, x["low"] - k)
                    cover, density, first, last = alignment(t, w[lo : x["high"] + 2 * k])
                    if cover >= min_cover and density >= min_density:
                        found[templates[x["template"]][0], lo + first, lo + last] = cover
                out.append([{"label": label, "first": a, "last": b, "cover": c} for (label, a, b), c in sorted(found.items())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["key", "doc_id", "found"])

    own = spans.select(F.col("key").alias("key_"), F.col("doc_id").alias("id_"), "spans")
    candidates = docs.where(might.column(F.col("key"))).join(own, (F.col("key") == F.col("key_")) & F.col("doc_id").eqNullSafe(F.col("id_")))
    return candidates.select("key", "doc_id", "text", "spans").mapInArrow(run, "key long, doc_id long, found array<struct<label string, first long, last long, cover double>>")


def with_keys(docs: DataFrame) -> DataFrame:
    """key (of id and text), doc_id, text: what tells rows apart whose results may differ."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def scan(docs: DataFrame) -> DataFrame:
    """Base places and the method's labels of every row."""
    docs = with_keys(docs)
    found = method_labels(docs).groupBy("key", "doc_id").agg(F.first("found").alias("found")).select(F.col("key").alias("key_"), F.col("doc_id").alias("id_"), "found")
    both = base_places(docs).join(found, (F.col("key") == F.col("key_")) & F.col("doc_id").eqNullSafe(F.col("id_")), "left")
    own = F.transform(F.coalesce("found", F.expr("cast(array() as array<struct<label:string,first:bigint,last:bigint,cover:double>>)")), lambda x: x["label"])
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    score = F.coalesce(F.array_max(F.transform("found", lambda x: x["cover"])), F.lit(0.0))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(base, own)))).alias("labels"), score.alias("score"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
