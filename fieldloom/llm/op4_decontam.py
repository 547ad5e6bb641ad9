"""Benchmark decontamination: a BM25 inverted index of test items, asked by every training passage.

Items are cut into entries of at most ENTRY_WORDS words; a term's weight in an entry is its BM25 weight divided by the
entry's score for its own text, so that scores run from 0 to 1 and one threshold serves all entries.  Passages are
windows of PASSAGE words, half overlapping, over whole documents.

Weak-AND with block maxima, in two steps that leave out only what can't reach the threshold:
  * in bulk, for all passages of a block of text: an entry's lightest terms, as long as they sum to no more than LIGHT of
    the threshold, can't qualify it alone; only the postings of its other (essential) terms are added up, and a passage
    whose every sum plus the entry's lighter rest stays below the threshold is done;
  * for the others, the cursor search: postings in entry order, in blocks with their maximum, pivot by the terms'
    maxima, blocks skipped by theirs.
Every retrieved passage and entry is verified: the shares of the item's question trigrams and answer bigrams in the
document around the passage.  A document's score for an item is the best among the passages that pass.  Documents never
shuffle.  Postings and their statistics are made by grouped aggregation over the items, dealt by item to groups of about
GROUP_TERMS postings, and each group's index is built by a task; the driver passes on one group's at a time.  More groups
take more scans, not larger broadcasts.

Defined results.  Null or empty text: no passage.  Items without words take no part; items
without an id do, with a null id.  Null doc_id: judged, id null.
Repeated rows are judged each.  A text of any length is searched whole, held by one task at a time.  Items of equal text are
items of their own.  An empty table on either side gives no leak.  Other columns are carried by ``decontaminate`` as they
are, whatever their names.
"""

from __future__ import annotations

import bisect
import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import state
from . import textblocks as tb

K1, B = 1.2, 0.75
ENTRY_WORDS, PASSAGE = 48, 128
THRESHOLD, MIN_QUESTION, MIN_ANSWER = 0.5, 0.5, 0.5
BLOCK = 32
#: Share of the threshold that an entry's inessential terms may sum to: less means longer bulk sums, fewer searches.
LIGHT = 0.4
GROUP_TERMS = 1_000_000
#: Groups whose scans follow each other in one plan.
CHAIN = 4
SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def words(text: str) -> list[str]:
    return [w.decode("utf-8") for w in re.findall(rb"[0-9a-z\x80-\xff]+", bytes(tb.LOWER[np.frombuffer(text.encode("utf-8"), np.uint8)]))]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence or line is the answer; of a single sentence, its last third."""
    parts = [p for p in (words(x) for x in re.split(r"[.!?\n]+", text)) if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    w = parts[0] if parts else []
    cut = len(w) - max(1, len(w) // 3) if len(w) > 1 else 0
    return (w[:cut] or w), w[cut:]


def _grams(w: list[str], n: int) -> set[tuple[str, ...]]:
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


@dataclass
class Index:
    """Postings of a group of entries: for each term, entries in order and weights; and those of the essential terms."""

    items: list[tuple[int | None, str]]  # item_id, text
    entry_item: np.ndarray
    vocabulary: np.ndarray  # sorted hashes
    starts: np.ndarray  # by term (CSR)
    entries: np.ndarray
    weights: np.ndarray
    maximum: np.ndarray  # by term
    essential: tuple[np.ndarray, np.ndarray, np.ndarray]  # start by term (CSR), entry, weight
    rest: np.ndarray  # by entry: sum of its lighter terms' weights
    lists: dict = field(default_factory=dict)  # of the terms asked for: entries, weights, maxima over blocks of entries

    def of(self, term: int) -> tuple[list[int], list[float], dict[int, float]]:
        if term not in self.lists:
            at = slice(self.starts[term], self.starts[term + 1])
            entries, weights = self.entries[at].tolist(), self.weights[at].tolist()
            most: dict[int, float] = {}
            for e, x in zip(entries, weights, strict=True):
                most[e // BLOCK] = max(most.get(e // BLOCK, 0.0), x)
            self.lists[term] = entries, weights, most
        return self.lists[term]


def _hash_words(ws: list[str]) -> np.ndarray:
    raw = [w.encode("utf-8") for w in ws]
    ends = np.cumsum([len(r) for r in raw]) if raw else np.zeros(0, np.int64)
    return tb.range_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - np.array([len(r) for r in raw], np.int64), ends)


def _entry_batches(batches) -> Iterator[pa.RecordBatch]:
    """item, item_id, text -> item, entry, length, terms, counts: parts of at most ENTRY_WORDS words."""
    for batch in batches:
        out = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            w = words(text)
            n = max(1, math.ceil(len(w) / ENTRY_WORDS))
            step = math.ceil(len(w) / n) if w else 1
            for k, a in enumerate(range(0, len(w), step)):
                held = Counter(w[a : a + step])
                out.append((item, k, sum(held.values()), tb.as_long(_hash_words(list(held))).tolist(), list(held.values())))
        if out:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["item", "entry", "length", "terms", "counts"])


def make_index(items: list[tuple[int | None, str]], entry_item: np.ndarray, entry: np.ndarray, term: np.ndarray, weight: np.ndarray, threshold: float) -> Index:
    """The index of postings (entry number, term hash, BM25 weight)."""
    own = np.bincount(entry, weights=weight, minlength=len(entry_item))
    x = weight / own[entry]
    order = np.lexsort((term, x, entry))  # each entry's lightest first
    entry, term, x = entry[order], term[order], x[order]
    sums = np.cumsum(x)
    begin = np.searchsorted(entry, np.arange(len(entry_item)))
    sums -= (sums - x)[begin][entry]
    light = sums < threshold * LIGHT
    rest = np.zeros(len(entry_item))
    np.maximum.at(rest, entry[light], sums[light])
    order = np.lexsort((entry, term))
    entry, term, x, light = entry[order], term[order], x[order], light[order]
    vocabulary, starts = np.unique(term, return_index=True)
    place = np.searchsorted(vocabulary, term)
    heavy = ~light
    essential = (np.concatenate(([0], np.cumsum(np.bincount(place[heavy], minlength=len(vocabulary))))), entry[heavy], x[heavy])
    return Index(items, entry_item, vocabulary, np.append(starts, len(term)), entry, x, np.maximum.reduceat(x, starts) if len(x) else x, essential, rest)


def build_indexes(benchmark: DataFrame, threshold: float = THRESHOLD) -> Iterator[Index]:
    """Statistics over all entries of benchmark (item_id, text); one index for each group of items."""
    spark, kept = benchmark.sparkSession, []

    def keep(df, name):
        kept.append(state.keep(df, name))
        return kept[-1]

    try:
        items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
        items = keep(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")  # numbered once
        entries = keep(items.mapInArrow(_entry_batches, "item long, entry int, length int, terms array<long>, counts array<int>"), "entries")
        n, mean, total = entries.agg(F.count(F.lit(1)), F.avg("length"), F.sum(F.size("terms"))).first()
        if not n:
            return
        groups = -(-int(total) // GROUP_TERMS)
        group = F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int").alias("group")
        postings = entries.select("item", "entry", "length", F.explode(F.arrays_zip("terms", "counts")).alias("p")).select("item", "entry", "length", F.col("p.terms").alias("term"), F.col("p.counts").alias("f"))
        df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        rows = postings.join(df, "term").select(group, "item", "entry", "term", weight.alias("weight"), none("long", "item_id"), none("string", "text"))
        rows = rows.unionAll(items.select(group, "item", none("int", "entry"), none("long", "term"), none("double", "weight"), "item_id", "text"))

        def make(table: pa.Table) -> pa.Table:
            texts = table.filter(pc.is_null(table.column("entry")))
            numbers = texts.column("item").to_numpy()
            at = np.argsort(numbers)
            held = list(zip(texts.column("item_id").to_pylist(), texts.column("text").to_pylist(), strict=True))
            posted = table.filter(pc.is_valid(table.column("entry")))
            item = np.searchsorted(numbers[at], posted.column("item").to_numpy())
            both = item * np.int64(1 << 31) + posted.column("entry").to_numpy()
            names, entry = np.unique(both, return_inverse=True)
            index = make_index([held[i] for i in at], names >> 31, entry, posted.column("term").to_numpy().view(np.uint64), posted.column("weight").to_numpy(), threshold)
            return pa.table({"group": pa.array([table.column("group")[0].as_py()], pa.int32()), "index": pa.array([pickle.dumps(index)], pa.binary())})

        made = keep(rows.groupBy("group").applyInArrow(make, "group int, index binary"), "item-indexes")
        for g in range(groups):
            for row in made.where(F.col("group") == g).collect():  # one, of about GROUP_TERMS postings
                yield pickle.loads(row["index"])
    finally:
        state.release(spark, *kept)


def block_max_wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """All entries whose weights for ``terms`` (distinct) sum to the threshold or more, in entry order."""
    least = threshold - 1e-9
    held = {t: index.of(t) for t in terms}
    cursors = [[held[t][0][0], 0, t] for t in terms]  # current entry, place, term
    found = []
    while cursors:
        cursors.sort(key=lambda c: c[0])
        total, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            total += index.maximum[c[2]]
            if total >= least:
                pivot = k
                break
        if pivot < 0:
            break
        entry = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == entry:
            pivot += 1
        block = entry // BLOCK
        bound = sum(held[c[2]][2].get(block, 0.0) for c in cursors[: pivot + 1])
        if bound < least:  # nothing in this block can qualify before another list joins in
            to = (block + 1) * BLOCK
            if pivot + 1 < len(cursors):
                to = min(to, cursors[pivot + 1][0])
            to = max(to, entry + 1)
        elif cursors[0][0] == entry:
            score = sum(held[c[2]][1][c[1]] for c in cursors[: pivot + 1])
            if score >= least:
                found.append((entry, score))
            to = entry + 1
        else:
            to = entry
        alive = []
        for k, c in enumerate(cursors):
            if k <= pivot and c[0] < to:
                es = held[c[2]][0]
                c[1] = bisect.bisect_left(es, to, c[1])
                if c[1] == len(es):
                    continue
                c[0] = es[c[1]]
            alive.append(c)
        cursors = alive
    return found


def _passages(first: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last token (exclusive) of each passage: windows of ``passage`` words every half of it."""
    half = passage // 2
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, -(-(n - half) // half)), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(int(count.sum())) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
    lo = first[:-1][row] + k * half
    return row, lo, np.minimum(lo + passage, first[1:][row])


Found = dict[tuple[int, int], dict[tuple[int, int], float]]


def retrieve(index: Index, lower: np.ndarray, tokens: tuple[np.ndarray, np.ndarray, np.ndarray], threshold: float, passage: int = PASSAGE) -> Found:
    """Row and item -> the passages (first and last token, exclusive) whose score for one of its entries is the threshold or
    more, and the best such score."""
    found: Found = defaultdict(dict)
    s, e, first = tokens
    if not len(index.vocabulary) or not len(s):
        return found
    h = tb.range_hashes(lower, s, e)
    term = np.searchsorted(index.vocabulary, h)
    term[term == len(index.vocabulary)] = 0
    known = index.vocabulary[term] == h
    starts, entries, weights = index.essential
    heavy = known & (starts[term + 1] > starts[term])
    row, lo, hi = _passages(first, passage)
    # bulk: sums over essential postings
    at = np.flatnonzero(heavy)
    if not len(at):
        return found
    a, b = np.searchsorted(at, lo), np.searchsorted(at, hi)
    n = b - a
    p = np.repeat(np.arange(len(lo)), n)
    t = term[at[np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))]]
    pair = np.unique(p * np.int64(len(index.vocabulary)) + t)
    p, t = pair // len(index.vocabulary), pair % len(index.vocabulary)
    m = starts[t + 1] - starts[t]
    where = np.repeat(starts[t] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(int(m.sum()))
    key = np.repeat(p, m) * np.int64(len(index.rest)) + entries[where]
    keys, inverse = np.unique(key, return_inverse=True)
    total = np.bincount(inverse, weights=weights[where], minlength=len(keys)) + index.rest[keys % len(index.rest)]
    alive = np.unique(keys[total >= threshold - 1e-9] // len(index.rest))
    for q in alive.tolist():
        terms = np.unique(term[lo[q] : hi[q]][known[lo[q] : hi[q]]]).tolist()
        for entry, score in block_max_wand(index, terms, threshold):
            at = found[int(row[q]), int(index.entry_item[entry])]
            where = (int(lo[q]), int(hi[q]))
            at[where] = max(at.get(where, 0.0), score)
    return found


def find_in_block(index: Index, buf: np.ndarray, offs: np.ndarray, threshold: float, min_question: float, min_answer: float, passage: int = PASSAGE) -> Iterator[tuple[int, int | None, float, float, float, int]]:
    """Leaks of a block: row, item_id, score, question and answer overlap, first word; of each, the best passage that passes."""
    lower = tb.LOWER[buf]
    s, e, first = tb.tokens(lower, offs, tb.ALNUM_BYTE)
    found = retrieve(index, lower, (s, e, first), threshold, passage)
    raw = lower.tobytes() if found else b""
    for (r, i), places in sorted(found.items()):
        item_id, text = index.items[i]
        question, answer = question_and_answer(text)
        reach = len(question) + len(answer)
        share = lambda w, n, near: (lambda g: len(g & _grams(near, min(n, len(w)))) / len(g) if g else 0.0)(_grams(w, n))
        for (x, y), score in sorted(places.items(), key=lambda at: (-at[1], at[0])):  # the best that passes
            x0, y0 = max(int(first[r]), x - reach), min(int(first[r + 1]), y + reach)
            near = [raw[s[j] : e[j]].decode("utf-8") for j in range(x0, y0)]
            q_share, a_share = share(question, 3, near), share(answer, 2, near)
            if q_share >= min_question and a_share >= min_answer:
                yield r, item_id, score, q_share, a_share, x - int(first[r])
                break


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_question: float = MIN_QUESTION, min_answer: float = MIN_ANSWER) -> DataFrame:
    """One row a document and item that it holds: see SCHEMA."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]

    def run(held):
        def scan(batches):
            for batch in batches:
                out = []
                for block in tb.blocks(batch.column(1)):
                    out += [(batch.column(0)[block.lo + r].as_py(), *more) for r, *more in find_in_block(held.value, block.buf, block.offs, threshold, min_question, min_answer)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        return docs.mapInArrow(scan, SCHEMA)

    found = [run(spark.sparkContext.broadcast(index)) for index in build_indexes(benchmark, threshold)]  # an item is in one group
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_question: float = MIN_QUESTION, min_answer: float = MIN_ANSWER) -> DataFrame:
    """``docs`` without the documents that hold a test item; no shuffle, columns as they are."""
    spark, text_at = docs.sparkSession, docs.columns.index("text")
    for n, index in enumerate(build_indexes(benchmark, threshold)):
        if n and n % CHAIN == 0:  # each scan of a plan has a worker of its own
            docs = state.keep(docs, "decontaminated")

        def scan(batches, held=spark.sparkContext.broadcast(index)):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for block in tb.blocks(batch.column(text_at)):
                    for r, *_ in find_in_block(held.value, block.buf, block.offs, threshold, min_question, min_answer):
                        clean[block.lo + r] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
