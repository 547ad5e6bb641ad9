"""Finding where documents share windows of text, without shuffling every window.

Both substring operators ask which windows of a fixed length occur at another place.  Here:

1. In every window the k-gram with the smallest hash is its *anchor*.  Equal windows have equal anchors, and neighbouring
   windows mostly share theirs, so some 7 % of the positions are anchors.
2. Filters over all anchors (``twice``) leave those that may recur; only they shuffle (hash, document, position) and are
   confirmed to recur.  Across documents, anchors that come twice are counted exactly and the filter holds only these;
   otherwise a once-seen and a twice-seen Bloom filter do.
3. A recurring anchor's owner is the smallest document that holds it, so what copies share goes to one group: groups are
   dealt to shards by owner.  Equal pieces of text are counted before they meet, so one passage in a third of all documents
   is one piece with a count; an owner with more than ``Sizes.owner`` places amid different texts is split into stretches.
4. An anchor that stands in more than ``Sizes.hot`` places amid many different texts would still bring as many different
   pieces to one shard.  Another pair of filters, over the windows of such anchors, leaves those windows that may recur; a
   run of them is a piece, and what surrounds it stays behind, so that a passage is one piece whatever stands around it.
   Where an anchor's runs still differ much, each of their windows is a piece of its own, dealt out by its hash.
5. Documents send to each shard the pieces around their recurring anchors, wide enough for all windows that have them.
   What a shard says of a piece goes back to the documents that hold the piece.  A task writes a piece's text once.

A window meets all its equals, since they have the same anchor and it belongs to one shard, or goes by its own hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import semi, state, twice
from . import textblocks as tb

@dataclass(frozen=True)
class Sizes:
    """What goes to a shard.  Smaller numbers deal work more evenly, larger ones cost less."""

    #: Anchors, or runs, amid different texts, on average.
    mean: int = 2_000
    #: Places of one owner's anchors, amid different texts; an owner with more is split.
    owner: int = 8_000
    #: An anchor is hot at more places than this, amid HOT_KINDS of 64 kinds of surroundings or more.
    hot: int = 4_000


HOT_KINDS = 60
#: Bits for each window of a hot anchor, as multiples of the filters' usual: false suspects make runs differ.
WINDOW_BITS = 2
#: Shards from this number on hold runs of windows.
RUN_SHARDS = 1 << 41
#: Digests of pieces whose text a task remembers to have written.
REMEMBERED = 100_000


def _sliding(x: np.ndarray, width: int, better: Callable) -> np.ndarray:
    """better over x[i : i + width], for each i where that fits."""
    have, n = 1, len(x) - width + 1
    if n <= 0:
        return x[:0]
    while have * 2 <= width:
        x = better(x[:-have], x[have:])
        have *= 2
    return better(x[:n], x[width - have : width - have + n]) if have < width else x[:n]


def least_hashes(h: np.ndarray, first: np.ndarray, k: int, window: int) -> np.ndarray:
    """For each item: the smallest k-gram hash of the window that begins there; 0 where none fits in the row.  h: the k-grams'
    hashes; first: rows' first items."""
    n, width = int(first[-1]), window - k + 1
    least = _sliding(h, width, np.minimum)[: max(0, n - window + 1)]
    last = np.repeat(first[1:], np.diff(first))[: len(least)]  # where each item's row ends
    return np.where(np.arange(window, window + len(least)) <= last, least, np.uint64(0))


def minimizers(h: np.ndarray, first: np.ndarray, k: int, window: int) -> np.ndarray:
    """Positions that are the anchor of some window."""
    width, least = window - k + 1, least_hashes(h, first, k, window)
    if not len(least):
        return np.zeros(0, np.int64)
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    most = _sliding(padded, width, np.maximum)
    return np.flatnonzero((most == h[: len(most)]) & (most > 0))


def surroundings(h: np.ndarray, first: np.ndarray, row: np.ndarray, at: np.ndarray, k: int, window: int) -> np.ndarray:
    """One of 64 kinds for each anchor: the same for equal text around it, as far as its windows reach."""
    lo, hi, reach = first[row], first[row + 1] - k, window - k
    kind = np.zeros(len(at), np.uint64)
    for step in (-reach, -(reach // 2), reach // 2, reach):
        kind = tb.mix(kind + h[np.clip(at + step, lo, hi)])
    return (kind & np.uint64(63)).astype(np.int8)


#: A column of texts -> blocks, each with its rows' first items, the k-gram hashes, and a function that hashes the windows
#: that begin at given items.
Grams = Callable[[pa.Array], Iterator[tuple[tb.Block, np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]]]


def _lists(ids: pa.Array, block: tb.Block, rows: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    """A row for each document of the block that has any: doc and lists of the columns' values (rows: theirs, ascending)."""
    n = np.bincount(rows, minlength=block.rows)
    some = np.flatnonzero(n)
    offsets = pa.array(np.concatenate(([0], np.cumsum(n[some]))).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, c) for c in columns.values()]
    return pa.RecordBatch.from_arrays([ids.slice(block.lo, block.rows).take(pa.array(some)), *lists], names=["doc", *columns])


def _kept(scan: Callable, filter_: twice.Twice, name: str, spark) -> DataFrame:
    """What a scan with a filter gives; the filter is on the executors meanwhile."""
    held = spark.sparkContext.broadcast(filter_)
    out = state.keep(scan(held), name)
    held.unpersist()
    return out


def _runs(docs: DataFrame, lists: DataFrame, grams: Grams, k: int, window: int, hot: DataFrame, places: int, across: bool, sizes: Sizes) -> DataFrame:
    """docs (doc, text), lists (doc, h: its suspected anchors), hot (h): -> doc, pos, n, shard of the runs of n windows from
    pos on that may recur, of hot anchors."""
    spark = docs.sparkSession
    might = semi.might_hold(hot, hot.count())

    def with_hot(batches):
        for batch in batches:
            keys = batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(keys.offsets)))
            hit = might.test_keys(np.asarray(keys.flatten()).astype(np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.unique(row[hit])))], names=["doc"])

    holders = state.keep(lists.select("doc", "h").mapInArrow(with_hot, "doc long"), "hot-docs")
    holds = semi.might_hold(holders, holders.count())

    def windows(column):
        """Blocks with first windows' items, rows, least hashes and keys of the windows whose anchor may be hot."""
        for block, first, h, keys_at in grams(column):
            least = least_hashes(h, first, k, window)
            at = np.flatnonzero(least > 0)
            at = at[might.test_keys(least[at])]
            if len(at):
                yield block, first, np.searchsorted(first, at, side="right") - 1, at, least[at], keys_at(at)

    def keys(batch):
        for _, _, rows, _, _, key in windows(batch.filter(pa.array(holds.test(batch.column(0)))).column(1)):
            yield tb.distinct_in_rows(rows, key)[1] if across else key

    def runs(filter_):
        def run(batches):
            for batch in (b.filter(pa.array(holds.test(b.column(0)))) for b in batches):
                for block, first, rows, at, least, key in windows(batch.column(1)):
                    hit = np.flatnonzero(filter_.value.test(key))
                    if not len(hit):
                        continue
                    rows, at, least, key = rows[hit], at[hit], least[hit], key[hit]
                    new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]))))
                    n = np.diff(np.append(new, len(at)))
                    kind = np.add.reduceat(tb.mix(key), new)
                    columns = {"h": pa.array(tb.as_long(least[new])), "pos": pa.array(at[new] - first[rows[new]], pa.int32()), "kind": pa.array(tb.as_long(kind)), "keys": tb.list_array(n, tb.as_long(key), pa.int64())}
                    yield _lists(batch.column(0), block, rows[new], **columns)

        return docs.select("doc", "text").mapInArrow(run, "doc long, h array<long>, pos array<int>, kind array<long>, keys array<array<long>>")

    expected = places * (window - k + 1) * WINDOW_BITS // 2  # a window has one anchor: on average, half of those it could have
    filters = (twice.build(docs.select("doc", "text"), keys, expected, share) for share in twice.shares(expected))
    found = reduce(DataFrame.unionAll, [_kept(runs, f, "runs", spark) for f in filters])
    holds.done()
    might.done()
    found = found.select("doc", F.explode(F.arrays_zip("h", "pos", "kind", "keys")).alias("r")).select("doc", "r.*")
    # different runs of an anchor: near copies of one passage make some (window - k)^2 / 2 at most
    by_anchor = found.groupBy("h", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    by_anchor = state.keep(by_anchor, "run-anchors")
    calm, wild = by_anchor.where(F.col("kinds") <= sizes.hot), by_anchor.where(F.col("kinds") > sizes.hot)
    shards = max(1, -(-int(calm.agg(F.sum("n")).first()[0] or 0) // sizes.mean))
    whole = found.join(calm.select("h"), "h").select("doc", "pos", F.size("keys").alias("n"), (F.lit(RUN_SHARDS) + F.pmod(F.xxhash64("h"), F.lit(shards))).alias("shard"))
    n_wild = wild.agg(F.sum("n")).first()[0]
    if not n_wild:
        return whole
    shards = max(1, -(-int(n_wild) * (window - k + 1) // sizes.mean))
    single = found.join(wild.select("h"), "h").select("doc", "pos", F.posexplode("keys").alias("i", "key"))
    return whole.unionAll(single.select("doc", F.col("pos") + F.col("i"), F.lit(1), F.lit(RUN_SHARDS << 1) + F.pmod(F.xxhash64("key"), F.lit(shards))))


def recurring(docs: DataFrame, grams: Grams, k: int, window: int, expected: int, across: bool, sizes: Sizes) -> DataFrame:
    """docs (doc, text) -> doc, at: [(pos, n, shard)] of its recurring anchors (n is 0), and of the runs of n windows that
    are pieces of their own.

    across: only anchors of two or more documents recur; else also those of one document that occur twice in it."""
    spark = docs.sparkSession

    def anchors(column):
        for block, first, h, _ in grams(column):
            at = minimizers(h, first, k, window)
            yield block, first, np.searchsorted(first, at, side="right") - 1, at, h

    def keys(batch):
        for _, _, rows, at, h in anchors(batch.column(0)):
            yield tb.distinct_in_rows(rows, h[at])[1] if across else h[at]

    def suspects(filter_):
        def run(batches):
            for batch in batches:
                for block, first, rows, at, h in anchors(batch.column(1)):
                    hit = np.flatnonzero(filter_.value.test(h[at]))
                    rows, at = rows[hit], at[hit]
                    kind = surroundings(h, first, rows, at, k, window)
                    yield _lists(batch.column(0), block, rows, h=pa.array(tb.as_long(h[at])), pos=pa.array(at - first[rows], pa.int32()), kind=pa.array(kind))

        return docs.select("doc", "text").mapInArrow(run, "doc long, h array<long>, pos array<int>, kind array<tinyint>")

    with state.steps(spark) as outlives:
        if across:
            filters = [twice.build_counted(docs.select("text"), keys, expected)]
        else:
            filters = (twice.build(docs.select("text"), keys, expected, share) for share in twice.shares(expected))
        lists = reduce(DataFrame.unionAll, [_kept(suspects, f, "anchors", spark) for f in filters])
        rows = lists.select("doc", F.explode(F.arrays_zip("h", "pos", "kind")).alias("a")).select("doc", "a.h", "a.pos", "a.kind")
        seen = rows.groupBy("h").agg(F.min("doc").alias("owner"), F.max("doc").alias("top"), F.count(F.lit(1)).alias("n"), F.expr("bit_count(bit_or(shiftleft(1L, int(kind))))").alias("kinds"), F.min_by("pos", "doc").alias("place"))
        # how many different texts stand around it: by linear counting, until all kinds are there
        texts = F.when(F.col("kinds") < HOT_KINDS, F.least(F.col("n"), F.ceil(F.log(64 / (64 - F.col("kinds"))) * 64))).otherwise(F.col("n"))
        hot = (F.col("n") > sizes.hot) & (F.col("kinds") >= HOT_KINDS)
        seen = state.keep(seen.where("owner < top" if across else "n > 1").select("h", "owner", "n", "place", texts.alias("texts"), hot.alias("hot")), "recurring")
        calm = seen.where("not hot")
        total, hot_places = seen.agg(F.sum(F.when(~F.col("hot"), F.col("texts"))), F.sum(F.when(F.col("hot"), F.col("n")))).first()
        shards = max(1, -(-int(total or 0) // sizes.mean))
        heavy = calm.groupBy("owner").agg(F.sum("texts").alias("load"), F.max("place").alias("last")).where(F.col("load") > sizes.owner)
        # owners of many: each stretch of their text a shard, numbered beyond the others
        stretch = F.floor(F.col("place") * F.ceil(F.col("load") / sizes.owner) / (F.col("last") + 1))
        shard = F.when(F.col("load").isNull(), F.pmod(F.xxhash64("owner"), F.lit(shards))).otherwise(F.lit(1 << 40) + F.pmod(F.xxhash64("owner", stretch), F.lit(1 << 40)))
        places = rows.select("doc", "h", "pos").join(calm.join(heavy, "owner", "left").select("h", shard.alias("shard")), "h").select("doc", "pos", F.lit(0).alias("n"), "shard")
        if hot_places:
            places = places.unionAll(_runs(docs, lists, grams, k, window, seen.where("hot").select("h"), int(hot_places), across, sizes))
        at = state.keep(places.groupBy("doc").agg(F.collect_list(F.struct("pos", "n", "shard")).alias("at")), "anchor-lists")
        outlives(at)
    return at


def spans(row: np.ndarray, pos: np.ndarray, n: np.ndarray, shard: np.ndarray, k: int, window: int, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces (row, shard, begin, end) that hold all windows around the anchors (row, pos, shard) of rows of ``length``
    items, merged within a row and shard; of a run of n windows, its own."""
    run = n > 0
    lo, hi = np.where(run, pos, np.maximum(0, pos + k - window)), np.where(run, pos + n - 1, np.minimum(pos, length[row] - window))
    fits = hi >= lo
    row, shard, lo, hi = row[fits], shard[fits], lo[fits], hi[fits]
    order = np.lexsort((hi, lo, shard, row))
    row, shard, lo, hi = row[order], shard[order], lo[order], hi[order]
    if not len(row):
        return row, shard, lo, hi
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (shard[1:] != shard[:-1]) | (lo[1:] > hi[:-1] + 1) | (shard[1:] >= RUN_SHARDS)))
    start = np.flatnonzero(new)
    last = np.concatenate((start[1:], [len(row)])) - 1  # hi grows with lo within a row
    return row[start], shard[start], lo[start], hi[last] + window


def fingerprint(text: bytes) -> int:
    return int.from_bytes(blake2b(text, digest_size=8).digest(), "little", signed=True)


def pieces(docs: DataFrame, at: DataFrame, cut: Callable[..., Iterator[tuple[int, int, int, bytes, bytes]]]) -> DataFrame:
    """shard, piece (digest of its content), doc, mark (of the text), begin, content, note; kept in the shared folder, ``at``
    is removed.  Content and note are null where the task has lately written the same piece.

    ``cut`` gives for some texts and their anchors (row, pos, n, shard): row, shard, begin, content, note (a function of the
    content)."""
    might = semi.might_hold(at.select("doc"), at.count())
    schema = pa.schema([("shard", pa.int64()), ("piece", pa.binary()), ("doc", pa.int64()), ("mark", pa.int64()), ("begin", pa.int32()), ("content", pa.binary()), ("note", pa.binary())])

    def run(batches):
        written: set[tuple[int, bytes]] = set()

        def piece(shard, content, note):
            digest = blake2b(content, digest_size=16).digest()
            if (shard, digest) in written:
                return digest, None, None
            if len(written) >= REMEMBERED:
                written.clear()
            written.add((shard, digest))
            return digest, content, note

        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                texts = [(t.as_py() or "").encode("utf-8") for t in batch.column(1)]
                docs_, marks = batch.column(0).to_pylist(), [fingerprint(t) for t in texts]
                pos, n, shard = (batch.column(i) for i in (2, 3, 4))
                row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(pos.offsets)))
                cuts = cut(texts, row, np.asarray(pos.flatten()).astype(np.int64), np.asarray(n.flatten()).astype(np.int64), np.asarray(shard.flatten()))
                out = [(s, digest, docs_[r], marks[r], begin, text, more) for r, s, begin, content, note in cuts for digest, text, more in [piece(s, content, note)]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    joined = docs.select("doc", "text").where(might.column(F.col("doc"))).join(at, "doc").select("doc", "text", *[F.col(f"at.{c}").alias(c) for c in ("pos", "n", "shard")])
    cut_up = state.keep(joined.mapInArrow(run, "shard long, piece binary, doc long, mark long, begin int, content binary, note binary"), "pieces")
    might.done()
    state.release(docs.sparkSession, at)
    return cut_up


def by_shard(found: DataFrame, solve: Callable[[list[tuple[int, int, bytes, bytes]]], Iterator[tuple[int, int, int, int]]], least: str) -> DataFrame:
    """Shows each shard's distinct pieces to ``solve`` and joins its answers to the documents that hold the pieces.

    solve: pieces as (smallest doc, count, content, note) -> (index of the piece, lo, hi, value): items lo .. hi - 1.
    least: a condition on doc, first (the piece's smallest document), count and value.  Result, kept: doc, ranges: [(mark,
    lo, hi)]; ``found`` is removed."""
    distinct = found.groupBy("shard", "piece").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("count"), F.first("content", ignorenulls=True).alias("content"), F.first("note", ignorenulls=True).alias("note"))

    def run(batches):
        def answer(rows):
            got = [(rows[i][0], rows[i][1], rows[i][2], rows[i][3], lo, hi, value) for i, lo, hi, value in solve([r[2:] for r in rows])]
            if got:
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)],
                    names=["shard", "piece", "first", "count", "lo", "hi", "value"],
                )

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    if (out := answer(held)) is not None:
                        yield out
                    held = []
                held.append(row)
        if held and (out := answer(held)) is not None:
            yield out

    dealt = distinct.select("shard", "piece", "first", "count", "content", "note").repartition("shard").sortWithinPartitions("shard")
    answers = state.keep(dealt.mapInArrow(run, "shard long, piece binary, first long, count long, lo int, hi int, value long"), "answers")
    places = found.select("shard", "piece", "doc", "mark", "begin").join(answers, ["shard", "piece"]).where(least)
    ranges = F.struct("mark", (F.col("begin") + F.col("lo")).alias("lo"), (F.col("begin") + F.col("hi")).alias("hi"))
    held = state.keep(places.groupBy("doc").agg(F.collect_set(ranges).alias("ranges")), "ranges")
    state.release(found.sparkSession, found, answers)
    return held


def with_ranges(docs: DataFrame, held: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Applies ``run`` to batches of docs (doc_id, text, ranges: what ``held`` (doc, ranges) has of the document, or null).  Only the texts of documents
    that have ranges shuffle."""
    might = semi.might_hold(held.select("doc"), held.count())
    touched = docs.select("doc", "doc_id", "text").where(might.column(F.col("doc"))).join(held, "doc", "left").select("doc_id", "text", "ranges")

    def others(batches):
        def clean():
            for batch in batches:
                rest = batch.filter(pa.array(~might.test(batch.column(0))))
                yield pa.RecordBatch.from_arrays([rest.column(1), rest.column(2), pa.nulls(rest.num_rows)], names=["doc_id", "text", "ranges"])

        return run(clean())

    return touched.mapInArrow(run, schema).unionAll(docs.select("doc", "doc_id", "text").mapInArrow(others, schema))


def covered(text: bytes, ranges, length: int) -> np.ndarray | None:
    """Mask of the items that a text's own ranges cover; None if there are none."""
    if not ranges:
        return None
    mark = fingerprint(text)
    edge = np.zeros(length + 1, np.int32)
    some = False
    for r in ranges:
        if r["mark"] == mark:
            edge[r["lo"]] += 1
            edge[r["hi"]] -= 1
            some = True
    return np.cumsum(edge[:-1]) > 0 if some else None
