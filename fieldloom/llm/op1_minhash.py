"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct 5-word shingles.  Its sketch has M registers; register i is the exponentially
spaced, truncated minimum  floor(1 - log_BASE(min over the set of an Exp(RATE) hash_i)).  Registers of a union are the
larger ones (mergeable), and equal registers are as likely as the sets are similar (locality-sensitive).

1. Documents with equal sets become one class with the smallest doc_id as representative.
2. Bands of ROWS registers are hashed; a bucket with one class is dropped.  At similarity 0.75 all BANDS miss with
   probability (1 - 0.75^4)^32 = 5e-6.
3. In every bucket the class that collides most (in a group of copies: the original) is the hub; each member is paired
   with the hub only.  Pairs are judged by the joint likelihood of similarity given the set sizes and how many registers
   are larger, smaller and equal; those that 0.75 would fit far worse than the best fit are dropped, the rest are
   verified on the full sets.  Verified links give components.
4. In a bucket whose members aren't all in one component by then, every member outside its largest component meets every
   member, in cells of bounded size: a first pass over the sketches finds the classes that may have a link to another
   component (each pair in the first band that it shares); a second gets their full sets and verifies the likeliest pairs
   first, between what isn't connected yet.  Its rows are links of a forest; no stage emits all pairs of a group.  Where few
   members are left outside, what is shuffled grows with the bucket; a bucket that consists of nothing but unlinked
   members (texts just below the limit) has to be compared in full, some N * N / 1,000 rows.

Defined results.  Null or empty text, or no words: empty set, linked with nothing.  Fewer than 5 words: the sequence is
the one shingle.  Null doc_id: the row is returned with its set size, component and kept null.  Rows that share a doc_id
are one node, linked with all that any of their texts is linked with.
A text of any length is one set, held by one task at a time.  An empty table gives an empty table.  Extra columns are
ignored by ``near_duplicates`` and carried by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import components, semi, state
from . import textblocks as tb

WORDS, PERCENT = 5, 75
M, BASE, RATE, LEVELS = 128, 1.001, 20.0, 65534
ROWS = 4
#: Half the squared standard deviations by which a similarity of PERCENT must be off for a pair to be dropped.
DROP = 12.5
#: Rows, least and most, on the left and right of a cell of a bucket that is searched in full, and shingles on each side.
LEFT, RIGHT, BLOCK_SHINGLES = (128, 1024), (256, 2048), 1_000_000
PAIRS = 20_000  # judged at a time
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(7))
_XOR = _rng.integers(0, 2**63, M, dtype=np.uint64) * U(2)
_MUL = _rng.integers(0, 2**63, M, dtype=np.uint64) * U(2) + U(1)


def shingles(block: tb.Block, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle hash) of a block, by row."""
    lower = tb.LOWER[block.buf]
    s, e, first = tb.tokens(lower, block.offs, tb.WORD_BYTE)
    h = tb.range_hashes(lower, s, e)
    n = np.diff(first)
    full = np.maximum(n - (k - 1), 0)
    at = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(full)[:-1])), full) + np.arange(int(full.sum()))
    rows, keys = np.repeat(np.arange(block.rows), full), tb.gram_hashes(h, k)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = np.array([tb.gram_hashes(h[first[r] : first[r + 1]], int(n[r]))[0] ^ U(0x5BD1E995 * int(n[r])) for r in short], np.uint64)
        rows, keys = np.concatenate((rows, short)), np.concatenate((keys, own))
    return tb.distinct_in_rows(rows, keys)


def registers(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sketches (sets x M, uint16) of the non-empty sets that begin at ``starts`` in ``keys``."""
    least = np.empty((len(starts), M), np.uint64)
    for i in range(M):
        least[:, i] = np.minimum.reduceat((keys ^ _XOR[i]) * _MUL[i], starts)
    spread = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(spread, 1e-300)) / np.log(BASE)), 0, LEVELS + 1).astype(np.uint16)


def _begin(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have items, and where each one's begin."""
    some = np.flatnonzero(n)
    return some, np.concatenate(([0], np.cumsum(n[some])[:-1])).astype(np.int64) if len(some) else np.zeros(0, np.int64)


def _prints(keys: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """What equal sets share: two sums of their mixed hashes, 128 bits."""
    return [x.tobytes() for x in np.stack([np.add.reduceat(tb.mix(keys + U(salt)), starts) for salt in (1, 2)], axis=1)]


def _sketch_batches(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in tb.blocks(batch.column(1)):
            rows, keys = shingles(block)
            n = np.bincount(rows, minlength=block.rows)
            some, starts = _begin(n)
            regs, prints, marks = [None] * block.rows, [None] * block.rows, [None] * block.rows
            if len(some):
                sketch = registers(keys, starts)
                for i, (r, mark) in enumerate(zip(some.tolist(), _prints(keys, starts), strict=True)):
                    regs[r], prints[r], marks[r] = sketch[i].tobytes(), mark, int.from_bytes(mark[:8], "little", signed=True)
            ids = batch.column(0).slice(block.lo, block.rows).cast(pa.int64())
            columns = [ids, pa.array(n, pa.int64()), pa.array(marks, pa.int64()), pa.array(prints, pa.binary()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "mark", "print", "regs"])


def _band_batches(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        r = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, M)
        groups = r.reshape(len(r), M // ROWS, ROWS).astype(np.uint64)
        h = np.broadcast_to(np.arange(1, M // ROWS + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93), groups.shape[:2]).copy()
        for j in range(ROWS):
            h = tb.mix(h + groups[:, :, j] * U(0x9FB21C651E98DF25) + U(j))
        yield pa.RecordBatch.from_arrays([batch.column(0), tb.list_array(np.full(len(r), M // ROWS), tb.as_long(h.reshape(-1)), pa.int64()), batch.column(2)], names=["cls", "keys", "n"])


def _fit(x: np.ndarray) -> np.ndarray:
    """P(one register is larger by its own share x of the union), for registers spaced by BASE."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def _log_likelihood(j, u, v, more, less, same):
    p, q = np.maximum(_fit(np.maximum(u - v * j, 0)), 1e-12), np.maximum(_fit(np.maximum(v - u * j, 0)), 1e-12)
    return more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))


def judge(na, nb, more, less, same, limit: float = PERCENT / 100) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs may reach the limit, and the likeliest similarity of each, over a grid."""
    na, nb = np.asarray(na, float), np.asarray(nb, float)
    more, less, same = (np.asarray(x, float) for x in (more, less, same))
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    at_limit = _log_likelihood(limit, u, v, more, less, same)
    best, where = np.full(len(u), -np.inf), np.zeros(len(u))
    for share in np.linspace(0, 1, 81):
        x = _log_likelihood(top * share, u, v, more, less, same)
        better = x > best
        best, where = np.where(better, x, best), np.where(better, top * share, where)
    gap = np.maximum(best, at_limit) - at_limit
    return (top >= limit - 1e-12) & ((where >= limit) | (gap <= DROP)), where


def _counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (a > b).sum(axis=-1), (a < b).sum(axis=-1), (a == b).sum(axis=-1)


def _judge_batches(batches) -> Iterator[pa.RecordBatch]:
    """a, b, na, nb, ra, rb -> the pairs that may be links."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, M) for i in (4, 5))
        may, _ = judge(batch.column(2).to_numpy(), batch.column(3).to_numpy(), *_counts(a, b))
        keep = pa.array(may)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _least_same() -> int:
    """Fewer equal registers than this and no pair at the limit would be kept by the likelihood."""
    p = PERCENT / 100
    return int(M * p - np.sqrt(2 * DROP * M * p * (1 - p)) - 2)


def plausible(band, comps, left, rest, order, sizes, regs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of a cell's left and right rows that may be links between components, likeliest first, and how likely
    similar.

    Left rows are of the bucket's minor components; a right row may be of one too (``rest``), and is then looked at from
    the smaller of both by ``order`` only.  A pair is looked at in the bucket of the first band that it shares."""
    rights, floor = np.flatnonzero(~left), _least_same()
    found: list[tuple[np.ndarray, ...]] = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def judged() -> None:
        i, j = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting.clear()
        shared = (regs[i].reshape(-1, M // ROWS, ROWS) == regs[j].reshape(-1, M // ROWS, ROWS)).all(axis=2)
        first = shared.argmax(axis=1) == band
        i, j = i[first], j[first]
        if len(i):
            may, how = judge(sizes[i], sizes[j], *_counts(regs[i], regs[j]))
            found.append((i[may], j[may], how[may]))

    size = 0
    for i in np.flatnonzero(left):
        ok = (comps[rights] != comps[i]) & (sizes[rights] * 100 >= sizes[i] * PERCENT) & (sizes[i] * 100 >= sizes[rights] * PERCENT)
        ok &= ~rest[rights] | (order[rights] > order[i])
        others = rights[ok]
        if len(others):
            others = others[(regs[others] == regs[i]).sum(axis=1) >= floor]
            waiting.append((np.full(len(others), i), others))
            size += len(others)
            if size >= PAIRS:
                judged()
                size = 0
    if waiting:
        judged()
    if not found:
        return rights[:0], rights[:0], np.zeros(0)
    i, j, how = (np.concatenate(x) for x in zip(*found, strict=True))
    likely = np.argsort(-how, kind="stable")
    return i[likely], j[likely], how[likely]


def forest(pairs, comps, sets) -> list[tuple[int, int]]:
    """The verified pairs that connect what the components and earlier pairs leave apart."""
    root = {int(c): int(c) for c in comps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in pairs), strict=True):
        a, b = find(int(comps[i])), find(int(comps[j]))
        if a == b:
            continue
        x, y = sets[i], sets[j]
        at = np.searchsorted(y, x)
        common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        if common * 100 >= (len(x) + len(y) - common) * PERCENT:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _groups(batches, keys: int) -> Iterator[list[tuple]]:
    """Rows sorted by their first ``keys`` columns, one group after another."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


_CELL = "key long, i int, j int, band int, left boolean, rest boolean, cls long, comp long, n long, regs binary"
_CELL_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
_CELL_NAMES = [c.split()[0] for c in _CELL.split(", ")]


def _pairs_of(rows: list[tuple]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The plausible pairs of a cell's rows, and the rows' components."""
    left, rest = (np.array([r[k] for r in rows], bool) for k in (4, 5))
    cls, comps, sizes = (np.array([r[k] for r in rows], np.int64) for k in (6, 7, 8))
    regs = np.frombuffer(b"".join(r[9] for r in rows), np.uint16).reshape(-1, M)
    return plausible(rows[0][3], comps, left, rest, cls, sizes, regs), comps


def _taking_part(batches) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches, 3):
        (i, j, _), _ = _pairs_of(rows)
        if len(i):
            part = [rows[x] for x in np.unique(np.concatenate((i, j))).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), _CELL_KINDS, strict=True)], names=_CELL_NAMES)


def _verify_groups(batches) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches, 3):
        (i, j, _), comps = _pairs_of(rows)
        got = forest((i, j), comps, [np.frombuffer(r[10], np.uint64) for r in rows])
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([rows[x][6] for x, _ in got], pa.int64()), pa.array([rows[y][6] for _, y in got], pa.int64())], names=["a", "b"])


def _set_batches(batches) -> Iterator[pa.RecordBatch]:
    """Sorted shingle hashes of each document, and their print."""
    for batch in batches:
        for block in tb.blocks(batch.column(1)):
            rows, keys = shingles(block)
            n = np.bincount(rows, minlength=block.rows)
            some, starts = _begin(n)
            if not len(some):
                continue
            prints = _prints(keys, starts)
            cut = np.append(starts, len(keys))
            raw = [keys[cut[i] : cut[i + 1]].tobytes() for i in range(len(some))]
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(raw, pa.binary())], names=["print", "members"])


def _sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """cls, members: the full sets of the classes in ``wanted`` (cls), each from a document that has its smallest id."""
    wanted = state.keep(classes.join(wanted.distinct(), "cls", "left_semi").select("cls", "rep", "print"), "near-wanted")
    might = semi.might_hold(wanted.select("rep"), wanted.count())

    def asked(batches):
        return _set_batches(b.filter(pa.array(might.test(b.column(0)))) for b in batches)

    found = docs.mapInArrow(asked, "print binary, members binary").join(wanted.select("cls", "print"), "print")
    found = state.keep(found.dropDuplicates(["cls"]).select("cls", "members"), "near-sets")
    might.done()
    state.release(docs.sparkSession, wanted)
    return found


def _check_batches(batches) -> Iterator[pa.RecordBatch]:
    """a, b and their sets -> the pairs that are links."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.searchsorted(y, x)
            common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(common * 100 >= (len(x) + len(y) - common) * PERCENT)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    sets = _sets(pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))), classes, docs)
    sa, sb = sets.select(F.col("cls").alias("a"), F.col("members").alias("sa")), sets.select(F.col("cls").alias("b"), F.col("members").alias("sb"))
    both = pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb")
    links = state.keep(both.mapInArrow(_check_batches, "a long, b long"), "near-links")
    state.release(docs.sparkSession, sets)
    return links


def _same_id(known: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: links between the classes of rows that share a doc_id."""
    several = known.groupBy("doc_id").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo < hi").select("doc_id")
    held = known.join(several, "doc_id", "left_semi").select("doc_id", "print").distinct().join(classes.select("cls", "print"), "print")
    least = held.groupBy("doc_id").agg(F.min("cls").alias("b"))
    return held.join(least, "doc_id").where("cls != b").select(F.col("cls").alias("a"), "b")


def _open_cells(members: DataFrame, component: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (_CELL) of the buckets whose members aren't in one component: every member of a minor component, as a left row,
    against every member, as a right row, in cells of bounded size."""
    placed = members.where("size > 2").join(component, F.col("cls") == F.col("node"), "left").select("key", "band", "cls", "n", F.coalesce("component", "cls").alias("comp"))
    placed = state.keep(placed, "near-placed")
    parts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    major = F.max_by(F.struct("comp", "c", "t"), F.struct("c", "t", "comp")).alias("major")
    mixed = parts.groupBy("key").agg(major, F.sum("c").alias("all"), F.sum("t").alias("total"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    few, weight = F.col("all") - F.col("major.c"), F.col("total") - F.col("major.t")

    def dealt(count, sum_n, least: int, most: int):
        rows = F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(count / 4)))
        return F.ceil(F.greatest(count / rows, sum_n / BLOCK_SHINGLES)).cast("int")

    mixed = state.keep(mixed.select("key", F.col("major.comp").alias("main"), dealt(F.col("all"), F.col("total"), *RIGHT).alias("rights"), dealt(few, weight, *LEFT).alias("lefts")), "near-mixed")
    held = placed.join(mixed, "key").withColumn("rest", F.col("comp") != F.col("main"))
    row, column = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("lefts")).cast("int"), F.pmod(F.xxhash64("cls", F.lit(2)), F.col("rights")).cast("int")
    left = held.where("rest").select("key", row.alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"), "band", F.lit(True).alias("left"), "rest", "cls", "comp")
    right = held.select("key", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), column.alias("j"), "band", F.lit(False).alias("left"), "rest", "cls", "comp")
    cells = left.unionAll(right).join(classes.select("cls", "n", "regs"), "cls").select(*_CELL_NAMES)
    cells = state.keep(cells, "near-open")
    state.release(members.sparkSession, placed, mixed)
    return cells


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with state.steps(spark) as outlives:
        sketch = state.keep(docs.mapInArrow(_sketch_batches, "doc_id long, n long, mark long, print binary, regs binary"), "near-sketch")
        known = sketch.where("doc_id is not null and n > 0")
        # a class's number is given once, as the table is written
        classes = known.groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"))
        classes = state.keep(classes.withColumn("cls", F.monotonically_increasing_id()), "near-classes")

        bands = state.keep(classes.select("cls", "regs", "n").mapInArrow(_band_batches, "cls long, keys array<long>, n long"), "near-bands").select("cls", "n", F.posexplode("keys").alias("band", "key"))
        buckets = state.keep(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-buckets")
        members = state.keep(bands.join(buckets, "key").select("key", "band", "size", "cls", "n"), "near-members")

        degree = members.groupBy("cls").agg(F.sum("size").alias("degree"))
        hubs = state.keep(members.join(degree, "cls").groupBy("key").agg(F.max_by("cls", F.struct("degree", -F.col("cls"))).alias("hub")), "near-hubs")
        pairs = members.select("key", "cls").join(hubs, "key").where("cls != hub").select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()
        ca = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
        cb = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
        judged = pairs.join(ca, "a").join(cb, "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_judge_batches, "a long, b long")

        links = _verified(state.keep(judged, "near-pairs"), classes, docs)
        component = components.connected(links.unionAll(_same_id(known, classes)))

        cells = _open_cells(members, component, classes)
        tasks = max(2 * spark.sparkContext.defaultParallelism, cells.count() // 4000)
        part = cells.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_taking_part, _CELL)
        part = state.keep(part, "near-part")
        n_part = part.count()
        if n_part:
            whole = part.join(_sets(part.select("cls"), classes, docs), "cls").select(*_CELL_NAMES, "members")
            tasks = max(2 * spark.sparkContext.defaultParallelism, n_part // 2000)
            more = whole.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_verify_groups, "a long, b long")
            component = components.connected(more.unionAll(component.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))))

        linked = component.join(classes.select("cls", "rep"), F.col("node") == F.col("cls")).select("component", "cls", "rep")
        least = state.keep(linked.groupBy("component").agg(F.min("rep").alias("least")), "near-least")
        # kept and sort-merged, so that both sides are dealt out and Spark can split a component of very many classes
        named = linked.select("component", "cls").join(least.hint("merge"), "component").select("cls", "least")
        labels = classes.select("cls", "print", "rep").join(named, "cls", "left").select("print", F.coalesce("least", "rep").alias("component"))
        labels = state.keep(labels, "near-labels")
        # rows without words whose id also has a text
        empty = sketch.where("doc_id is not null and n = 0").select("doc_id").distinct()
        by_id = known.select("doc_id", "print").join(empty, "doc_id", "left_semi").join(labels, "print").groupBy("doc_id").agg(F.min("component").alias("component"))
        by_id = state.keep(by_id, "near-by-id")
        outlives(sketch, labels, by_id)
    full = sketch.where("n > 0").select("doc_id", "n", "print").join(labels, "print", "left").select("doc_id", "n", "component")
    out = full.unionAll(sketch.where("n = 0").select("doc_id", "n").join(by_id, "doc_id", "left").select("doc_id", "n", "component"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with the first document of each group; columns as they are.  Rows with a null doc_id stay."""
    with state.steps(docs.sparkSession) as outlives:
        gone = state.keep(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "near-gone")
        outlives(gone)
    return semi.without(docs, gone)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i : i + 4], ' ') ELSE array_to_string(ws, ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM t WHERE len(ws) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS MATERIALIZED (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id
)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, r.doc_id = min(root) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
