"""Two Bloom filters, once-seen and twice-seen, merged over all tasks.

A task keeps two bitmaps: a bit of the first is set by a key's first hit, a bit of the second by a second hit.
Merging two pairs is associative: once = a|b, twice = ta|tb|(a&b).  A key that two documents hold thus has all
its bits in the twice filter, wherever the documents are read; other keys get there only by collisions: of those held once,
less than 0.1 % at eight bits a key, 7 % at two, 35 % at one.

A filter has MAX_BITS bits at most, which bounds what a task holds, sends and gets.  Where that would be less than LEAST_BITS
a key, the key space is dealt to ``shares``, each with filters and a scan of its own, up to MAX_SHARES; a scan costs about as
much as sending a third of all keys on, so more of them would not pay.  Keys beyond that (some eight thousand million with
these limits; a cluster with more memory a core raises MAX_BITS) let the filters fill up: more suspects shuffle, a few bytes
each, and are told apart exactly as ever.  Bitmaps are built in BUILDERS tasks a core at most, as each sends its own.
``build_counted`` does without shares: it shuffles the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import state

#: Bits of each filter: MIN_BITS .. MAX_BITS, about BITS_PER_KEY for each expected key.
MIN_BITS, MAX_BITS, BITS_PER_KEY = 1 << 20, 1 << 30, 8
LEAST_BITS, MAX_SHARES = 1, 8
_SEGMENT_BYTES = 1 << 20
BUILDERS = 4
#: Keys a bucket, on average; the least number of buckets and that of buckets a task, as powers of two; keys sent at a time.
BUCKET_KEYS, LEAST_BUCKETS, TASK_BUCKETS, SENT_KEYS = 1 << 18, 11, 5, 1 << 21
U = np.uint64


def _packed(bitmap: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(bitmap)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def bits_for(keys: int) -> int:
    want = max(1, int(keys)) * BITS_PER_KEY
    return int(min(MAX_BITS, max(MIN_BITS, 1 << (want - 1).bit_length())))


@dataclass(frozen=True)
class Share:
    """One of ``of`` parts of the key space."""

    part: int = 0
    of: int = 1

    def has(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0xD6E8FEB86659FD93)) >> U(40)) % U(self.of) == U(self.part)


def shares(expected_keys: int) -> list[Share]:
    """As many as leave LEAST_BITS for each key."""
    n = min(MAX_SHARES, max(1, -(-int(expected_keys) * LEAST_BITS // MAX_BITS)))
    return [Share(k, n) for k in range(n)]


def probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    m = U(bits - 1)
    return keys & m, (keys >> U(32)) & m if bits <= 1 << 32 else (keys * U(0x9E3779B97F4A7C15)) & m


def _set(bitmap: np.ndarray, bits: np.ndarray) -> None:
    """bits: sorted and distinct."""
    if not len(bits):
        return
    byte, value = (bits >> U(3)).astype(np.int64), np.left_shift(np.uint8(1), (bits & U(7)).astype(np.uint8))
    new = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
    bitmap[byte[new]] |= np.bitwise_or.reduceat(value, new)


def _has(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bitmap[(bits >> U(3)).astype(np.int64)] >> (bits & U(7)).astype(np.uint8)) & np.uint8(1) == 1


class Twice:
    """What executors ask: might this key be held by two documents?"""

    def __init__(self, bitmap: np.ndarray, bits: int, share: Share = Share()):
        self.bitmap, self.bits, self.share = bitmap, bits, share

    def test(self, keys: np.ndarray) -> np.ndarray:
        """False for keys of other shares, too."""
        a, b = probes(keys, self.bits)
        found = _has(self.bitmap, a)
        if self.share.of > 1:
            found &= self.share.has(keys)
        at = np.flatnonzero(found)
        found[at] = _has(self.bitmap, b[at])
        return found


def insert(once: np.ndarray, twice: np.ndarray, keys: np.ndarray, bits: int) -> None:
    """keys: each document's distinct keys, one entry a document that holds the key."""
    if not len(keys):
        return
    hit, count = np.unique(np.concatenate(probes(keys, bits)), return_counts=True)
    _set(twice, hit[(count > 1) | _has(once, hit)])
    _set(once, hit)


def _segments(bitmaps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The bitmaps' parts that hold anything: segment, data (one bitmap's part after the other)."""
    n_bytes = len(bitmaps[0])
    step = min(_SEGMENT_BYTES, n_bytes)
    for k in range(0, n_bytes, step):
        if bitmaps[0][k : k + step].any():
            yield pa.RecordBatch.from_arrays([pa.array([k // step], pa.int32()), pa.array([_packed(np.concatenate([b[k : k + step] for b in bitmaps]))], pa.binary())], names=["segment", "data"])


def merged(df: DataFrame, scan: Callable, n_bytes: int, merge: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """``scan`` gives batches of _segments for batches of ``df``; parts of the same segment are merged into the first by
    ``merge`` (rows: bitmaps), and the last bitmap of all segments comes back as one."""
    step = min(_SEGMENT_BYTES, n_bytes)
    spark = df.sparkSession

    def together(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(_unpacked(data), np.uint8).reshape(-1, step)
                if k in held:
                    merge(held[k], part)
                else:
                    held[k] = part.copy()
        for k, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(part[-1])], pa.binary())], names=["segment", "data"])

    parts = df.coalesce(max(16, BUILDERS * spark.sparkContext.defaultParallelism)).mapInArrow(scan, "segment int, data binary")
    whole = np.zeros(n_bytes, np.uint8)
    dealt = parts.repartition(max(1, min(64, n_bytes // step)), F.col("segment"))
    with state.leaving_nothing(spark):
        rows = dealt.mapInArrow(together, "segment int, data binary").collect()  # n_bytes in all
    for row in rows:
        whole[row.segment * step : (row.segment + 1) * step] = np.frombuffer(_unpacked(row.data), np.uint8)
    return whole


def build(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], expected_keys: int, share: Share = Share()) -> Twice:
    """Scans ``df`` once; ``keys_of`` gives, for a batch, arrays of keys distinct within each document."""
    bits = bits_for(-(-expected_keys // share.of))

    def scan(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for keys in keys_of(batch):
                insert(once, twice, keys[share.has(keys)] if share.of > 1 else keys, bits)
        yield from _segments([once, twice])

    def merge(held: np.ndarray, more: np.ndarray) -> None:
        held[1] |= more[1] | (held[0] & more[0])
        held[0] |= more[0]

    return Twice(merged(df, scan, bits // 8, merge), bits, share)


def build_counted(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], expected_keys: int) -> Twice:
    """As ``build``, for any number of keys with one scan: the keys themselves go to buckets, eight bytes each, where those
    that come twice are found exactly; the filter holds these alone, so its false suspects don't grow with all keys.  A task
    sends no key more than twice at a time, however common it is."""
    spark = df.sparkSession
    power = max(LEAST_BUCKETS, (max(1, int(expected_keys)) // BUCKET_KEYS).bit_length())

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        keys = keys[np.concatenate((np.ones(min(2, len(keys)), bool), keys[2:] != keys[:-2]))]
        cuts = np.searchsorted(keys, np.arange(1 << power, dtype=np.uint64) << U(64 - power)).tolist() + [len(keys)]
        some = [k for k in range(1 << power) if cuts[k] < cuts[k + 1]]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([keys[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary())], names=["bucket", "data"])

    def scan(batches):
        held, n = [], 0
        for batch in batches:
            for keys in keys_of(batch):
                held.append(keys)
                n += len(keys)
                if n >= SENT_KEYS:
                    yield sent(held)
                    held, n = [], 0
        if n:
            yield sent(held)

    def twice(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(k, []).append(np.frombuffer(data, np.uint64))
        for k in list(held):
            keys = np.sort(np.concatenate(held.pop(k)))
            keys = keys[1:][keys[1:] == keys[:-1]]
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(keys[np.concatenate(([True], keys[1:] != keys[:-1]))].view(np.int64))], names=["key"])

    dealt = df.mapInArrow(scan, "bucket int, data binary").repartition(1 << (power - TASK_BUCKETS), F.col("bucket"))
    found = state.keep(dealt.mapInArrow(twice, "key long"), "twice")
    bits = bits_for(found.count())
    bitmap = build_once(found, lambda batch: np.asarray(batch.column(0)).view(np.uint64), bits)
    state.release(spark, found)
    return Twice(bitmap, bits)


def build_once(df: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """The bitmap of a plain Bloom filter of ``bits`` bits over the keys of ``df``."""

    def scan(batches):
        bitmap = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            _set(bitmap, np.unique(np.concatenate(probes(keys_of(batch), bits))))
        yield from _segments([bitmap])

    return merged(df, scan, bits // 8, lambda held, more: np.bitwise_or(held, more, out=held))
