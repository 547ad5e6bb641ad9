"""Vectorised tokenising and hashing of Arrow string columns.

Documents are handled as slices of one UTF-8 buffer.  Every class of separators used by the operators is
ASCII, and every byte of a non-ASCII character is 0x80 or more, so working on bytes gives the same tokens as
working on characters.  Batches are cut into blocks of bounded bytes, so that memory depends on the block
size (or the longest single document), never on the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_GRAM = U(0xC2B2AE3D27D4EB4F | 1)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD_BYTE = ~SPACE  # [^\x20\x09-\x0D]
ALNUM_BYTE = np.zeros(256, dtype=bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing
ALNUM_BYTE[0x30:0x3A] = True
ALNUM_BYTE[0x61:0x7B] = True
ALNUM_BYTE[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        seq = np.full(size, base, dtype=np.uint64)
        seq[0] = 1
        have = _powers[name] = np.cumprod(seq, dtype=np.uint64)
        if size > 8 * BLOCK_BYTES:  # one giant document: don't hold on to its table
            _powers.pop(name)
    return have


def _inverse(base: np.uint64) -> np.uint64:
    return U(pow(int(base), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: a bijection of 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


@dataclass
class Block:
    """Rows ``lo .. hi-1`` of a batch; ``offs[i] : offs[i+1]`` are row ``lo + i``'s bytes in ``buf``."""

    lo: int
    hi: int
    buf: np.ndarray
    offs: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()


def blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column (null: empty) into blocks of at most ``max_bytes``, or of one longer row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, off_buf, data = column.buffers()
    offs = np.frombuffer(off_buf, dtype=np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, n)
        yield Block(lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def tokens(buf: np.ndarray, offs: np.ndarray, is_token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of token bytes within rows: starts, ends, and each row's first token (rows + 1 entries)."""
    n = len(buf)
    mask = is_token[buf]
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = mask[:-1]
    cuts = offs[1:-1]
    cuts = cuts[cuts < n]
    before[cuts] = False
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = mask[1:]
    cuts = cuts[cuts > 0]
    after[cuts - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range, in one pass over the buffer.  Empty ranges hash to one fixed value."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(buf)
    base = _BASE + U(2 * salt)
    values = _BYTE_VALUES if not salt else mix(_BYTE_VALUES + U(salt))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values[buf] * _power(base, n + 1, f"p{salt}")[:n], out=total[1:])
    raw = (total[ends] - total[starts]) * _power(_inverse(base), n + 1, f"i{salt}")[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * U(0x2545F4914F6CDD1D))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes, across row borders too (callers leave those out)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= _GRAM
        h += words[j : j + n]
    return mix(h)


def row_of(first: np.ndarray, n: int) -> np.ndarray:
    """For n items dealt to rows with first item indices ``first``: each item's row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]


def distinct_in_rows(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key) pairs, by row and key."""
    if not len(keys):
        return rows, keys
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.empty(len(keys), bool)
    new[0] = True
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return rows[new], keys[new]


def list_array(per_row: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from counts per row and the flat values."""
    offsets = np.zeros(len(per_row) + 1, np.int32)
    np.cumsum(per_row, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
