"""Harmonic packing: pieces of documents into sequences of at most CAPACITY tokens.

Lengths are parted into reciprocal-capacity classes: class j holds lengths in (CAPACITY/(j+1), CAPACITY/j], and every
bin of class j takes exactly j pieces, so a worker fills its bins without knowing the others'.  Documents may be cut,
so each is cut into lengths that are exactly reciprocal: whole sequences (class 1), then powers of two down to
SMALLEST, whose classes leave no padding; only a rest shorter than SMALLEST goes to a class with a little.  Pieces of
bins that are still open when a worker's input ends are laid end to end and cut at the capacity; the last of these
sequences is cut at powers of two, which need no padding.  No shuffle; a worker holds one open bin a class.

Tokens come from a ``tokenizers`` file.  Where it is a plain byte-level BPE whose ids follow the merges, the same
merges run in ``tiktoken`` (a few times faster, equal ids: see the tests); any other file, and any text that holds
one of the file's special strings, is encoded by ``tokenizers`` itself.

Defined results.  Null or empty text: the closing id alone, one piece of length 1.  A null doc_id stays null.
Repeated rows are packed each.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPACITY = 1024
SMALLEST = 64
CLOSING_ID = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to a list of ids."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    spec = json.loads(open(path, encoding="utf-8").read())
    special = [x["content"] for x in spec.get("added_tokens") or []]

    def by_tokenizers(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    simple = (
        model.get("type") == "BPE" and not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    )
    if simple:
        symbol = _byte_of_symbol()
        joined = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        made = [model["vocab"][m.replace(" ", "", 1)] for m in joined]
        simple = made == sorted(made)
    if not simple:
        return by_tokenizers
    ranks = {bytes(symbol[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the byte-level split
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        return by_tokenizers(text) if any(s in text for s in special) else fast(text)

    return encode


class Packer:
    """One worker's bins.  A row is (doc_id, start, length, crc32, doc_tokens, sequence_id, offset)."""

    def __init__(self, worker: int, capacity: int = CAPACITY, smallest: int = SMALLEST):
        self.capacity, self.smallest, self.next_id = capacity, smallest, worker << 32
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def _put(self, piece: tuple) -> None:
        j = self.capacity // len(piece[2])
        held = self.open.setdefault(j, [])
        held.append(piece)
        if len(held) == j:
            self._close(self.open.pop(j))

    def add(self, doc, ids: np.ndarray) -> None:
        at, total = 0, len(ids)
        while at < total:
            left = total - at
            size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1) if left >= self.smallest else left
            self._put((doc, at, ids[at : at + size], total))
            at += size

    def finish(self) -> None:
        """Lays the pieces of open bins end to end; all but the last sequences are full, the last ones powers of two."""
        pieces = [p for j in sorted(self.open) for p in self.open[j]]
        self.open.clear()
        left = sum(len(p[2]) for p in pieces)
        held: list[tuple] = []

        def room() -> int:
            return self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)

        free = room() if left else 0
        for doc, start, ids, total in pieces:
            at = 0
            while at < len(ids):
                size = min(free, len(ids) - at)
                held.append((doc, start + at, ids[at : at + size], total))
                at, free = at + size, free - size
                if not free:
                    left -= sum(len(p[2]) for p in held)
                    self._close(held)
                    held, free = [], room() if left else 0

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(_NAMES)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, smallest: int = SMALLEST) -> DataFrame:
    """One row a piece; see SCHEMA.  sequence_id: the worker's number in the high bits, a count in the low."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        from pyspark import TaskContext

        encode, packer = encoder(path), Packer(TaskContext.get().partitionId(), capacity, smallest)
        for batch in batches:
            ids_of, texts = batch.column(0).cast(pa.int64()), batch.column(1)
            for i in range(batch.num_rows):
                ids = encode(texts[i].as_py() or "")
                ids.append(CLOSING_ID)
                packer.add(ids_of[i].as_py(), np.array(ids, dtype="<u4"))
                if len(packer.rows) >= 20000:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
