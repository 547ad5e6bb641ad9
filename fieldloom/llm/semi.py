"""Reducing documents to those whose id a table names, before their texts shuffle.

A Bloom filter over the ids goes to the executors; rows that can't match are left out of the shuffle.  It has twelve bits an
id, MAX_BITS at most (some 90 million ids): beyond that more rows take part in the shuffle, and callers, who join exactly
afterwards, get the same result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import state, twice
from . import textblocks as tb

MAX_BITS = 1 << 30


class Maybe:
    """Tests ids against a broadcast filter: False only for ids that it doesn't hold.  Null ids give False."""

    def __init__(self, held, bits: int):
        self.held, self.bits = held, bits

    def test(self, ids: pa.Array) -> np.ndarray:
        """In an Arrow function that sees the ids anyway: needs no Python worker of its own."""
        known = np.asarray(ids.is_valid())
        keys = tb.mix(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        return known & twice.Twice(self.held.value, self.bits).test(keys)

    def done(self) -> None:
        """Takes the filter off the executors."""
        self.held.unpersist()

    def test_keys(self, keys: np.ndarray) -> np.ndarray:
        """Of unsigned keys: the ids' bits."""
        return twice.Twice(self.held.value, self.bits).test(tb.mix(keys))

    def column(self, ids: Column) -> Column:
        @F.arrow_udf("boolean")
        def might(column: pa.Array) -> pa.Array:
            return pa.array(self.test(column))

        return might(ids.cast("long"))


def might_hold(ids: DataFrame, expected: int) -> Maybe:
    """A filter over ``ids`` (one long column)."""
    bits = int(min(MAX_BITS, max(1 << 16, 1 << (max(1, expected) * 12 - 1).bit_length())))

    def keys(batch):
        return tb.mix(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))

    return Maybe(ids.sparkSession.sparkContext.broadcast(twice.build_once(ids, keys, bits)), bits)


def without(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose ``column`` is in ``ids`` (one long column, kept in the shared folder); a null stays.
    Only rows that the filter takes for members shuffle."""
    name = ids.columns[0]
    might = might_hold(ids, ids.count())
    key, names = docs[column].cast("long"), docs.columns
    maybe_name, gone_name = state.free_name("__maybe", names), state.free_name("__gone", names)
    asked = docs.withColumn(maybe_name, might.column(key))
    maybe = asked.where(F.col(maybe_name)).select(*names)
    gone = ids.select(F.col(name).alias(gone_name))
    checked = maybe.join(gone, maybe[column].cast("long") == gone[gone_name], "left_anti").select(*names)
    return asked.where(~F.col(maybe_name)).select(*names).unionAll(checked)
