"""Numbers that look random and are the same on every engine: multiplied and squared by a prime modulus, key by key.

Products stay below 2^62, so neither Spark nor SQL overflows.  Fixed values: the modulus 2^31 - 1 and two multipliers that
have full period for it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS, FIRST, SECOND = (1 << 31) - 1, 48271, 69621


def unit(keys: list[Column], seed: int) -> Column:
    """A number in [0, 1) for whole, non-negative keys."""
    m = F.lit(MODULUS)

    def step(h: Column, key: Column) -> Column:
        h = F.pmod((h + F.pmod(key.cast("long"), m) + 1) * FIRST, m)
        return (h * h + SECOND) % m

    return (reduce(step, keys, F.lit(seed % MODULUS).cast("long")) * FIRST % m) / float(MODULUS)


def unit_sql(keys: list[str], seed: int) -> str:
    """The same in SQL, for oracles."""

    def step(h: str, key: str) -> str:
        h = f"(({h} + ({key}) % {MODULUS} + 1) * {FIRST} % {MODULUS})"
        return f"(({h} * {h} + {SECOND}) % {MODULUS})"

    return f"(({reduce(step, keys, f'{seed % MODULUS}::BIGINT')} * {FIRST} % {MODULUS}) / {MODULUS}::DOUBLE)"
