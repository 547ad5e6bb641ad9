"""Intermediate tables of the operators of this subpackage, and who removes them.

A step's result is written as Parquet to the folder that the cluster names in ``spark.checkpoint.dir`` (all executors reach
it), so that a lost executor costs a re-read and not a recomputation; the step's shuffle files go when it is written.  Tables
kept within ``steps`` are removed at its end, but for those that the caller's result still reads; these belong to the
``steps`` around it, or stay until the shared folder is emptied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..shared import fresh_path, remove

__all__ = ["free_name", "fresh_path", "keep", "leaving_nothing", "owned", "release", "steps"]

#: While a step is written: its shuffle files go with it, and joins broadcast nothing unless a plan says so, as broadcast
#: tables stay on executors until the driver collects garbage.
_WHILE_WRITTEN = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}
_open: list[list[str]] = []


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column has it (names differ by more than case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


@contextmanager
def leaving_nothing(spark: SparkSession) -> Iterator[None]:
    """For a plan that runs but once."""
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITTEN}
    for k, value in _WHILE_WRITTEN.items():
        spark.conf.set(k, value)
    try:
        yield
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    owned(path)
    with leaving_nothing(spark):
        df.write.parquet(path, compression="zstd")
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def owned(path: str) -> str:
    """The innermost ``steps`` removes ``path``."""
    if _open:
        _open[-1].append(path)
    return path


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes kept tables that nothing will read again."""
    for table in tables:
        for held in _open:
            if table._kept_at in held:
                held.remove(table._kept_at)
        remove(spark, table._kept_at)


@contextmanager
def steps(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Removes what is kept within, when it ends.  Yields a function that names the tables, or paths, that outlive it."""
    mine: list[str] = []
    left: set[str] = set()
    _open.append(mine)
    try:
        yield lambda *tables: left.update(t if isinstance(t, str) else t._kept_at for t in tables)
    except BaseException:
        left.clear()
        raise
    finally:
        _open.pop()
        for path in mine:
            if path not in left:
                remove(spark, path)
            elif _open:
                _open[-1].append(path)
