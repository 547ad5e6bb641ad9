"""Puts this package on the executors' import path."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each application (as --py-files would)."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    folder = tempfile.mkdtemp(prefix="fieldloom-")  # on the driver; addPyFile hands the file out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "fieldloom_src.zip")
    with zipfile.ZipFile(path, "w") as out:
        for at, _, names in os.walk(_ROOT):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(_ROOT)))
    sc.addPyFile(path)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default: whole texts in 10,000s are too much for a worker
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    _done.add(sc.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        ship(spark)
        return query(spark, *args)

    return run
