"""Running a task round by round: progress events, a cooperative stop, debug mode, and errors that say their cause."""

from __future__ import annotations

import enum
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Cause(enum.Enum):
    """Why a computation can fail."""

    NOT_ENOUGH_ROIS = 1
    FIXTURES_SHIFT_MISMATCH = 2
    ILLEGAL_TASK_DATA = 3
    OPENCL_ERROR = 4
    ILLEGAL_CONFIG = 5
    MEMORY_ERROR = 6
    IO = 7


class ComputationError(ValueError):
    def __init__(self, cause: Cause, text: str = ""):
        super().__init__(f"{cause.name}: {text}" if text else cause.name)
        self.cause = cause


def cause_of(error: BaseException) -> Cause:
    """The cause of an error that a task ended with."""
    if isinstance(error, ComputationError):
        return error.cause
    if isinstance(error, MemoryError) or "OutOfMemory" in str(error):
        return Cause.MEMORY_ERROR
    if isinstance(error, OSError) or "PATH_NOT_FOUND" in str(error):
        return Cause.IO
    if isinstance(error, (ValueError, TypeError)):
        return Cause.ILLEGAL_TASK_DATA
    return Cause.OPENCL_ERROR


@dataclass
class Debug:
    """Statistics on or off, and off for some rounds of a task."""

    on: bool = False
    pauses: set[int] = field(default_factory=set)

    def active(self, round_: int) -> bool:
        return self.on and round_ not in self.pauses


@dataclass
class Event:
    phase: str
    round: int | None
    fraction: float
    ms: float


class Session:
    """Computes the rounds of a task one after another.  Listeners get an Event before each round and phase and at the end;
    ``stop`` ends it before the next round and cancels what Spark is running for it."""

    def __init__(self, spark: SparkSession, debug: Debug | None = None):
        self.spark, self.debug, self.tag = spark, debug or Debug(), f"fieldloom-{uuid.uuid4().hex}"
        self.listeners: list[Callable[[Event], None]] = []
        self._stopped = threading.Event()

    def stop(self) -> None:
        self._stopped.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    @property
    def stopped(self) -> bool:
        return self._stopped.is_set()

    def _tell(self, phase: str, round_: int | None, fraction: float, began: float) -> None:
        for listener in self.listeners:
            listener(Event(phase, round_, fraction, (time.perf_counter() - began) * 1000))

    def run(self, rounds: Iterable[int], compute: Callable[[int], DataFrame], keep: Callable[[DataFrame, str], DataFrame], statistics: Callable[[int, DataFrame], None] | None = None) -> dict[int, DataFrame]:
        """round -> its result, of all rounds until it is stopped."""
        todo, done, began = list(rounds), {}, time.perf_counter()
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            for k, r in enumerate(todo):
                if self.stopped:
                    break
                self._tell("round", r, k / len(todo), began)
                if self.stopped:
                    break
                try:
                    done[r] = keep(compute(r), f"round-{r}")
                except Exception as error:
                    if self.stopped:
                        break
                    raise ComputationError(cause_of(error), str(error)) from error
                if statistics is not None and self.debug.active(r):
                    self._tell("statistics", r, k / len(todo), began)
                    statistics(r, done[r])
            self._tell("stopped" if self.stopped else "done", None, len(done) / max(1, len(todo)), began)
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
        return done
