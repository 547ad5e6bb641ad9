"""The mesh generators by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mesh
from . import adaptive


@dataclass(frozen=True)
class Generator:
    """``mesh``: regions, spacing (RANDOM: number of patches), width and height of the frame -> patches."""

    name: str
    mesh: Callable[..., DataFrame]


def _dynamic(rois: DataFrame, spacing: int, width, height, previous: DataFrame | None = None) -> DataFrame:
    sized = rois.select("roi_id", *[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")], "s")
    return adaptive.refine(sized, previous, spacing, None, None)


GENERATORS = {g.name: g for g in (Generator("EQUAL", mesh.equal), Generator("RANDOM", mesh.random), Generator("DYNAMIC", _dynamic))}


def select(name: str) -> Generator:
    """The generator of that name, the equal spacing if there is none."""
    return GENERATORS.get(name, GENERATORS["EQUAL"])
