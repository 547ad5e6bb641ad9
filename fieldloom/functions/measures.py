"""Scalar measures: components, units, times and number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def displacement(kind: Column, dx: Column, dy: Column) -> Column:
    return F.when(kind == "DX", dx).when(kind == "DY", dy).when(kind == "DABS", F.sqrt(dx * dx + dy * dy))


def strain(kind: Column, exx: Column, eyy: Column, exy: Column) -> Column:
    return F.when(kind == "EXX", exx).when(kind == "EYY", eyy).when(kind == "EXY", exy).when(kind == "EABS", F.sqrt(exx * exx + eyy * eyy + exy * exy))


def tick_ms(fps: Column) -> Column:
    return F.lit(1000.0) / fps


def speed(kind: Column, dx: Column, dy: Column, fps: Column) -> Column:
    return displacement(kind, dx, dy) / tick_ms(fps)


def time_ms(frame: Column, fps: Column) -> Column:
    return frame * tick_ms(fps)


def to_mm(value: Column, ratio: Column) -> Column:
    """ratio: pixels in a millimetre."""
    return value / ratio


def mm_ratio(x1: Column, x2: Column, mm: Column) -> Column:
    return F.abs(x2 - x1) / mm


def weight_width(size: Column, coefficient: Column) -> Column:
    return F.floor(size * coefficient * 3.2 + 0.5)


def gauss_weight(dx: Column, dy: Column, width: Column) -> Column:
    return F.exp(-(dx * dx + dy * dy) / (width * width * 2.0))


def grey(r: Column, g: Column, b: Column) -> Column:
    return F.floor((r + g + b) / 3)


def side(half: Column) -> Column:
    return half * 2 + 1


def area(half: Column) -> Column:
    return side(half) * side(half)


def number_text(value: Column) -> Column:
    """At least two decimals, a third if it isn't zero."""
    three = F.format_string("%.3f", value)
    return F.when(three.endswith("0"), F.substring(three, 1, 1 << 20).substr(F.lit(1), F.length(three) - 1)).otherwise(three)


def int_text(value: Column) -> Column:
    return F.when(value < 100, F.lpad(value.cast("string"), 2, "0")).otherwise(value.cast("string"))
