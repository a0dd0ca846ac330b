"""Boxes, colours and sizes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(a: str, b: str, pad: float = 0.0) -> Column:
    """two boxes meet by more than pad in both directions (a negative pad asks for less)."""

    def c(t: str, n: str) -> Column:
        return F.col(f"{t}.{n}")

    p = F.lit(float(pad))
    return (c(a, "x0") < c(b, "x1") - p) & (c(b, "x0") < c(a, "x1") - p) & (c(a, "top") < c(b, "bottom") - p) & (c(b, "top") < c(a, "bottom") - p)


def x_overlap(a: str, b: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.col(f"{a}.x1"), F.col(f"{b}.x1")) - F.greatest(F.col(f"{a}.x0"), F.col(f"{b}.x0")))


def y_overlap(a: str, b: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.col(f"{a}.bottom"), F.col(f"{b}.bottom")) - F.greatest(F.col(f"{a}.top"), F.col(f"{b}.top")))


def area(t: str) -> Column:
    return (F.col(f"{t}.x1") - F.col(f"{t}.x0")) * (F.col(f"{t}.bottom") - F.col(f"{t}.top"))


def inside_share(a: str, b: str) -> Column:
    """the share of a's area that lies in b."""
    return F.try_divide(x_overlap(a, b) * y_overlap(a, b), area(a))


def rgb(color: Column) -> Column:
    """gray, RGB or CMYK components to three of RGB, each within 0 and 1; others are black."""

    def clip(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))

    def at(i: int) -> Column:
        return F.get(color, F.lit(i))

    k = F.lit(1.0) - at(3)
    return (
        F.when(F.size(color) == 1, F.array(*[clip(at(0))] * 3))
        .when(F.size(color) == 3, F.array(*[clip(at(i)) for i in range(3)]))
        .when(F.size(color) == 4, F.array(*[clip((F.lit(1.0) - at(i)) * k) for i in range(3)]))
        .otherwise(F.array(*[F.lit(0.0)] * 3))
    )


def spot_rgb(tint: Column) -> Column:
    """a spot colour's tint is inverted to gray."""
    return F.array(*[F.least(F.greatest(F.lit(1.0) - tint, F.lit(0.0)), F.lit(1.0))] * 3)


def quarter_size(size: Column, factor: Column | float, least: float = 4.0, most: float = 42.0) -> Column:
    """F16: a scaled size within bounds, to quarters of a point, half to even."""
    f = F.lit(factor) if isinstance(factor, (int, float)) else factor
    return F.bround(F.least(F.greatest(size * f, F.lit(least)), F.lit(most)) * 4) / 4


def justify_gap(width: Column, used: Column, gaps: Column, size: Column) -> Column:
    """extra space a gap; null if the line is under 0.6 full, or the gap over 0.6 of the size."""
    gap = F.try_divide(width - used, gaps)
    return F.when((used >= 0.6 * width) & (gap >= 0) & (gap <= 0.6 * size), gap)


def token_budget(chars: Column) -> Column:
    """F18."""
    return F.least(F.lit(16000), F.greatest(F.lit(1024), F.floor(chars * 1.2).cast("int") + 256))


def font_face(kind: Column) -> Column:
    """F27."""
    return F.when(kind.isin("heading", "title"), F.lit("bold")).otherwise(F.lit("regular"))


def column_of(x0: Column, x1: Column, mid: Column, left: Column, right: Column) -> Column:
    """0 across the middle, else 1 or 2 by the centre."""
    band = (right - left) * 0.06
    return F.when(mid.isNull() | ((x0 < mid - band) & (x1 > mid + band)), 0).when((x0 + x1) / 2 < mid, 1).otherwise(2)
