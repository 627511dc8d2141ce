"""Boxes (x0, y0, x1, y1) and print sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length of two intervals over the narrower one's; 0 where they don't meet."""
    shared = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return shared / F.greatest(F.lit(1.0), F.least(a1 - a0, b1 - b0))


def _areas(a: Column, b: Column) -> tuple[Column, Column, Column]:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return side("x0", "x1") * side("y0", "y1"), area(a), area(b)


def overlap_of_smaller(a: Column, b: Column) -> Column:
    shared, one, two = _areas(a, b)
    return shared / F.greatest(F.lit(1e-9), F.least(one, two))


def iou(a: Column, b: Column) -> Column:
    shared, one, two = _areas(a, b)
    return shared / F.greatest(F.lit(1e-9), one + two - shared)


def to_mm(px: Column, dpi: Column | float) -> Column:
    return px / dpi * 25.4


def to_points(px: Column, dpi: Column | float) -> Column:
    return px / dpi * 72.0


def quarter_turns(x: Column, y: Column, width: Column, height: Column, turns: Column) -> Column:
    """The point in the frame turned clockwise by so many quarters."""
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.when(turns == 1, at(height - y, x)).when(turns == 2, at(width - x, height - y)).when(turns == 3, at(y, width - x)).otherwise(at(x, y))


def readability(mm: Column, contrast: Column, confidence: Column, least_mm: float = 1.5) -> Column:
    poor = (mm < least_mm * 0.95) | (contrast < 3)
    unsure = (mm < least_mm * 1.12) | (contrast < 4.5) | (confidence < 0.85)
    return F.when(poor, "POOR").when(unsure, "REVIEW").otherwise("GOOD")


def unit_box(box: Column, width: Column, height: Column) -> Column:
    """x, y, w, h as shares of the picture, kept within 0 and 1."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.struct(
        F.greatest(zero, box["x0"] / width).alias("x"), F.greatest(zero, box["y0"] / height).alias("y"),
        F.least(one, (box["x1"] - box["x0"]) / width).alias("w"), F.least(one, (box["y1"] - box["y0"]) / height).alias("h"),
    )
