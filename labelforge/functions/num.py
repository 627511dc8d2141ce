"""Numbers as the screening rules round, read and show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """To whole numbers, halves up (-2.5 becomes -2), unlike Spark's round()."""
    return F.floor(x + F.lit(0.5))


def to_fixed(x: Column, digits: int) -> Column:
    """x >= 0 with so many digits, decided by its binary value: only exact ties go up."""
    scaled = x * F.lit(float(2 ** (digits + 1)))
    tie = (F.floor(scaled) == scaled) & (F.floor(scaled) % 2 == 1)
    shown = F.replace(F.format_number(x, digits), F.lit(","), F.lit("")).cast("double")
    return F.when(tie, F.floor(x * F.lit(float(10**digits)) + 0.5) / F.lit(float(10**digits))).otherwise(shown)


def cents(x: Column) -> Column:
    """An amount as a whole number of hundredths: sums of these don't depend on their order."""
    return F.floor(x * 100 + 0.5).cast("long")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    scale = F.lit(float(10**digits))
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(part * 100.0 / whole * scale + 0.5) / scale)


def score_band(score: Column, good: int = 90, fair: int = 70) -> Column:
    return F.when(score >= good, "GOOD").when(score >= fair, "FAIR").otherwise("POOR")
