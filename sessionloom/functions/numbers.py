"""Rounding, shares and clamps with the snapshot's half-up semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SAFE_INTEGER = 9007199254740991


def half_up(value: Column) -> Column:
    """Round half towards +infinity (Spark's ``round`` goes away from zero)."""
    return F.floor(value + F.lit(0.5)).cast("long")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, 0 when the denominator is not positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double")).otherwise(F.lit(0.0))


def pct(numerator: Column, denominator: Column) -> Column:
    """Whole percent: the quotient is taken first, then scaled."""
    return half_up(ratio(numerator, denominator) * 100)


def share(count: Column, total: Column) -> Column:
    """Whole percent: the count is scaled first, then divided."""
    return F.when(total > 0, half_up(count.cast("double") * 100 / total.cast("double"))).otherwise(F.lit(0).cast("long"))


def one_decimal(value: Column) -> Column:
    return F.floor(value * 10 + F.lit(0.5)).cast("double") / 10


def clamp_percent(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(value))).cast("long")


def capped(value: Column) -> Column:
    """Notability: whole number, at most 100."""
    return F.least(F.lit(100), half_up(value.cast("double"))).cast("long")


def clamp_safe(value: Column) -> Column:
    """Largest exact integer of a double; null stays null."""
    return F.when(value > MAX_SAFE_INTEGER, F.lit(MAX_SAFE_INTEGER)).otherwise(value).cast("long")


def duration_minutes(start: Column, end: Column) -> Column:
    millis = F.unix_millis(end) - F.unix_millis(start)
    return F.greatest(F.lit(0), half_up(millis / 60000)).cast("long")
