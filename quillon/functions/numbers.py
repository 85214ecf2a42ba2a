"""Rounding that gives the same bits in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = 10_000


def reward_units(value: Column) -> Column:
    """A reward as a whole number of 1/10,000, so that sums do not depend on row order."""
    return F.floor(value * F.lit(float(UNITS)) + F.lit(0.5)).cast("long")


def round4(value: Column) -> Column:
    """Four decimals, half up on the binary value."""
    return F.floor(value * F.lit(1e4) + F.lit(0.5)) / F.lit(1e4)


def mean_units(total: Column, count: Column) -> Column:
    """Mean reward from summed reward units."""
    return total.cast("double") / F.lit(float(UNITS)) / count.cast("double")


def deviation_units(count: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation, in units, from exact integer sums; null below two rows.

    ``n * sum(x^2) - sum(x)^2`` is formed in decimals, so it is exact and cannot lose
    digits to the order in which partial sums arrive.
    """
    n = count.cast("decimal(19,0)")
    spread = (n * squares - total.cast("decimal(19,0)") * total.cast("decimal(19,0)")).cast("double")
    pairs = count.cast("double") * (count - 1).cast("double")
    return F.when(count > 1, F.sqrt(spread / pairs))
