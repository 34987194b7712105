"""Numeric column expressions with the null and rounding rules of the window tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def number(name: str) -> Column:
    """Text or number to double; unparsable text and NaN become null."""
    value = F.try_cast(F.col(name), "double") if hasattr(F, "try_cast") else F.col(name).try_cast("double")
    return F.when(~F.isnan(value), value)


def is_one(name: str) -> Column:
    return F.coalesce(F.col(name) == F.lit(1), F.lit(False))


def share(flag: Column) -> Column:
    """Share of rows for which the flag holds; null counts as not holding."""
    return F.avg(F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0)))


def count_if(flag: Column) -> Column:
    return F.coalesce(F.sum(F.when(flag, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("long")


def sample_std(value: Column) -> Column:
    """Sample deviation that is 0 for a single value and null for none."""
    return F.when(F.count(value) == 1, F.lit(0.0)).otherwise(F.stddev_samp(value))


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def all_of(*conditions: Column) -> Column:
    """Conjunction in which an unknown condition is false."""
    return F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False))


def first_non_null(names: list[str]) -> Column:
    return F.coalesce(*[F.col(n).cast("double") for n in names])
