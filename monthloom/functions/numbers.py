"""Arithmetic on series values.

Division never raises and never yields infinity: a zero denominator is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(value: Column) -> Column:
    """Spark's aggregates skip NULL but not NaN, so NaN ends at ingest."""
    return F.when(~F.isnan(value), value)


def pct_change(now: Column, base: Column) -> Column:
    return F.try_divide(F.lit(100.0) * (now - base), base)


def half_even(value: Column, digits: int = 2) -> Column:
    """Round half to even on the scaled double, as array libraries do.

    ``bround`` rounds the decimal text of the double, which differs on values
    such as 0.285, whose double lies off the tie its text shows.
    """
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def natural_log(value: Column) -> Column:
    """NULL outside the domain."""
    return F.ln(value)


def position_between(value: Column, low: Column, high: Column) -> Column:
    """Place on a colour scale; not clipped to 0..1."""
    return F.try_divide(value - low, high - low)


def rebase(value: Column, index: Column, base_index: Column, mode: str = "inflate") -> Column:
    """Scale by a price index.

    ``inflate`` multiplies by index / base, ``deflate`` divides by it and gives
    values in the base month's money.
    """
    if mode == "inflate":
        return value * F.try_divide(index, base_index)
    if mode == "deflate":
        return value * F.try_divide(base_index, index)
    raise ValueError(f"unknown rebase mode: {mode}")
