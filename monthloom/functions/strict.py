"""Failing on text that cannot be read, whatever the session's ANSI setting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_fail(parsed: Column, text: Column, what: str) -> Column:
    """The parsed value; text without one fails the job, NULL stays NULL."""
    problem = F.raise_error(F.concat(F.lit(f"not a {what}: "), text)).cast(what)
    return F.when(parsed.isNull() & text.isNotNull(), problem).otherwise(parsed)


# A cast alone would take type letters, as in 1.5d, and words for infinity.
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def lenient_double(text: Column) -> Column:
    """Text to a finite double or NaN; NULL for text that is neither, and for numbers beyond the type."""
    bare = F.trim(text)
    number = F.when(bare.rlike(_NUMBER) | (F.lower(bare) == "nan"), bare.try_cast("double"))
    return F.when(F.abs(number) != float("inf"), number)


def strict_double(text: Column) -> Column:
    return or_fail(lenient_double(text), text, "double")
