"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from monthloom.functions.strict import or_fail

# The forms that are read as dates; a cast alone would take years of any length and text after the date.
_PARTS = r"^\d{4}(-\d{1,2}(-\d{1,2})?)?$"
_TIMED = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
_QUARTER = r"^(\d{4})-?[Qq]([1-4])$"


def parse_mixed_date(text: Column, strict: bool = True) -> Column:
    """Text to a date; missing parts mean the first.

    Days, months and years as in 2024-01-05, 2024-01 and 2024, compact days
    (20240105), quarters (2024-Q1, 2024Q1) and days with a time, which is left
    out.  Day and month with slashes are refused, as their order is not known.
    Unreadable text fails the job when ``strict``, and is NULL otherwise.
    """
    bare = F.trim(text)
    month = F.lpad(((F.regexp_extract(bare, _QUARTER, 2).try_cast("int") - 1) * 3 + 1).cast("string"), 2, "0")
    plain = (
        F.when(bare.rlike(_PARTS), bare)
        .when(bare.rlike(_TIMED), F.regexp_extract(bare, r"^[^T ]+", 0))
        .when(bare.rlike(_COMPACT), F.regexp_replace(bare, _COMPACT, "$1-$2-$3"))
        .when(bare.rlike(_QUARTER), F.concat(F.substring(bare, 1, 4), F.lit("-"), month))
    )
    parsed = plain.try_cast("date")
    return or_fail(parsed, text, "date") if strict else parsed


def month_end(date: Column) -> Column:
    return F.last_day(date)


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM").cast("date")


def month_index(date: Column) -> Column:
    """Months since year 0, so that range frames can count calendar months."""
    return F.year(date) * 12 + F.month(date)


def format_iso(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def format_month_year(date: Column) -> Column:
    return F.date_format(date, "MM-yyyy")
