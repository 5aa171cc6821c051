"""Which years of a written panel a report has to read.

A panel is partitioned by year, so what a user asks for is a set of partitions.
Changes look behind the asked range: those against a calendar month by exactly
a year, and those against a row of complete months by as many years as it takes
to find that many complete months.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.operators.filters import Day, as_day, first_month, look_back
from monthloom.operators.panel import complete_months
from monthloom.operators.windows import YEAR
from monthloom.plans import names

# A written panel's years from one to another, None for no bound.
ReadYears = Callable[[int | None, int | None], DataFrame]

EPOCHS = {
    "industrial": names.INDUSTRIAL_EPOCH,
    "price": names.PRICE_EPOCH,
    "employment": names.EMPLOYMENT_EPOCH,
}
COMPLETE_SERIES = {"oil": names.OIL_SERIES, "fuel": names.FUEL_SERIES}


def calendar_first_year(start: Day, epoch: Day = None) -> int | None:
    """First year read by a report whose changes look back a year; it never looks behind its epoch."""
    found = [as_day(day).year for day in (look_back(start, YEAR), epoch) if day is not None]
    return max(found, default=None)


def complete_rows_first_year(
    read: ReadYears, series: Sequence[str], start: Day, oldest: int, rows: int = YEAR, guess: int = 2
) -> int | None:
    """First year read by a report whose changes look back so many complete months.

    Looks at few years before the start and at twice as many as long as these
    do not hold enough complete months; each look counts the report's own
    series by month, and the last one reads less than twice what is needed.
    """
    if start is None:
        return None
    shown = first_month(start)
    back = guess
    while True:
        first = max(oldest, shown.year - back)
        earlier = read(first, shown.year).where(F.col("month_end") < F.lit(shown))
        months = complete_months(earlier, series).orderBy(F.col("month_end").desc()).limit(rows)
        found = months.agg(F.count("month_end").alias("n"), F.min("month_end").alias("first")).first()
        if found["n"] == rows:
            return found["first"].year
        if first == oldest:
            return None
        back *= 2


def years_of(report: str, read: ReadYears, oldest: int, start: Day = None, end: Day = None) -> tuple[int | None, int | None]:
    """First and last year that a report over a date range reads; None for no bound."""
    last = None if end is None else as_day(end).year
    if report in EPOCHS:
        return calendar_first_year(start, EPOCHS[report]), last
    if report in COMPLETE_SERIES:
        return complete_rows_first_year(read, COMPLETE_SERIES[report], start, oldest), last
    return None, None  # correlations need whole spans, recent developments count from the end


def panel_of(report: str, read: ReadYears, oldest: int, start: Day = None, end: Day = None) -> DataFrame:
    """The part of a written panel that a report over a date range reads."""
    first, last = years_of(report, read, oldest, start, end)
    panel = read(first, last)
    base = as_day(names.CPI_BASE_MONTH).year
    if report == "industrial" and not ((first or base) <= base <= (last or base)):
        panel = panel.unionByName(read(base, base).where(F.col("series_id") == names.CPI))  # prices are relative to it
    return panel
