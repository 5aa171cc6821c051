"""Row selection on a long panel.

A date range that a user picks belongs after the windows, an epoch that a
report starts from belongs before them; the caller decides by call order, and
Spark does not move a filter on the order key across a window.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Day = str | dt.date | None


def date_range(panel: DataFrame, start: Day = None, end: Day = None, column: str = "month_end") -> DataFrame:
    """Both ends included; a missing bound is no bound."""
    if start is not None:
        panel = panel.where(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        panel = panel.where(F.col(column) <= F.lit(end).cast("date"))
    return panel


def since(panel: DataFrame, epoch: Day, column: str = "month_end") -> DataFrame:
    return date_range(panel, epoch, None, column)


def whole_months(obs: DataFrame, start: Day = None, end: Day = None, column: str = "obs_date") -> DataFrame:
    """Daily rows of the months whose month end lies in the range.

    The same months as ``date_range`` after aggregation, but said of the raw
    date, so that the predicate reaches the file scan.
    """
    if start is not None:
        obs = obs.where(F.col(column) >= F.lit(first_month(start)))
    if end is not None:
        obs = obs.where(F.col(column) < F.lit(months_later(last_month(end), 1)))
    return obs


def as_day(day: str | dt.date) -> dt.date:
    return day if isinstance(day, dt.date) else dt.date.fromisoformat(day)


def months_later(first: dt.date, n: int) -> dt.date:
    """The first day of the month that many months on, or back."""
    number = first.year * 12 + first.month - 1 + n
    return dt.date(number // 12, number % 12 + 1, 1)


def first_month(start: str | dt.date) -> dt.date:
    """First day of the first month whose end is not before the start."""
    return as_day(start).replace(day=1)


def last_month(end: str | dt.date) -> dt.date:
    """First day of the last month whose end is not after the end."""
    last = as_day(end)
    first = last.replace(day=1)
    is_month_end = (last + dt.timedelta(days=1)).month != last.month
    return first if is_month_end else months_later(first, -1)


def look_back(start: Day, months: int) -> dt.date | None:
    """From where rows are needed when each shown month is set against one ``months`` before it."""
    return None if start is None else months_later(first_month(start), -months)


def date_bounds(panel: DataFrame, column: str = "month_end") -> DataFrame:
    return panel.agg(F.min(column).alias("first_date"), F.max(column).alias("last_date"))


def keep_series(panel: DataFrame, series: Iterable[str], column: str = "series_id") -> DataFrame:
    """Chosen series only; choosing none gives no rows."""
    chosen = list(series)
    return panel.where(F.col(column).isin(*chosen)) if chosen else panel.limit(0)


def series_except(panel: DataFrame, left_out: DataFrame, column: str = "series_id") -> DataFrame:
    """Distinct series names that the other frame does not list."""
    return panel.select(column).distinct().join(left_out.select(column), column, "left_anti")


def last_rows(panel: DataFrame, n: int) -> DataFrame:
    """The last n months of each series, missing values counted as rows."""
    latest_first = Window.partitionBy("series_id").orderBy(F.col("month_end").desc())
    return (
        panel.withColumn("_place", F.row_number().over(latest_first))
        .where(F.col("_place") <= n)
        .drop("_place")
    )


def latest_values(panel: DataFrame, *columns: str) -> DataFrame:
    """Each series' last month with the named columns at that month."""
    last = [F.max_by(c, "month_end").alias(c) for c in columns or ("value",)]
    return panel.groupBy("series_id").agg(F.max("month_end").alias("month_end"), *last)
