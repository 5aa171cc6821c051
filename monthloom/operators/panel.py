"""From observations to the month-end panel, and between long and wide.

Aligning many series on the date by chained outer joins is one shuffle per
series.  Kept long, the same alignment is a union and one aggregation, whose
partial sums make a series with a third of all rows as cheap as any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from monthloom.functions import month_end, month_start, series_stem
from monthloom.operators.broadcasting import one_row_per_month
from monthloom.operators.filters import Day, first_month, last_month, whole_months


def monthly_mean(obs: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """Month-end mean per series, missing values skipped."""
    rows = whole_months(obs, start, end)
    panel = rows.groupBy("series_id", month_end(F.col("obs_date")).alias("month_end")).agg(F.avg("value").alias("value"))
    return _dated(panel)


def monthly_mean_of_sums(sums: DataFrame) -> DataFrame:
    """The same of observations that come as sums (total) with the number of values in them (rows)."""
    mean = F.try_divide(F.sum("total"), F.sum("rows"))
    return _dated(sums.groupBy("series_id", month_end(F.col("obs_date")).alias("month_end")).agg(mean.alias("value")))


def _dated(panel: DataFrame) -> DataFrame:
    """Leave out rows without a date.

    A join by month would imply the same on one of its sides; saying it here
    keeps every reading of the panel alike, so that its shuffle is shared.
    """
    return panel.where(F.col("month_end").isNotNull())


def monthly_last(
    quotes: DataFrame,
    key: str = "ticker",
    date: str = "trade_date",
    value: str = "close",
    tie_break: Sequence[str] = (),
    ties: str = "highest",
) -> DataFrame:
    """Last non-missing value of each month.

    Where the last date has several values, ``ties`` says which one stands: the
    "highest" or the "lowest" of them, or "fail", which fails the job on a date
    whose values differ.  Rows become one per date first, by sums that need no
    sorting and that are made where the rows are; so the order in which files
    are read never decides.

    ``tie_break`` names further columns that order rows of the same date, the
    largest last.  The order is then a struct, which Spark can only aggregate by
    sorting, so give it only where the data have such an order.
    """
    months = month_end(F.col(date)).alias("month_end")
    if tie_break:
        last = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(date, *tie_break)))
        return _dated(quotes.groupBy(F.col(key).alias("series_id"), months).agg(last.alias("value")))
    several = F.raise_error(F.concat(F.lit("several values of "), F.col(key), F.lit(" on "), F.col(date).cast("string")))
    one = {
        "highest": F.max(value),
        "lowest": F.min(value),
        "fail": F.when(F.min(value) != F.max(value), several.cast("double")).otherwise(F.max(value)),
    }[ties]
    daily = quotes.groupBy(key, date).agg(one.alias("_value"))
    last = F.max_by(F.col("_value"), F.when(F.col("_value").isNotNull(), F.col(date)))
    return _dated(daily.groupBy(F.col(key).alias("series_id"), months).agg(last.alias("value")))


def union_panels(*panels: DataFrame) -> DataFrame:
    """Full outer merge of panels on the month, in long form."""
    return reduce(DataFrame.unionByName, panels)


def inner_panels(left: DataFrame, right: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """Both panels, on the months that both span and that lie in the range.

    A panel stands for a row per month from its first to its last, so the
    shared months are the overlap of the two spans.  A range is said of these
    months and not of the rows: Spark would move a filter on rows below the
    aggregation behind a panel, where the panel's span, which needs all rows,
    could no longer share its shuffle.
    """
    (left_low, left_high), (right_low, right_high) = span(left), span(right)
    months = months_between(
        left.sparkSession, F.greatest(left_low, right_low), F.least(left_high, right_high), start, end
    )
    return on_months(union_panels(left, right), months)


def last_months(panel: DataFrame, n: int, of: DataFrame | None = None) -> DataFrame:
    """The last n calendar months, counted back from the end of ``of``."""
    _, newest = span(panel if of is None else of)
    return on_months(panel, months_between(panel.sparkSession, F.add_months(newest, 1 - n), newest))


def span(panel: DataFrame) -> tuple[Column, Column]:
    """First and last month of a panel, as scalars.

    Counting the values keeps them in the subquery's plan, which makes its
    shuffle the same as the panel's own, so Spark runs the two only once.
    """
    bounds = panel.agg(
        F.struct(
            F.min("month_end").alias("low"), F.max("month_end").alias("high"), F.count("value").alias("n")
        ).alias("bounds")
    ).scalar()
    return month_start(bounds["low"]), month_start(bounds["high"])


def months_between(spark: SparkSession, low: Column, high: Column, start: Day = None, end: Day = None) -> DataFrame:
    """Month ends from one month to another that lie in the range; none when they are the wrong way round."""
    if start is not None:
        low = F.greatest(month_start(low), F.lit(first_month(start)))
    if end is not None:
        high = F.least(month_start(high), F.lit(last_month(end)))
    starts = F.sequence(month_start(low), month_start(high), F.expr("interval 1 month"))
    axis = spark.range(1).select(F.explode(F.when(low <= high, starts)).alias("_start"))
    return axis.select(F.last_day("_start").alias("month_end"))


def on_months(panel: DataFrame, months: DataFrame) -> DataFrame:
    """The panel on some months.

    The months are made distinct, which bounds what is sent to all.  An inner join, since Spark would move a semi join below the aggregation
    that makes the panel and then read the observations twice.
    """
    return panel.join(one_row_per_month(months.select("month_end").distinct()), "month_end").select(*panel.columns)


def full_outer_wide(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer merge of two wide panels on the month."""
    return left.join(right, "month_end", "full_outer")


def month_grid(panel: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """Every series on every month from the first to the last, gaps as NULL.

    Each row carries the missing months after it, and a series' first row also
    those before it, so the grid needs no product of series and months and no
    join back.  Bounds default to those of the whole panel; months outside
    given ones are left out.
    """
    if start is not None:
        panel = panel.where(F.col("month_end") >= F.lit(start).cast("date"))
    if end is not None:
        panel = panel.where(F.col("month_end") <= F.last_day(F.lit(end).cast("date")))
    by_month = Window.partitionBy("series_id").orderBy("month_end")
    first, last = _grid_bounds(panel, start, end)
    before = F.lag("month_end").over(by_month)
    after = F.lead("month_end").over(by_month)
    spans = panel.select(
        "series_id",
        "month_end",
        "value",
        F.when(before.isNull(), first).otherwise(month_start(F.col("month_end"))).alias("_from"),
        F.coalesce(F.add_months(month_start(after), -1), last).alias("_to"),
    )
    months = spans.select(
        "series_id",
        F.col("month_end").alias("_own"),
        "value",
        F.explode(F.sequence("_from", "_to", F.expr("interval 1 month"))).alias("_month"),
    )
    on_grid = F.last_day("_month")
    return months.select(
        "series_id",
        on_grid.alias("month_end"),
        F.when(on_grid == F.col("_own"), F.col("value")).alias("value"),
    )


def _grid_bounds(panel: DataFrame, start: Day, end: Day) -> tuple[Column, Column]:
    given = [None if day is None else month_start(F.lit(day).cast("date")) for day in (start, end)]
    found = span(panel) if start is None or end is None else given
    return tuple(f if g is None else g for g, f in zip(given, found))


def complete_months(panel: DataFrame, series: Sequence[str]) -> DataFrame:
    """Months in which every one of the series has a value."""
    wanted = panel.where(F.col("series_id").isin(*series))
    counted = wanted.groupBy("month_end").agg(F.count("value").alias("_present"))
    return counted.where(F.col("_present") == len(set(series))).select("month_end")


def complete_cases(panel: DataFrame, series: Sequence[str]) -> DataFrame:
    """The series on the months in which none of them is missing.

    Counting per month and joining the months back moves one row per month;
    a window by month would move the whole panel into one task per month.
    """
    chosen = panel.where(F.col("series_id").isin(*series))
    return on_months(chosen, complete_months(chosen, series))


def widen(panel: DataFrame, series: Sequence[str], value: str = "value") -> DataFrame:
    """One column per series, one row per month; names are given, not looked up.

    Several values of a series in a month fail the job.
    """
    cells = (
        panel.where(F.col("series_id").isin(*series))
        .groupBy("month_end")
        .pivot("series_id", list(series))
        .agg(F.collect_list(value))
    )
    return cells.select("month_end", *[_only(F.col(f"`{s}`"), s).alias(s) for s in series])


def _only(values: Column, series: str) -> Column:
    several = F.raise_error(F.lit(f"several values of {series} in a month")).cast("double")
    return F.when(F.size(values) > 1, several).otherwise(F.try_element_at(values, F.lit(1)))


def lengthen(wide: DataFrame, series: Sequence[str] | None = None) -> DataFrame:
    """One row per month and series column, missing ones included."""
    columns = list(series) if series is not None else [c for c in wide.columns if c != "month_end"]
    return wide.unpivot(["month_end"], [F.col(f"`{c}`") for c in columns], "series_id", "value")


def pivot_mean(payload: DataFrame, groups: Sequence[str], suffix: str = "") -> DataFrame:
    """Wide frame of group means per date; duplicate (date, group) rows are averaged."""
    wide = payload.groupBy("date").pivot("grp", list(groups)).agg(F.avg("value"))
    renamed = [F.col(f"`{g}`").alias(g.replace(" ", "").lower() + suffix) for g in groups]
    return wide.select("date", *renamed)


def group_means(payload: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """The same means as ``pivot_mean`` in long form, for any number of groups."""
    return payload.groupBy(*keys, "grp").agg(F.avg("value").alias("value"), F.count("value").alias("rows"))


def in_totals(group: Column, suffix: Column | str = "", exclude_groups: Sequence[str] = ()) -> Column:
    """Whether a group counts in its payload's total.

    A group whose series name holds "date" is read as a date column and not as
    a group.  A payload that also holds a national row is counted twice unless
    that group is excluded.
    """
    counts = ~series_stem(group, suffix).contains("date")
    return counts & ~group.isin(*exclude_groups) if exclude_groups else counts


def group_totals(
    means: DataFrame,
    keys: Sequence[str] = ("date",),
    exclude_groups: Sequence[str] = (),
    suffix: Column | str = "",
) -> DataFrame:
    """Sum of the group means per date, missing ones counted as zero, of the groups that count in totals."""
    counted = means.where(in_totals(F.col("grp"), suffix, exclude_groups))
    return counted.groupBy(*keys).agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("value"))


def named_groups(means: DataFrame, suffix: Column | str = "") -> DataFrame:
    """Group means as series: the group label's stem plus the suffix."""
    return means.withColumn("series_id", series_stem(F.col("grp"), suffix)).drop("grp")
