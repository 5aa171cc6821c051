"""Changes and rolling measures along the months of a series.

Every window is partitioned by series or by pair of series, after aggregation
to months, so a partition holds at most one row per calendar month.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from monthloom.functions import month_index, natural_log, pair_beta, pair_corr, pct_change, position_between
from monthloom.functions.pairs import pair_count
from monthloom.operators.broadcasting import literal_rows
from monthloom.operators.filters import Day, since

YEAR = 12


def _along(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("month_end")


def _calendar(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(month_index(F.col("month_end")))


def yoy_calendar(panel: DataFrame, value: str = "value", into: str = "yoy") -> DataFrame:
    """Change against the same month a year before; NULL when that is missing.

    A range frame over the month number finds the month itself, so the panel
    need not be put on a grid first.
    """
    year_ago = _calendar("series_id").rangeBetween(-YEAR, -YEAR)
    base = F.first(value).over(year_ago)
    return panel.withColumn(into, pct_change(F.col(value), base))


def yoy_rows(panel: DataFrame, value: str = "value", into: str = "yoy") -> DataFrame:
    """Change against the row twelve before, whatever month that is."""
    base = F.lag(value, YEAR).over(_along("series_id"))
    return panel.withColumn(into, pct_change(F.col(value), base))


def yoy_after_epoch(panel: DataFrame, epoch: Day, value: str = "value", into: str = "yoy") -> DataFrame:
    """Calendar change on the panel cut at the epoch, so its first year has none."""
    return yoy_calendar(since(panel, epoch), value, into)


def align_pairs(panel: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows (var_a, var_b, month_end, x, y): both sides of each pair per month.

    A month where one side is missing keeps the other; a pair of a series with
    itself has it on both sides.  Several values of a series in a month fail
    the job.
    """
    wanted = [(a, a, b, True, a == b) for a, b in pairs] + [
        (b, a, b, False, True) for a, b in pairs if a != b
    ]
    sides = literal_rows(
        panel.sparkSession, wanted, "series_id STRING, var_a STRING, var_b STRING, is_x BOOLEAN, is_y BOOLEAN"
    )
    names = sorted({name for pair in pairs for name in pair})
    rows = panel.where(F.col("series_id").isin(*names)).join(sides, "series_id")
    return rows.groupBy("var_a", "var_b", "month_end").agg(
        _only(F.when(F.col("is_x"), F.col("value"))).alias("x"),
        _only(F.when(F.col("is_y"), F.col("value"))).alias("y"),
    )


def _only(value: Column) -> Column:
    """The one value of a group; several fail the job."""
    several = F.raise_error(F.lit("several values of a series in a month")).cast("double")
    return F.when(F.count(value) > 1, several).otherwise(F.max(value))


def _last_months(window: int, *keys: str) -> WindowSpec:
    return _calendar(*keys).rangeBetween(1 - window, 0)


def _full(measure: Column, count: Column, window: int) -> Column:
    return F.when(count == window, measure)


def rolling_mean(panel: DataFrame, window: int = YEAR, value: str = "value") -> DataFrame:
    """Mean of the last months; NULL unless each of them has a value."""
    frame = _last_months(window, "series_id")
    mean = _full(F.avg(value).over(frame), F.count(value).over(frame), window)
    return panel.withColumn("rolling_mean", mean)


def rolling_count(panel: DataFrame, window: int = YEAR, value: str = "value") -> DataFrame:
    """Values present in the frame that the rolling measures look at."""
    return panel.withColumn("months_held", F.count(value).over(_last_months(window, "series_id")))


def rolling_moments(aligned: DataFrame, window: int = YEAR) -> DataFrame:
    """Rolling means of x, y, their product and the square of x."""
    frame = _last_months(window, "var_a", "var_b")
    terms = {
        "mean_x": F.col("x"),
        "mean_y": F.col("y"),
        "mean_xy": F.col("x") * F.col("y"),
        "mean_xx": F.col("x") * F.col("x"),
    }
    return aligned.withColumns(
        {name: _full(F.avg(term).over(frame), F.count(term).over(frame), window) for name, term in terms.items()}
    )


def rolling_corr(aligned: DataFrame, window: int = YEAR) -> DataFrame:
    """Rolling Pearson correlation of x and y."""
    frame = _last_months(window, "var_a", "var_b")
    x, y = F.col("x"), F.col("y")
    return aligned.withColumn("rolling_corr", _full(pair_corr(x, y, frame), pair_count(x, y, frame), window))


def log_values(aligned: DataFrame, *columns: str) -> DataFrame:
    """Natural logarithm of the named columns, NULL outside its domain."""
    return aligned.withColumns({c: natural_log(F.col(c)) for c in columns})


def rolling_beta(aligned: DataFrame, window: int = YEAR) -> DataFrame:
    """Rolling elasticity: slope of log y on log x."""
    frame = _last_months(window, "var_a", "var_b")
    x, y = natural_log(F.col("x")), natural_log(F.col("y"))
    return aligned.withColumn("rolling_beta", _full(pair_beta(x, y, frame), pair_count(x, y, frame), window))


def segment_midpoints(panel: DataFrame, value: str = "value") -> DataFrame:
    """Segments between neighbouring rows, with the value halfway."""
    ahead = _along("series_id")
    segments = panel.select(
        "series_id",
        F.col("month_end").alias("from_month"),
        F.lead("month_end").over(ahead).alias("to_month"),
        F.col(value).alias("from_value"),
        F.lead(value).over(ahead).alias("to_value"),
    )
    return segments.where(F.col("to_month").isNotNull()).withColumn(
        "midpoint", (F.col("from_value") + F.col("to_value")) / 2
    )


def scale_positions(panel: DataFrame, low: float, value: str = "value") -> DataFrame:
    """Place of each value between a fixed low and the series' own maximum."""
    high = F.max(value).over(Window.partitionBy("series_id"))
    return panel.withColumn("position", position_between(F.col(value), F.lit(float(low)), high))
