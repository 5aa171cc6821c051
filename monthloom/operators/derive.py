"""Measures derived from a panel and a second, small side."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.functions import float_text, half_even, rebase
from monthloom.operators.broadcasting import literal_rows, one_row_per_month
from monthloom.operators.filters import Day, latest_values


def one_series(panel: DataFrame, series: str) -> DataFrame:
    """One series by month.

    Picked while aggregating rather than by a filter, so that the panel it
    comes from is not worked out once more for it.  Several values of the
    series in a month fail the job.
    """
    value = F.when(F.col("series_id") == series, F.col("value"))
    several = F.raise_error(F.lit(f"several values of {series} in a month")).cast("double")
    picked = F.when(F.count(value) > 1, several).otherwise(F.max(value))
    return panel.groupBy("month_end").agg(picked.alias("value"))


def index_at(index: DataFrame, month: Day) -> Column:
    """The index at one month as a scalar; exactly one row must match."""
    hit = F.when(F.col("month_end") == F.lit(month).cast("date"), F.col("value"))
    problem = F.raise_error(F.lit(f"need exactly one index value at {month}")).cast("double")
    return index.agg(F.when(F.count(hit) == 1, F.max(hit)).otherwise(problem)).scalar()


def cpi_rebase(
    panel: DataFrame,
    index: DataFrame,
    base_month: Day,
    series: Iterable[str] | None = None,
    mode: str = "inflate",
) -> DataFrame:
    """Scale series by a monthly price index relative to a base month.

    Series not named keep their values.  ``index`` has one row per month; a
    month with several fails the job rather than repeat the panel's rows.
    """
    problem = F.raise_error(F.lit("a month has several index values")).cast("double")
    only = F.when(F.count(F.lit(1)) == 1, F.max("value")).otherwise(problem)
    by_month = index.groupBy("month_end").agg(only.alias("_index"))
    scaled = rebase(F.col("value"), F.col("_index"), index_at(index, base_month), mode)
    if series is not None:
        scaled = F.when(F.col("series_id").isin(*series), scaled).otherwise(F.col("value"))
    joined = panel.join(one_row_per_month(by_month), "month_end", "left")
    return joined.withColumn("value", scaled).drop("_index")


def convert_units(panel: DataFrame, series: Iterable[str], divisor: float = 100.0, digits: int = 2) -> DataFrame:
    """Divide the named series and round, for example cents to dollars."""
    converted = half_even(F.col("value") / F.lit(float(divisor)), digits)
    named = F.col("series_id").isin(*series)
    return panel.withColumn("value", F.when(named, converted).otherwise(F.col("value")))


def region_states(spark: SparkSession, regions: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows (region, state) from a region to states mapping."""
    rows = [(region, state) for region, states in regions.items() for state in states]
    return literal_rows(spark, rows, "region STRING, state STRING")


def latest_region(panel: DataFrame, regions: DataFrame, digits: int = 2) -> DataFrame:
    """Last price and change per region; a region without rows has zeros.

    ``regions`` is a frame (region, series_id).  ``panel`` has value and yoy.
    """
    last = latest_values(panel, "value", "yoy")
    empty = F.col("month_end").isNull()
    return regions.join(last, "series_id", "left").select(
        "region",
        "month_end",
        F.when(empty, F.lit(0.0)).otherwise(F.col("value")).alias("price"),
        F.when(empty, F.lit(0.0)).otherwise(half_even(F.col("yoy"), digits)).alias("yoy"),
    )


def region_rollout(latest: DataFrame, states: DataFrame) -> DataFrame:
    """One row per state, carrying its region's measures."""
    return states.join(latest, "region")


def with_cards(latest: DataFrame) -> DataFrame:
    """The texts shown for a price and its change."""
    empty = F.col("month_end").isNull()
    price = F.when(empty, F.lit("0")).otherwise(float_text(F.col("price")))
    change = F.when(empty, F.lit("0")).otherwise(float_text(F.col("yoy")))
    return latest.withColumns(
        {
            "price_card": F.concat(F.lit(" $"), price),
            "change_card": F.concat(F.lit(" "), change, F.lit("%")),
            # Formatting alone would round a tie up; rounding first makes it even.
            "marker_text": F.format_string("%s: $%.2f", F.col("region"), half_even(F.col("price"))),
        }
    )


def drill_series(panel: DataFrame, national: str, regions: Mapping[str, str], level: str, selected: str | None = None) -> DataFrame:
    """Lines at a drill level: the nation, every region, or the one selected.

    ``regions`` maps a region's name to its series.  A region that is not in
    it gives no rows.
    """
    if level == "national":
        shown = {national: "USA"}
    elif selected is None:
        shown = {series: region for region, series in regions.items()}
    else:
        shown = {regions[selected]: selected} if selected in regions else {}
    if not shown:
        return panel.limit(0).withColumn("label", F.col("series_id"))
    names = literal_rows(panel.sparkSession, list(shown.items()), "series_id STRING, label STRING")
    return panel.where(F.col("series_id").isin(*shown)).join(names, "series_id")
