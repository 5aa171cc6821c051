"""Landed rows of one-value-per-date sources, and market quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.functions import nan_to_null, parse_mixed_date
from monthloom.schemas import LANDED_SERIES, QUOTES
from monthloom.sources.catalog import SERIES_SOURCE, route
from monthloom.sources.columns import read_columns


def read_landed_series(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Rows (data_name, date text, value) of a directory of csv, json, orc or parquet, found by column name."""
    return read_columns(spark, path, LANDED_SERIES, fmt)


def _names(catalog: DataFrame) -> DataFrame:
    return route(catalog, SERIES_SOURCE).select("data_name", F.col("secondary_name").alias("series_id"))


def _obs_date() -> Column:
    """The row's date, where the catalog has its source.

    The condition holds after the join; it keeps Spark from reading the text of
    other rows before it.
    """
    return parse_mixed_date(F.when(F.col("series_id").isNotNull(), F.col("date"))).alias("obs_date")


def catalog_series(landed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Observations under catalog names; rows not in the catalog are left out."""
    return landed.join(_names(catalog), "data_name").select(
        "series_id",
        _obs_date(),
        nan_to_null(F.col("value")).alias("value"),
    )


def catalog_daily_sums(landed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per catalogued series and date: the sum of its values (total) and their number (rows).

    Rows are summed before they meet the catalog, so a source name with a third
    of all rows reaches the join as one row per date.  Dates are read after it:
    text of sources that are not in the catalog is nobody's concern.
    """
    value = nan_to_null(F.col("value"))
    daily = landed.groupBy("data_name", "date").agg(F.sum(value).alias("total"), F.count(value).alias("rows"))
    return daily.join(_names(catalog), "data_name").select(
        "series_id", _obs_date(), "total", "rows"
    )


def read_quotes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Daily closing quotes (ticker, trade_date, close), found by column name."""
    quotes = read_columns(spark, path, QUOTES, fmt)
    return quotes.withColumn("close", nan_to_null(F.col("close")))
