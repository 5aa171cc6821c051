"""The catalog says which series exist, where they come from and their names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.schemas import CATALOG
from monthloom.sources.columns import fields_of, parse_lines, read_columns

# The source codes a catalog row can carry.
SERIES_SOURCE = "fred"
PAGED_SOURCE = "eia_api"
SOURCES = (SERIES_SOURCE, PAGED_SOURCE)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, read by its header; empty fields are NULL."""
    return read_columns(spark, path, CATALOG, "csv")


def catalog_from_lines(lines: DataFrame, column: str = "line", header: str | Sequence[str] | None = None) -> DataFrame:
    """The same from a column of CSV text lines under a header; without one, in the order of ``CATALOG``."""
    return parse_lines(lines, header or [name for name, _ in fields_of(CATALOG)], CATALOG, column)


def route(catalog: DataFrame, source: str) -> DataFrame:
    """The rows of one source."""
    return catalog.where(F.col("source") == source)


def unrouted(catalog: DataFrame) -> DataFrame:
    """Rows that no loader picks up, a missing source included."""
    known = F.coalesce(F.col("source").isin(*SOURCES), F.lit(False))
    return catalog.where(~known)


def grouped_suffixes(catalog: DataFrame) -> DataFrame:
    """Names given to the groups of payloads that hold several series."""
    return route(catalog, PAGED_SOURCE).where(F.col("column_to_groupby").isNotNull()).select("secondary_name")
