"""Cleaning of landed rows, before they become observations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions import drop_null_tokens, lenient_double, nan_to_null, parse_mixed_date, strict_double
from monthloom.operators.broadcasting import literal_rows


def clean_text_values(rows: DataFrame, *columns: str) -> DataFrame:
    """Null tokens in the named text columns become NULL."""
    return rows.withColumns({c: drop_null_tokens(F.col(c)) for c in columns})


def drop_incomplete_rows(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.dropna("any", subset=list(columns))


def cast_values(rows: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """Text to double.  Bad text fails the job, or is NULL when not strict."""
    text = F.col(column)
    number = strict_double(text) if strict else lenient_double(text)
    return rows.withColumn(column, nan_to_null(number))


def count_rejects(rows: DataFrame, column: str = "value", by: str = "series_id") -> DataFrame:
    """Per series, how many texts the lenient cast turns into NULL."""
    bad = F.col(column).isNotNull() & lenient_double(F.col(column)).isNull()
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(bad, F.lit(1))).alias("rejected"),
    )


def audit_dates(obs: DataFrame) -> DataFrame:
    """Per series: rows, distinct dates, and dates that have several rows.

    Counted per date first, so that a series of any size is spread over its
    dates.
    """
    per_date = obs.groupBy("series_id", "obs_date").agg(F.count(F.lit(1)).alias("n"))
    return per_date.groupBy("series_id").agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("dates"),
        F.count(F.when(F.col("n") > 1, F.lit(1))).alias("repeated_dates"),
    )


def parse_dates(rows: DataFrame, column: str, into: str = "obs_date", strict: bool = True) -> DataFrame:
    return rows.withColumn(into, parse_mixed_date(F.col(column), strict))


def rename_series(rows: DataFrame, names: Mapping[str, str], column: str = "series_id") -> DataFrame:
    """Give some series another name, keeping the others.

    A few names become one CASE, so the rename costs no join.
    """
    return rows.withColumn(column, _mapped(F.col(column), names))


def _mapped(code: Column, names: Mapping[str, str]) -> Column:
    chosen = None
    for old, new in names.items():
        test = code == old
        chosen = F.when(test, F.lit(new)) if chosen is None else chosen.when(test, F.lit(new))
    return code if chosen is None else chosen.otherwise(code)


def select_renamed(rows: DataFrame, names: Mapping[str, str], column: str = "series_id") -> DataFrame:
    """Keep only the named series, under their new names."""
    if not names:
        return rows.limit(0)
    dim = literal_rows(rows.sparkSession, list(names.items()), f"{column} STRING, _name STRING")
    return (
        rows.where(F.col(column).isin(*names))
        .join(dim, column)
        .withColumn(column, F.col("_name"))
        .drop("_name")
    )


def with_labels(rows: DataFrame, labels: DataFrame, column: str = "series_id") -> DataFrame:
    """Add ``label`` from a (code, label) frame; a code without one is its own label."""
    dim = labels.select(F.col(labels.columns[0]).alias(column), F.col(labels.columns[1]).alias("label"))
    return rows.join(dim, column, "left").withColumn("label", F.coalesce("label", column))
