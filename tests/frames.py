"""Small panels for tests."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def months(first: str, count: int) -> list[dt.date]:
    return [t.date() for t in pd.date_range(first, periods=count, freq="ME")]


def panel(spark, rows):
    """Rows (series, month end, value)."""
    cleaned = [(s, day(m) if isinstance(m, str) else m, None if v is None else float(v)) for s, m, v in rows]
    return spark.createDataFrame(cleaned, "series_id STRING, month_end DATE, value DOUBLE")


def observations(spark, rows):
    cleaned = [(s, day(d), None if v is None else float(v)) for s, d, v in rows]
    return spark.createDataFrame(cleaned, "series_id STRING, obs_date DATE, value DOUBLE")


def random_wide(seed: int, series: int = 6, length: int = 60, missing: float = 0.15) -> pd.DataFrame:
    """A pandas panel with gaps, one column per series, month ends as index."""
    rng = np.random.default_rng(seed)
    values = 50 + rng.normal(size=(length, series)).cumsum(axis=0)
    values[rng.random(values.shape) < missing] = np.nan
    index = pd.date_range("2015-01-31", periods=length, freq="ME")
    return pd.DataFrame(values, index=index, columns=[f"s{i}" for i in range(series)])


def to_panel(spark, wide: pd.DataFrame, keep_missing: bool = False):
    rows = [
        (name, stamp.date(), None if np.isnan(v) else float(v))
        for name in wide.columns
        for stamp, v in wide[name].items()
        if keep_missing or not np.isnan(v)
    ]
    return spark.createDataFrame(rows, "series_id STRING, month_end DATE, value DOUBLE")


def to_wide(frame, value: str, index: pd.DatetimeIndex | None = None) -> pd.DataFrame:
    pdf = frame.select("series_id", "month_end", value).toPandas()
    pdf["month_end"] = pd.to_datetime(pdf["month_end"])
    wide = pdf.pivot(index="month_end", columns="series_id", values=value)
    return wide if index is None else wide.reindex(index)


def by_key(frame, *keys: str) -> dict:
    """Rows as a mapping from the key columns to the remaining ones."""
    found = {}
    for row in frame.collect():
        data = row.asDict()
        key = tuple(data.pop(k) for k in keys)
        found[key if len(key) > 1 else key[0]] = tuple(data.values()) if len(data) > 1 else next(iter(data.values()))
    return found
