"""Aggregates over series and pairs of series."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions import half_even, month_index
from monthloom.functions.pairs import pair_count
from monthloom.schemas import CORRELATION

# Series per block of the correlation matrix.  A task holds two blocks of
# (BLOCK x months) doubles, and some tens of series are several tasks already.
BLOCK = 64
# Pairs that are worked out again at a time.
REPAIRED = 512

# Relative variance below which the difference of sums has lost too many
# digits and the pair is worked out again from deviations.
CANCELLATION = 1e-6


def measure_bounds(panel: DataFrame, value: str = "value") -> DataFrame:
    return panel.groupBy("series_id").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def symmetric_range(rows: DataFrame, measure: str, *keys: str) -> DataFrame:
    """Half-width of the smallest range around zero that holds the measure."""
    spread = F.greatest(F.abs(F.min(measure)), F.abs(F.max(measure)))
    return rows.groupBy(*keys).agg(spread.alias("half_range"))


def ols_fit(aligned: DataFrame) -> DataFrame:
    """Least-squares line of y on x over complete pairs; NULL when x is constant."""
    x, y = F.col("x"), F.col("y")
    return aligned.groupBy("var_a", "var_b").agg(
        pair_count(x, y).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
    )


def ols_trendline(aligned: DataFrame) -> DataFrame:
    """The fitted line at the least and greatest x, complete pairs or not."""
    x, y = F.col("x"), F.col("y")
    fit = aligned.groupBy("var_a", "var_b").agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
    )
    ends = fit.withColumn("x", F.explode(F.array("low", "high")))
    return ends.select("var_a", "var_b", "x", (F.col("intercept") + F.col("slope") * F.col("x")).alias("y"))


def correlation_matrix(panel: DataFrame, series: Sequence[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Pairwise-complete Pearson correlations, as rows var_a <= var_b.

    Joining the panel with itself by month would shuffle one row per month and
    pair.  Instead each series becomes one vector of its months, series are
    dealt into blocks, and each pair of blocks is one task that multiplies two
    small matrices.  A vector is sent once per block, not once per pair, and
    the only rows of quadratic number are those of the answer: without names,
    all k(k + 1) / 2 pairs of the k series that the panel holds.  Several
    values of a series in a month fail the job.
    """
    cells = panel.where(F.col("value").isNotNull())
    if series is not None:
        cells = cells.where(F.col("series_id").isin(*series))
    vectors = cells.groupBy("series_id").agg(
        F.array_agg(month_index(F.col("month_end"))).alias("months"),
        F.array_agg("value").alias("values"),
    )
    blocks = _block_count(cells, series, block)
    placed = vectors.withColumn("_own", F.pmod(F.xxhash64("series_id"), blocks))
    sent = placed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    return (
        sent.withColumn("_low", F.least("_own", "_other"))
        .withColumn("_high", F.greatest("_own", "_other"))
        .groupBy("_low", "_high")
        .applyInPandas(_correlate_blocks, CORRELATION)
    )


def _block_count(cells: DataFrame, series: Sequence[str] | None, block: int) -> Column:
    if series is not None:
        return F.lit(max(1, math.ceil(len(series) / block))).cast("bigint")
    count = cells.agg(F.count_distinct("series_id")).scalar()
    return F.greatest(F.lit(1), F.ceil(count / F.lit(float(block)))).cast("bigint")


def _correlate_blocks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    low, high = key
    rows = rows.sort_values("series_id")
    first = rows[rows["_own"] == low]
    pairs = _pairs_of(first, first) if low == high else _pairs_of(first, rows[rows["_own"] == high])
    a, b, n, r = pairs
    swap = a > b
    return pd.DataFrame(
        {"var_a": np.where(swap, b, a), "var_b": np.where(swap, a, b), "n": n, "r": r},
        columns=["var_a", "var_b", "n", "r"],
    )


def _pairs_of(left: pd.DataFrame, right: pd.DataFrame):
    names_a, names_b = left["series_id"].to_numpy(object), right["series_id"].to_numpy(object)
    if not len(names_a) or not len(names_b):
        empty = np.empty(0, dtype=object)
        return empty, empty, np.empty(0, dtype="int64"), np.empty(0)
    start, end = _month_span(left, right)
    xa, ma = _matrix(left, start, end)
    xb, mb = (xa, ma) if left is right else _matrix(right, start, end)
    n, r = _masked_correlation(xa, ma, xb, mb)
    keep = np.triu(np.ones_like(n, dtype=bool)) if left is right else np.ones_like(n, dtype=bool)
    i, j = np.nonzero(keep)
    return names_a[i], names_b[j], n[i, j].astype("int64"), r[i, j]


def _month_span(*parts: pd.DataFrame) -> tuple[int, int]:
    arrays = [m for part in parts for m in part["months"] if len(m)]
    return min(int(m.min()) for m in arrays), max(int(m.max()) for m in arrays)


def _matrix(part: pd.DataFrame, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Series by months, with zero and mask where a month is missing."""
    values = np.zeros((len(part), end - start + 1))
    mask = np.zeros_like(values)
    for row, (months, cells) in enumerate(zip(part["months"], part["values"])):
        at = np.asarray(months) - start
        if len(np.unique(at)) < len(at):
            raise ValueError(f"several values of {part['series_id'].iloc[row]} in a month")
        values[row, at] = cells
        mask[row, at] = 1.0
    return values, mask


def _masked_correlation(xa, ma, xb, mb) -> tuple[np.ndarray, np.ndarray]:
    """Counts and correlations over the months both rows have."""
    za, zb = _standardised(xa, ma), _standardised(xb, mb)
    with np.errstate(divide="ignore", invalid="ignore"):
        n = ma @ mb.T
        sum_a, sum_b = za @ mb.T, ma @ zb.T
        square_a, square_b = (za * za) @ mb.T, ma @ (zb * zb).T
        var_a = square_a - sum_a * sum_a / n
        var_b = square_b - sum_b * sum_b / n
        cov = za @ zb.T - sum_a * sum_b / n
        r = np.clip(cov / np.sqrt(var_a * var_b), -1.0, 1.0)
        doubtful = ~((var_a > CANCELLATION * square_a) & (var_b > CANCELLATION * square_b))
    flat = _is_flat(xa, ma)[:, None] | _is_flat(xb, mb)[None, :]
    r[flat] = np.nan
    again = np.argwhere(doubtful & ~flat & (n > 0))
    for some in np.array_split(again, max(1, -(-len(again) // REPAIRED))):
        i, j = some.T
        r[i, j] = _deviation_correlation(xa[i], xb[j], ma[i] * mb[j])
    r[n < 2] = np.nan
    return n, r


def _standardised(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Rows moved to mean zero and unit spread, which keeps the sums small."""
    count = np.maximum(mask.sum(axis=1, keepdims=True), 1.0)
    moved = (x - x.sum(axis=1, keepdims=True) / count) * mask
    spread = np.sqrt((moved * moved).sum(axis=1, keepdims=True) / count)
    return np.divide(moved, spread, out=np.zeros_like(moved), where=spread > 0)


def _is_flat(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Rows whose present values are all the same."""
    seen = mask > 0
    return np.where(seen, x, np.inf).min(axis=1) >= np.where(seen, x, -np.inf).max(axis=1)


def _deviation_correlation(x: np.ndarray, y: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Row by row, the correlation over the months that are marked, from deviations; NaN where a side is constant."""
    if not len(x):
        return np.empty(0)
    count = both.sum(axis=1, keepdims=True)
    dx, dy = ((v - (v * both).sum(axis=1, keepdims=True) / count) * both for v in (x, y))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (dx * dy).sum(axis=1) / np.sqrt((dx * dx).sum(axis=1) * (dy * dy).sum(axis=1))
    r[_is_flat(x, both) | _is_flat(y, both)] = np.nan
    return np.clip(r, -1.0, 1.0)


def rounded(matrix: DataFrame, digits: int = 2) -> DataFrame:
    return matrix.withColumn("r", half_even(F.col("r"), digits))
