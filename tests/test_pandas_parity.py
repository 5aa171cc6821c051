"""Operators give what pandas gives on seeded random panels."""

from __future__ import annotations


import numpy as np
import pandas as pd
import pytest

from monthloom.operators import panel, stats, windows
from tests.frames import by_key, random_wide, to_panel, to_wide

SEEDS = (1, 2, 3)


def change(wide: pd.DataFrame) -> pd.DataFrame:
    return 100 * (wide - wide.shift(12)) / wide.shift(12)


def assert_same(found: pd.DataFrame, want: pd.DataFrame, tolerance: float = 1e-9) -> None:
    found = found.reindex(index=want.index, columns=want.columns)
    np.testing.assert_allclose(found.to_numpy(float), want.to_numpy(float), rtol=tolerance, atol=tolerance, equal_nan=True)


@pytest.mark.parametrize("seed", SEEDS)
def test_union_and_mean_are_an_outer_merge_and_resample(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for name in ("a", "b", "c", "d"):
        days = np.sort(rng.choice(pd.date_range("2020-01-01", "2021-12-31"), 80, replace=False))
        values = rng.normal(size=80)
        rows += [(name, pd.Timestamp(d).date(), float(v)) for d, v in zip(days, values)]
    long = pd.DataFrame(rows, columns=["series", "day", "value"])
    months = pd.to_datetime(long["day"]) + pd.offsets.MonthEnd(0)
    want = long.groupby([months, "series"])["value"].mean().unstack("series")
    want = want.reindex(pd.date_range(want.index.min(), want.index.max(), freq="ME"))
    obs = spark.createDataFrame(rows, "series_id STRING, obs_date DATE, value DOUBLE")
    found = to_wide(panel.month_grid(panel.monthly_mean(obs)), "value", want.index)
    assert_same(found, want)


@pytest.mark.parametrize("seed", SEEDS)
def test_calendar_change(spark, seed):
    wide = random_wide(seed)
    found = to_wide(windows.yoy_calendar(to_panel(spark, wide)), "yoy", wide.index)
    assert_same(found, change(wide))


@pytest.mark.parametrize("seed", SEEDS)
def test_row_change_on_complete_cases(spark, seed):
    wide = random_wide(seed, series=3)
    complete = wide.dropna()
    found = to_wide(windows.yoy_rows(panel.complete_cases(to_panel(spark, wide), list(wide.columns))), "yoy")
    assert list(found.index) == list(complete.index)
    assert_same(found, change(complete))


def test_row_and_calendar_change_agree_without_gaps(spark):
    rows = to_panel(spark, random_wide(5, missing=0.0))
    both = windows.yoy_rows(windows.yoy_calendar(rows), into="by_row")
    assert both.where("NOT (yoy <=> by_row)").count() == 0


def _slope(x: pd.Series, y: pd.Series) -> float:
    """Least-squares slope over one frame; none if a value is missing."""
    if x.isna().any() or y.isna().any():
        return np.nan
    return np.polyfit(x - x.mean(), y, 1)[0]


@pytest.mark.parametrize("seed", SEEDS)
def test_rolling_measures(spark, seed):
    wide = random_wide(seed, series=2, length=90, missing=0.03)
    x, y = wide["s0"], wide["s1"]
    aligned = windows.align_pairs(to_panel(spark, wide), [("s0", "s1")])
    rows = windows.rolling_beta(windows.rolling_corr(windows.rolling_moments(aligned))).toPandas()
    rows = rows.set_index(pd.to_datetime(rows["month_end"])).reindex(wide.index)
    lx, ly = np.log(x), np.log(y)
    mean = lambda s: s.rolling(12).mean()
    beta = pd.Series([_slope(lx.iloc[i - 11 : i + 1], ly.iloc[i - 11 : i + 1]) if i >= 11 else np.nan for i in range(len(x))], index=x.index)
    want = pd.DataFrame(
        {
            "mean_x": mean(x),
            "mean_y": mean(y),
            "mean_xy": mean(x * y),
            "mean_xx": mean(x * x),
            "rolling_corr": x.rolling(12).corr(y),
            "rolling_beta": beta,
        }
    )
    assert want["rolling_corr"].notna().sum() > 5
    assert_same(rows[want.columns.tolist()], want, 1e-6)
    found = to_wide(windows.rolling_mean(to_panel(spark, wide)), "rolling_mean", wide.index)
    assert_same(found, wide.rolling(12).mean())
    assert rows["rolling_corr"].abs().max() <= 1 + 1e-12


@pytest.mark.parametrize("seed, block", [(1, 256), (2, 4), (3, 1)])
def test_correlation_matrix(spark, seed, block):
    wide = random_wide(seed, series=15, missing=0.3)
    wide["flat"] = 0.1
    wide["tail"] = np.where(np.arange(len(wide)) > 56, wide["s0"].fillna(3.0), np.nan)
    wide["once"] = np.nan
    wide.loc[wide.index[7], "once"] = 4.0
    want = wide.corr()
    matrix = by_key(stats.correlation_matrix(to_panel(spark, wide), block=block), "var_a", "var_b")
    assert len(matrix) == len(wide.columns) * (len(wide.columns) + 1) // 2
    for (a, b), (n, r) in matrix.items():
        assert n == int((wide[a].notna() & wide[b].notna()).sum())
        expected = want.loc[a, b]
        if np.isnan(expected):
            assert r is None, (a, b, r)
        else:
            assert r == pytest.approx(expected, abs=1e-9), (a, b)


def test_named_series_bound_the_blocks(spark):
    wide = random_wide(9, series=5)
    everything = by_key(stats.correlation_matrix(to_panel(spark, wide)), "var_a", "var_b")
    named = by_key(stats.correlation_matrix(to_panel(spark, wide), list(wide.columns), block=2), "var_a", "var_b")
    assert named == {k: (n, pytest.approx(r, abs=1e-12)) for k, (n, r) in everything.items()}


def test_fit(spark):
    wide = random_wide(11, series=2)
    both = wide.dropna()
    slope, intercept = np.polyfit(both["s0"], both["s1"], 1)
    fit = stats.ols_fit(windows.align_pairs(to_panel(spark, wide), [("s0", "s1")])).first()
    assert fit["slope"] == pytest.approx(slope) and fit["intercept"] == pytest.approx(intercept)
    assert fit["n"] == len(both)


@pytest.mark.parametrize("seed", SEEDS)
def test_long_and_wide_undo_each_other(spark, seed):
    wide = random_wide(seed, series=3)
    wide.columns = ["u.s._gasprice", "participation_55+_rate", "plain"]
    rows = to_panel(spark, wide)
    names = list(wide.columns)
    back = panel.lengthen(panel.widen(rows, names)).where("value IS NOT NULL")
    assert by_key(back, "series_id", "month_end") == by_key(rows, "series_id", "month_end")


def test_full_outer_of_wide_panels(spark):
    left, right = random_wide(1, series=2, length=5), random_wide(2, series=2, length=8)
    right.columns = ["t0", "t1"]
    wide_left = panel.widen(to_panel(spark, left, True), list(left.columns))
    wide_right = panel.widen(to_panel(spark, right, True), list(right.columns))
    found = panel.full_outer_wide(wide_left, wide_right).toPandas()
    found = found.set_index(pd.to_datetime(found["month_end"])).drop(columns="month_end").sort_index()
    want = pd.merge(left, right, left_index=True, right_index=True, how="outer")
    assert_same(found, want)


def test_segments(spark):
    wide = random_wide(4, series=1, length=10, missing=0.0)
    y = wide["s0"].to_numpy()
    rows = windows.segment_midpoints(to_panel(spark, wide)).orderBy("from_month").collect()
    assert [r["midpoint"] for r in rows] == pytest.approx(list((y[:-1] + y[1:]) / 2))


def test_scale(spark):
    wide = random_wide(4, series=1, length=10, missing=0.0)
    y = wide["s0"].to_numpy()
    rows = windows.scale_positions(to_panel(spark, wide), -6).orderBy("month_end").collect()
    assert [r["position"] for r in rows] == pytest.approx(list((y + 6) / (y.max() + 6)))
