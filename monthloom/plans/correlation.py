"""Correlations of markets and the economy, and the detail of one pair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from monthloom.operators.clean import select_renamed
from monthloom.operators.filters import Day, date_bounds
from monthloom.operators.panel import inner_panels
from monthloom.operators.stats import correlation_matrix, ols_fit, ols_trendline, symmetric_range
from monthloom.operators.windows import YEAR, align_pairs, rolling_beta, rolling_corr
from monthloom.plans import names
from monthloom.plans.common import Outputs, Share, unshared

VARIABLES = (*names.TICKER_LABELS.values(), *names.MACRO_VARIABLES.values())


def correlation_frame(panel: DataFrame, quotes: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """Markets' month-end quotes and the economy's series, on the shared months of a date range.

    ``quotes`` is a panel whose series are tickers, as ``monthly_last`` makes
    it.  The range is part of the frame, so daily quotes and observations are
    read once for the values and for the spans.
    """
    markets = select_renamed(quotes, names.TICKER_LABELS)
    economy = select_renamed(panel, names.MACRO_VARIABLES)
    return inner_panels(markets, economy, start, end)


def pair_detail(shown: DataFrame, x: str, y: str, window: int = YEAR) -> dict[str, Callable[[], DataFrame]]:
    """Rolling measures, fitted line and aligned values of two variables.

    ``shown`` is already cut to the date range, so the rolling measures of the
    range's first months are missing.
    """
    keys = ("var_a", "var_b")

    def aligned() -> DataFrame:
        return align_pairs(shown, [(x, y)])

    def rolling() -> DataFrame:
        both = rolling_beta(rolling_corr(aligned(), window), window)
        return both.select(*keys, "month_end", "rolling_corr", "rolling_beta")

    return {
        "pair": aligned,
        "pair_rolling": rolling,
        "pair_corr_range": lambda: symmetric_range(rolling(), "rolling_corr", *keys),
        "pair_beta_range": lambda: symmetric_range(rolling(), "rolling_beta", *keys),
        "pair_fit": lambda: ols_fit(aligned()),
        "pair_trendline": lambda: ols_trendline(aligned()),
    }


def correlation_report(
    panel: DataFrame,
    quotes: DataFrame,
    start: Day = None,
    end: Day = None,
    pair: tuple[str, str] | None = None,
    window: int = YEAR,
    share: Share = unshared,
) -> Outputs:
    shown = share(correlation_frame(panel, quotes, start, end))
    return Outputs(
        date_bounds=lambda: date_bounds(correlation_frame(panel, quotes)),
        correlation=lambda: correlation_matrix(shown, VARIABLES),
        **(pair_detail(shown, *pair, window=window) if pair else {}),
    )
