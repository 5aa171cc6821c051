"""Prices: inflation, consumer prices and price indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from monthloom.operators.derive import convert_units
from monthloom.operators.filters import Day, date_bounds, date_range, keep_series, since
from monthloom.operators.windows import yoy_calendar
from monthloom.plans import names
from monthloom.plans.common import Outputs, Share, change_bounds, correlations, figures, unshared

SERIES = (*names.CPI_SERIES, names.INFLATION, *names.PRICE_SERIES)
FIGURES = {series: series for series in names.PRICE_FIGURES + names.CPI_FIGURES}


def price_frame(panel: DataFrame, epoch: Day = names.PRICE_EPOCH) -> DataFrame:
    """The report's series since the epoch, in dollars, with changes.

    Cents become dollars before the change is taken, since the rounding that
    goes with it alters the change.
    """
    chosen = since(keep_series(panel, SERIES), epoch)
    return yoy_calendar(convert_units(chosen, names.PRICES_IN_CENTS))


def price_report(
    panel: DataFrame,
    start: Day = None,
    end: Day = None,
    epoch: Day = names.PRICE_EPOCH,
    share: Share = unshared,
    history: DataFrame | None = None,
) -> Outputs:
    """``history`` is the panel behind ``date_bounds`` where ``panel`` holds only the years of the range."""
    shown = share(date_range(price_frame(panel, epoch), start, end))
    whole = panel if history is None else history
    return Outputs(
        date_bounds=lambda: date_bounds(since(keep_series(whole, SERIES), epoch)),
        inflation=lambda: keep_series(shown, [names.INFLATION]).select("month_end", "value"),
        figures=lambda: figures(shown, FIGURES),
        change_bounds=lambda: change_bounds(shown, FIGURES),
        correlation=lambda: correlations(shown, names.PRICE_VARIABLES),
    )
