"""Employment by sector and participation rates."""

from __future__ import annotations

from pyspark.sql import DataFrame

from monthloom.operators.filters import Day, date_bounds, date_range, keep_series, since
from monthloom.operators.windows import yoy_after_epoch
from monthloom.plans import names
from monthloom.plans.common import Outputs, Share, change_bounds, correlations, figures, unshared

SERIES = names.EMPLOYEE_SERIES + names.LABOUR_RATE_SERIES
FIGURES = {series: series for series in SERIES}


def employment_frame(panel: DataFrame, epoch: Day = names.EMPLOYMENT_EPOCH) -> DataFrame:
    return yoy_after_epoch(keep_series(panel, SERIES), epoch)


def employment_report(
    panel: DataFrame,
    start: Day = None,
    end: Day = None,
    epoch: Day = names.EMPLOYMENT_EPOCH,
    share: Share = unshared,
    history: DataFrame | None = None,
) -> Outputs:
    """``history`` is the panel behind ``date_bounds`` where ``panel`` holds only the years of the range."""
    shown = share(date_range(employment_frame(panel, epoch), start, end))
    whole = panel if history is None else history
    return Outputs(
        date_bounds=lambda: date_bounds(since(keep_series(whole, SERIES), epoch)),
        figures=lambda: figures(shown, FIGURES),
        change_bounds=lambda: change_bounds(shown, SERIES),
        correlation=lambda: correlations(shown, names.EMPLOYMENT_VARIABLES),
    )
