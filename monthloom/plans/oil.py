"""Oil: production, trade, price and employment."""

from __future__ import annotations

from pyspark.sql import DataFrame

from monthloom.operators.broadcasting import literal_rows
from monthloom.operators.clean import with_labels
from monthloom.operators.filters import Day, date_bounds, date_range, keep_series, latest_values
from monthloom.operators.panel import complete_cases, complete_months
from monthloom.operators.windows import yoy_rows
from monthloom.plans import names
from monthloom.plans.common import Outputs, Share, change_bounds, correlations, figures, unshared


def oil_frame(panel: DataFrame) -> DataFrame:
    """Months with every series of the report, and changes between those months."""
    return yoy_rows(complete_cases(panel, names.OIL_SERIES))


def latest_by_region(shown: DataFrame) -> DataFrame:
    """Last production per region; no rows when the range is empty."""
    labels = literal_rows(shown.sparkSession, list(names.OIL_REGIONS.items()), "code STRING, label STRING")
    last = latest_values(keep_series(shown, names.OIL_REGIONS), "value")
    return with_labels(last, labels).selectExpr("label AS area", "value AS production")


def oil_report(
    panel: DataFrame, start: Day = None, end: Day = None, share: Share = unshared, history: DataFrame | None = None
) -> Outputs:
    """``history`` is the panel behind ``date_bounds`` where ``panel`` holds only the years of the range."""
    shown = share(date_range(oil_frame(panel), start, end))
    months = complete_months(panel if history is None else history, names.OIL_SERIES)
    return Outputs(
        date_bounds=lambda: date_bounds(months),
        figures=lambda: figures(shown, names.OIL_FIGURES),
        change_bounds=lambda: change_bounds(shown, names.OIL_FIGURES.values()),
        latest_by_region=lambda: latest_by_region(shown),
        correlation=lambda: correlations(shown, names.OIL_LEVEL_VARIABLES, names.OIL_CHANGE_VARIABLES),
    )
