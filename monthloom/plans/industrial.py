"""Industry: output, orders, housing and manufacturing employment."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.operators.broadcasting import literal_rows
from monthloom.operators.clean import with_labels
from monthloom.operators.derive import cpi_rebase, one_series
from monthloom.operators.filters import Day, date_bounds, date_range, keep_series, since
from monthloom.operators.panel import complete_months, on_months
from monthloom.operators.windows import yoy_calendar
from monthloom.plans import names
from monthloom.plans.common import Outputs, Share, change_bounds, correlations, figures, unshared

SERIES = names.INDUSTRIAL_PLAIN + names.PRICE_ADJUSTED
LABELS = {**names.OUTPUT_LABELS, **names.ORDERS_LABELS, **names.HOUSING_LABELS}
TOTALS = {
    "orders_total": names.ORDERS_TOTAL,
    "housing_total": names.HOUSING_TOTAL,
    "manufacturing_employment": "manufact_employee",
}


def industrial_frame(
    panel: DataFrame,
    epoch: Day = names.INDUSTRIAL_EPOCH,
    base_month: Day = names.CPI_BASE_MONTH,
    mode: str = "inflate",
) -> DataFrame:
    """The report's series since the epoch, price series rebased, with changes."""
    chosen = keep_series(panel, SERIES)
    index = one_series(chosen, names.CPI)
    return yoy_calendar(cpi_rebase(since(chosen, epoch), index, base_month, names.PRICE_ADJUSTED, mode))


def complete_output(shown: DataFrame) -> DataFrame:
    """Output series on the months where all of them, and the total's change, exist."""
    outputs = (names.OUTPUT_TOTAL, *names.OUTPUT_LABELS)
    has_change = (F.col("series_id") != names.OUTPUT_TOTAL) | F.col("yoy").isNotNull()
    months = complete_months(shown.where(has_change), outputs)
    return on_months(keep_series(shown, outputs), months)


def _by_category(shown: DataFrame, chosen: Iterable[str]) -> DataFrame:
    labels = literal_rows(shown.sparkSession, list(LABELS.items()), "code STRING, label STRING")
    return with_labels(keep_series(shown, chosen), labels).select("series_id", "label", "month_end", "value")


def industrial_report(
    panel: DataFrame,
    start: Day = None,
    end: Day = None,
    epoch: Day = names.INDUSTRIAL_EPOCH,
    base_month: Day = names.CPI_BASE_MONTH,
    mode: str = "inflate",
    outputs: Iterable[str] = tuple(names.OUTPUT_LABELS),
    orders: Iterable[str] = tuple(names.ORDERS_LABELS),
    housing: Iterable[str] = tuple(names.HOUSING_LABELS),
    share: Share = unshared,
    history: DataFrame | None = None,
) -> Outputs:
    """``history`` is the panel behind ``date_bounds`` where ``panel`` holds only the years of the range."""
    shown = share(date_range(industrial_frame(panel, epoch, base_month, mode), start, end))
    whole = keep_series(panel if history is None else history, SERIES)
    output = complete_output(shown)
    return Outputs(
        date_bounds=lambda: date_bounds(since(whole, epoch)),
        figures=lambda: figures(shown, TOTALS),
        output_total=lambda: figures(output, {"output_total": names.OUTPUT_TOTAL}),
        output_by_category=lambda: _by_category(output, outputs),
        orders_by_category=lambda: _by_category(shown, orders),
        housing_by_region=lambda: _by_category(shown, housing),
        change_bounds=lambda: change_bounds(shown, TOTALS.values()).unionByName(
            change_bounds(output, [names.OUTPUT_TOTAL])
        ),
        correlation=lambda: correlations(
            shown, names.INDUSTRIAL_LEVEL_VARIABLES, names.INDUSTRIAL_CHANGE_VARIABLES
        ),
    )
