"""Recent developments: core correlations and the latest oil figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthloom.functions import format_month_year, position_between
from monthloom.operators.filters import Day, as_day, first_month, keep_series, look_back, months_later, since
from monthloom.operators.panel import last_months
from monthloom.operators.stats import rounded
from monthloom.operators.windows import YEAR, segment_midpoints, yoy_calendar
from monthloom.plans import names
from monthloom.plans.common import Outputs, Share, correlations, unshared


SERIES = tuple(
    dict.fromkeys(
        (
            *names.CORE_VARIABLES,
            *names.SPENDING_AND_STAFF,
            *names.OIL_PRODUCTION_LINES,
            *names.OIL_EXPORT_LINES,
            names.OIL_TOTAL,
        )
    )
)


def change_segments(
    panel: DataFrame,
    series: str = names.OIL_TOTAL,
    months: int = names.RECENT_MONTHS,
    newest: Day = None,
) -> DataFrame:
    """Yearly change over the panel's last months, as coloured line segments.

    The months are the panel's last ones, so a series that ends earlier shows
    fewer; ``newest`` says the last one where ``panel`` does not hold all series.
    Changes are taken before the cut and missing ones left out after.
    """
    changed = yoy_calendar(keep_series(panel, [series]))
    if newest is None:
        recent = last_months(changed, months, of=panel)
    else:
        recent = since(changed, months_later(first_month(newest), 1 - months))
    segments = segment_midpoints(recent.where(F.col("yoy").isNotNull()), "yoy")
    high = F.max(F.greatest("from_value", "to_value")).over(Window.partitionBy("series_id"))
    return segments.withColumns(
        {
            "position": position_between(F.col("midpoint"), F.lit(names.COLOUR_SCALE_LOW), high),
            "from_label": format_month_year(F.col("from_month")),
        }
    )


def recent_frame(panel: DataFrame, epoch: Day, newest: Day) -> DataFrame:
    """What all outputs are made of: the core variables of all time, and of the others what is since the epoch or may be among the last months."""
    last = months_later(first_month(newest), 1 - names.RECENT_MONTHS)
    needed = min(as_day(epoch), look_back(last, YEAR))
    core = F.col("series_id").isin(*names.CORE_VARIABLES)
    return keep_series(panel, SERIES).where(core | (F.col("month_end") >= F.lit(needed)))


def recent_report(
    panel: DataFrame,
    epoch: Day = names.RECENT_EPOCH,
    correlation_epoch: Day = names.RECENT_CORRELATION_EPOCH,
    newest: Day = None,
    share: Share = unshared,
) -> Outputs:
    """With ``newest``, the panel's last month, all outputs start from one frame, which ``share`` may write."""
    frame = panel if newest is None else share(recent_frame(panel, epoch, newest))
    recent = since(frame, epoch)
    late = since(frame, correlation_epoch)
    return Outputs(
        correlation=lambda: rounded(correlations(frame, names.CORE_VARIABLES)),
        recent_correlation=lambda: correlations(late, names.CORE_VARIABLES),
        spending_and_staff=lambda: keep_series(recent, names.SPENDING_AND_STAFF),
        oil_production=lambda: keep_series(recent, names.OIL_PRODUCTION_LINES),
        oil_exports=lambda: keep_series(recent, names.OIL_EXPORT_LINES),
        oil_change_segments=lambda: change_segments(frame, newest=newest),
    )
