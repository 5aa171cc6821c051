"""Fuel prices by region and for the nation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.functions import half_even
from monthloom.operators.derive import drill_series, latest_region, region_rollout, region_states, with_cards
from monthloom.operators.filters import Day, date_bounds, date_range
from monthloom.operators.panel import complete_cases, complete_months
from monthloom.operators.windows import yoy_rows
from monthloom.plans import names
from monthloom.plans.common import Outputs, Share, region_dimension, unshared


def fuel_frame(panel: DataFrame) -> DataFrame:
    """Months with every price of the report, and changes between those months."""
    return yoy_rows(complete_cases(panel, names.FUEL_SERIES))


def drill(shown: DataFrame, level: str, selected: str | None = None) -> DataFrame:
    """Price lines at a drill level."""
    return drill_series(shown, names.FUEL_NATIONAL, names.FUEL_REGIONS, level, selected)


def latest_by_state(shown: DataFrame) -> DataFrame:
    """Each state with its region's last price and change, as figures and as text."""
    latest = latest_region(shown, region_dimension(shown, names.FUEL_REGIONS))
    return region_rollout(with_cards(latest), region_states(shown.sparkSession, names.FUEL_REGION_STATES))


def national_card(shown: DataFrame) -> DataFrame:
    """The nation's last price and change, both rounded."""
    nation = region_dimension(shown, {"USA Avg": names.FUEL_NATIONAL})
    return with_cards(latest_region(shown, nation).withColumn("price", half_even(F.col("price"))))


def fuel_report(
    panel: DataFrame,
    start: Day = None,
    end: Day = None,
    region: str | None = None,
    share: Share = unshared,
    history: DataFrame | None = None,
) -> Outputs:
    """With a ``region``, region_history holds that one alone.

    ``history`` is the panel behind ``date_bounds`` where ``panel`` holds only
    the years of the range.
    """
    shown = share(date_range(fuel_frame(panel), start, end))
    months = complete_months(panel if history is None else history, names.FUEL_SERIES)
    return Outputs(
        date_bounds=lambda: date_bounds(months),
        latest_by_state=lambda: latest_by_state(shown),
        national_card=lambda: national_card(shown),
        region_history=lambda: drill(shown, "region", region),
        national_history=lambda: drill(shown, "national"),
    )
