"""The monthly panel from a catalog and landed files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.functions import parse_mixed_date, series_stem
from monthloom.operators.clean import rename_series
from monthloom.operators.panel import group_means, in_totals, monthly_mean_of_sums, union_panels
from monthloom.operators.windows import yoy_calendar
from monthloom.plans import names
from monthloom.sources.pages import catalog_records
from monthloom.sources.series import catalog_daily_sums


def paged_observations(pages: DataFrame, catalog: DataFrame, not_in_totals: Sequence[str] = ()) -> DataFrame:
    """Sums and counts per date of the paged source, one series per payload or group.

    A grouped payload gives a mean per date and group, and the total of these
    means per date (missing ones count as zero), except for price payloads,
    whose sum has no meaning.  Groups whose name holds "date" are in no total.
    Means and totals come from one reading of the pages: each mean goes to its
    own series and to its payload's total, and one sum per date closes both.
    """
    means = group_means(catalog_records(pages, catalog), ("secondary_name", "date"))
    grouped = F.col("grp").isNotNull()
    suffix = F.col("secondary_name")
    own = F.struct(
        F.when(grouped, series_stem(F.col("grp"), suffix)).otherwise(suffix).alias("series_id"),
        F.col("grp").alias("grp"),
        F.when(grouped, F.lit(1).cast("bigint")).otherwise(F.col("rows")).alias("weight"),
        F.lit(False).alias("is_total"),
    )
    total = F.struct(
        F.concat(F.lit("total"), suffix).alias("series_id"),
        F.lit(None).cast("string").alias("grp"),
        F.lit(1).cast("bigint").alias("weight"),
        F.lit(True).alias("is_total"),
    )
    has_total = grouped & (suffix != names.SUFFIX_WITHOUT_TOTAL) & in_totals(F.col("grp"), suffix, not_in_totals)
    goes_to = F.when(has_total, F.array(own, total)).otherwise(F.array(own))
    rows = means.select("date", "value", F.explode(goes_to).alias("to")).select("date", "value", "to.*")
    value = F.when(F.col("is_total"), F.coalesce("value", F.lit(0.0))).otherwise(F.col("value"))
    summed = rows.groupBy("series_id", "grp", "date").agg(F.sum(value).alias("value"), F.max("weight").alias("weight"))
    present = F.when(F.col("value").isNotNull(), F.col("weight")).otherwise(0)
    return summed.select(
        "series_id",
        parse_mixed_date(F.col("date")).alias("obs_date"),
        (F.col("value") * present).alias("total"),
        present.cast("bigint").alias("rows"),
    )


def with_inflation(panel: DataFrame) -> DataFrame:
    """Add the yearly change of the overall price index as a series.

    The change is taken for all series in one pass and kept for one; a branch
    that filters the index would read the observations behind the panel again.
    """
    own = F.struct("series_id", "value")
    rate = F.struct(F.lit(names.INFLATION).alias("series_id"), F.col("yoy").alias("value"))
    rows = F.when(F.col("series_id") == names.CPI, F.array(own, rate)).otherwise(F.array(own))
    changed = yoy_calendar(panel).select("month_end", F.explode(rows).alias("row"))
    return changed.select("row.series_id", "month_end", "row.value")


def build_panel(
    catalog: DataFrame, landed: DataFrame, pages: DataFrame, not_in_totals: Sequence[str] = ()
) -> DataFrame:
    """Month-end means of every catalogued series, with inflation added."""
    sums = union_panels(catalog_daily_sums(landed, catalog), paged_observations(pages, catalog, not_in_totals))
    return with_inflation(monthly_mean_of_sums(rename_series(sums, names.PANEL_ALIASES)))
