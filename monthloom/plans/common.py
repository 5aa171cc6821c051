"""Steps that several reports share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.operators.broadcasting import literal_rows
from monthloom.operators.clean import select_renamed
from monthloom.operators.filters import keep_series
from monthloom.operators.stats import correlation_matrix, measure_bounds


# What a report does with the frame that all its outputs start from; a job writes it.
Share = Callable[[DataFrame], DataFrame]


def unshared(frame: DataFrame) -> DataFrame:
    return frame


class Outputs(Mapping[str, DataFrame]):
    """A report's output frames by name, each planned when it is asked for.

    Spark analyses a frame at every step that builds it, so a caller who wants
    one output should not wait for the plans of all.
    """

    def __init__(self, **recipes: Callable[[], DataFrame]):
        self._recipes = recipes
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._recipes[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._recipes)

    def __len__(self) -> int:
        return len(self._recipes)


def figures(panel: DataFrame, by_name: Mapping[str, str]) -> DataFrame:
    """Level and change of each figure's series, all figures in one frame.

    One frame is one pass over the panel; written partitioned by figure, it is
    one directory per figure.
    """
    named = {series: name for name, series in by_name.items()}
    rows = keep_series(panel, named)
    return rows.select(_name_of(named).alias("figure"), "series_id", "month_end", "value", "yoy")


def change_bounds(panel: DataFrame, series: Iterable[str]) -> DataFrame:
    """Colour bounds of the change bars."""
    return measure_bounds(keep_series(panel, series), "yoy")


def _name_of(names: Mapping[str, str]) -> Column:
    chosen: Column | None = None
    for series, label in names.items():
        test = F.col("series_id") == series
        chosen = F.when(test, label) if chosen is None else chosen.when(test, label)
    return chosen if chosen is not None else F.lit(None).cast("string")


def variables(panel: DataFrame, levels: Mapping[str, str], changes: Mapping[str, str]) -> DataFrame:
    """Levels and changes as variables of a long panel, under their labels."""
    both = F.array(
        F.struct(_name_of(levels).alias("series_id"), F.col("value").alias("value")),
        F.struct(_name_of(changes).alias("series_id"), F.col("yoy").alias("value")),
    )
    named = keep_series(panel, {**levels, **changes})
    rows = named.select("month_end", F.explode(both).alias("v")).select("v.series_id", "month_end", "v.value")
    return rows.where(F.col("series_id").isNotNull())


def correlations(panel: DataFrame, levels: Mapping[str, str], changes: Mapping[str, str] | None = None) -> DataFrame:
    """Correlation matrix of the report's variables."""
    if not changes:
        return correlation_matrix(select_renamed(panel, levels), list(levels.values()))
    return correlation_matrix(variables(panel, levels, changes), [*levels.values(), *changes.values()])


def region_dimension(panel: DataFrame, regions: Mapping[str, str]) -> DataFrame:
    """Rows (region, series_id)."""
    return literal_rows(panel.sparkSession, list(regions.items()), "region STRING, series_id STRING")
