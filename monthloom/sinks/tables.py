"""Panels and report outputs as Parquet."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PANEL = "series_id STRING, month_end DATE, value DOUBLE, year INT"


def write_panel(panel: DataFrame, path: str) -> None:
    """Write a panel partitioned by year.

    The rebalance hint lets AQE merge small and split large partitions, so a
    year becomes few well-sized files however uneven the years are.  Sorting
    by series lets a report that reads some of them skip row groups.
    """
    by_year = panel.withColumn("year", F.year("month_end")).hint("rebalance", "year")
    ordered = by_year.sortWithinPartitions("year", "series_id", "month_end")
    ordered.write.mode("overwrite").partitionBy("year").parquet(path)


def read_panel(spark: SparkSession, path: str, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """A written panel, or the partitions of some of its years."""
    panel = spark.read.schema(PANEL).parquet(path)
    if first_year is not None:
        panel = panel.where(F.col("year") >= first_year)
    if last_year is not None:
        panel = panel.where(F.col("year") <= last_year)
    return panel.drop("year")


def panel_years(spark: SparkSession, path: str) -> list[int]:
    """The years that a written panel holds, from the names of its partitions; no row is read."""
    files = spark.read.schema(PANEL).parquet(path).inputFiles()
    return sorted({int(year) for file in files for year in re.findall(r"/year=(\d+)/", file)})


def newest_month(spark: SparkSession, path: str) -> dt.date | None:
    """The last month of a written panel, from the last of its years."""
    for year in reversed(panel_years(spark, path)):
        found = read_panel(spark, path, year, year).agg(F.max("month_end")).first()[0]
        if found is not None:
            return found
    return None


def write_report(outputs: Mapping[str, DataFrame], path: str, report: str) -> None:
    """One directory per named output, under the report's own, all of them or none.

    A run that fails leaves the report of the run before as it was; one that
    succeeds leaves nothing of it, also not outputs that were not asked for again.
    """
    spark = next(iter(outputs.values())).sparkSession if outputs else None
    if spark is not None:
        with staged_report(spark, path, report) as folder:
            write_outputs(outputs, folder)


def write_outputs(outputs: Mapping[str, DataFrame], folder: str) -> None:
    for name, frame in outputs.items():
        frame.write.mode("overwrite").parquet(f"{folder}/output={name}")


@contextmanager
def staged_report(spark: SparkSession, path: str, report: str) -> Iterator[str]:
    """A folder to write a report to, which takes the report's place when all is written.

    The folder lies beside the report's, so taking the place is a rename.  Its
    name begins with an underscore, which readers skip.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    run = uuid.uuid4().hex
    staged, replaced, final = (hadoop.Path(f"{path}/{name}") for name in (f"_staged-{report}-{run}", f"_replaced-{report}-{run}", f"report={report}"))
    files = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        yield staged.toString()
        had = files.exists(final)
        if had and not files.rename(final, replaced):
            raise OSError(f"cannot put {final} aside")
        if not files.rename(staged, final):
            if had:
                files.rename(replaced, final)
            raise OSError(f"cannot put {staged} in place of {final}")
        if had:
            files.delete(replaced, True)
    finally:
        files.delete(staged, True)


def shared_frame(frame: DataFrame, folder: str) -> DataFrame:
    """The frame behind a report's outputs, written beside them and read back."""
    target = f"{folder}/frame"
    frame.write.mode("overwrite").parquet(target)
    return frame.sparkSession.read.schema(frame.schema).parquet(target)


def read_output(spark: SparkSession, path: str, report: str, output: str) -> DataFrame:
    return spark.read.parquet(f"{path}/report={report}/output={output}")
