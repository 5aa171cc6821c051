"""Sides that are sent to all executors, each small by construction.

Rows written in the program, and tables with one row per calendar month.  All
other joins go without a hint: Spark knows the sizes when it runs them.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows that are written in the program or on its command line.

    Passed as an Arrow table they become a local relation in the plan, which
    needs no Python worker and whose size the optimizer knows.
    """
    names = [field.split()[0] for field in schema.split(",")]
    columns = zip(*rows) if rows else [[] for _ in names]
    return F.broadcast(spark.createDataFrame(pa.table(dict(zip(names, map(list, columns)))), schema))


def one_row_per_month(frame: DataFrame) -> DataFrame:
    """Hint for a frame keyed by month.

    The DATE type spans 9,999 years, so such a frame has fewer than 120,000
    rows of a few numbers each, however large the panel it came from.
    """
    return F.broadcast(frame)
