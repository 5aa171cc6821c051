"""Take up landed files as they arrive, each exactly once.

The batch readers read a landing directory whole on every run.  A file stream
remembers what it has read, so a run with ``availableNow`` costs what is new.
Rows are appended as landed; cleaning and months stay with the batch jobs,
since a page or figure that comes late changes its whole month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from monthloom.schemas import LANDED_SERIES, PAGE
from monthloom.sources.columns import CSV_OPTIONS, fields_of, header_of, select_typed


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New JSON pages under ``data_link=<key>`` directories."""
    reader = spark.readStream.schema(f"{PAGE}, data_link STRING").option("multiLine", True)
    return reader.option("maxFilesPerTrigger", files_per_batch).json(path)


def stream_series(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """New files of (data_name, date text, value) rows.

    CSV files are read by the header of those that are there when the stream
    starts, and in the declared order if there is none yet; one that has
    another header fails the stream.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    if fmt != "csv":
        return reader.schema(LANDED_SERIES).format(fmt).load(path)
    names = header_of(spark, path) or [name for name, _ in fields_of(LANDED_SERIES)]
    text = StructType([StructField(name, StringType()) for name in names])
    return select_typed(reader.schema(text).options(**CSV_OPTIONS).csv(path), LANDED_SERIES, path)


def land_new_files(stream: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Append everything new to a Parquet table and stop.

    The file sink's log and the checkpoint, both on shared storage, make the
    append exactly-once across lost executors and repeated runs.
    """
    return (
        stream.writeStream.format("parquet")
        .option("path", table_path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
