"""What several operators share: tables of the driver, the shared folder, batches of bounded size."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from weakref import WeakKeyDictionary

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: A white-space separated word; fixed by the contracts.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="monthloom-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir, or that the context has.

    Without either, a folder of this machine serves a session that runs on it
    alone; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{folder or _own_folder()}/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(frame: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """The frame as a table in the shared folder: its lineage ends there, and a lost executor loses nothing.

    As nothing goes back behind the table, the shuffles that made it go with it.
    """
    spark = frame.sparkSession
    path, before = shared_folder(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        frame.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(frame.schema).parquet(path)
    _PATHS[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for frame in tables:
        spark, path = frame.sparkSession, _PATHS.pop(frame)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def lean(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows; afterwards the worker, which lives on, gives freed Arrow memory back."""
    yield from rows
    pa.default_memory_pool().release_unused()


def batches_of(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold about ``max_bytes``; a longer text makes a slice of its own."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch[column]).cast("int64"), 0)).to_numpy()
    begin = 0
    while begin < len(batch):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(ends.searchsorted(before + max_bytes, "right")))
        yield batch.slice(begin, end - begin)
        begin = end
