"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

from monthloom.shipping import ship_package

# ANSI keeps text casts strict, UTC keeps dates free of the machine's zone, and
# AQE picks shuffle widths, splits skewed join partitions and turns joins with
# a small side into broadcasts from measured sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Many narrow partitions to begin with, which AQE merges by their measured
    # sizes; it cannot split those of an aggregation.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4096",
}


def get_session(app_name: str = "monthloom", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session, or reuse the running one, and give its executors this package.

    ``master`` stays unset on a cluster.  Further settings are given by name,
    as in ``**{"spark.sql.shuffle.partitions": "8"}``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**SETTINGS, **conf}
    if "spark.sql.shuffle.partitions" in conf:  # a caller's own width holds
        settings.pop("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())
