"""Landed JSON pages of a paged source.

A page is a bounded slice of a payload.  Reading a directory unites the pages
of every payload at once; the audit tells whether all of them have arrived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.functions import drop_null_tokens, nan_to_null, strict_double
from monthloom.schemas import PAGE
from monthloom.sources.catalog import PAGED_SOURCE, route


def read_pages(spark: SparkSession, path: str, multi_line: bool = True, fmt: str = "json") -> DataFrame:
    """Pages of a directory with one subdirectory ``data_link=<key>`` per payload.

    ``fmt`` is "json" for pages as they were sent, "parquet" for those that
    the stream has landed.
    """
    reader = spark.read.schema(f"{PAGE}, data_link STRING")
    pages = reader.option("multiLine", multi_line).json(path) if fmt == "json" else reader.format(fmt).load(path)
    return pages.withColumn("page", F.col("_metadata.file_path"))


def parse_pages(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Pages held as JSON text in a column; malformed text fails the job."""
    parsed = F.from_json(F.col(body), F.lit(PAGE), {"mode": "FAILFAST"})
    return bodies.withColumn("response", parsed["response"]).drop(body)


def flatten_pages(pages: DataFrame, *keys: str) -> DataFrame:
    """One row per record, with the page's key columns."""
    return pages.select(*keys, F.explode("response.data").alias("record"))


def page_identity(data: Column) -> Column:
    """What tells a page from others: a digest of its records, two hashes wide.

    Pages carry no number.  A page that was landed twice holds the same records
    in the same order, and two pages of one payload never do.
    """
    entries = F.transform(data, F.map_entries)
    return F.struct(F.xxhash64(entries).alias("a"), F.hash(entries).alias("b"))


def audit_pages(pages: DataFrame, *keys: str) -> DataFrame:
    """Per payload: rows of its different pages against the total they declare.

    A page that was landed again counts once (pages_repeated says how often it
    happened), so it never stands in for one that is missing; rows_surplus says
    how many rows more than declared have landed, repeated pages included.  A
    payload is complete if its different pages hold as many rows as declared.
    Pages are summed by their identity first, and the payload with a third of
    all pages is one row per page after that.
    """
    data = F.col("response.data")
    size = F.when(data.isNull(), F.lit(0)).otherwise(F.size(data)).cast("bigint")
    landed = pages.select(
        *keys, page_identity(data).alias("_page"), size.alias("_size"), F.col("response.total").cast("bigint").alias("_total")
    )
    by_page = landed.groupBy(*keys, "_page.a", "_page.b").agg(
        F.count(F.lit(1)).alias("_landed"), F.max("_size").alias("_size"), F.max("_total").alias("_total")
    )
    repeated = F.when(F.col("_size") > 0, F.col("_landed") - 1).otherwise(F.lit(0).cast("bigint"))
    surplus = F.greatest(F.sum(F.col("_landed") * F.col("_size")) - F.max("_total"), F.lit(0).cast("bigint"))
    return (
        by_page.groupBy(*keys)
        .agg(
            F.sum("_landed").alias("pages"),
            F.sum(repeated).alias("pages_repeated"),
            F.sum("_size").alias("rows_held"),
            F.max("_total").alias("rows_declared"),
            surplus.alias("rows_surplus"),
        )
        .withColumn("is_complete", F.col("rows_held") == F.col("rows_declared"))
    )


def distinct_pages(pages: DataFrame, *keys: str) -> DataFrame:
    """Each page of a payload once, however often it was landed."""
    identity = page_identity(F.col("response.data"))
    marked = pages.withColumn("_page", F.when(F.size("response.data") > 0, identity))
    full = marked.where(F.col("_page").isNotNull())
    empty = marked.where(F.col("_page").isNull())
    return full.dropDuplicates([*keys, "_page"]).unionByName(empty).drop("_page")


def catalog_records(pages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Records with the value and group that the catalog row points at.

    Columns: secondary_name, date (text), grp (NULL for a payload of one
    series) and value.  Records of grouped payloads lose null tokens and
    incomplete rows; bad number text fails the job.
    """
    rules = route(catalog, PAGED_SOURCE).select(
        "data_link", "secondary_name", "column_to_groupby", F.coalesce("value_name", F.lit("value")).alias("value_name")
    )
    named = pages.join(rules, "data_link")
    records = flatten_pages(named, "secondary_name", "column_to_groupby", "value_name")
    grouped = F.col("column_to_groupby").isNotNull()
    date = F.col("record")["period"]
    text = F.when(grouped, F.try_element_at("record", F.col("value_name"))).otherwise(F.col("record")["value"])
    group = F.when(grouped, F.try_element_at("record", F.col("column_to_groupby")))
    rows = records.select(
        "secondary_name",
        grouped.alias("is_grouped"),
        F.when(grouped, drop_null_tokens(date)).otherwise(date).alias("date"),
        F.when(grouped, drop_null_tokens(group)).alias("grp"),
        F.when(grouped, drop_null_tokens(text)).otherwise(text).alias("text"),
    )
    complete = F.col("date").isNotNull() & F.col("grp").isNotNull() & F.col("text").isNotNull()
    return rows.where(~F.col("is_grouped") | complete).select(
        "secondary_name", "date", "grp", nan_to_null(strict_double(F.col("text"))).alias("value")
    )
