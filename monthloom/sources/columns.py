"""Columns of landed files, found by their names.

The order of a file's columns is its sender's business, and so are columns that
nobody asked for.  A column that is asked for and not there fails, and so does
text that is no number or date where one is due.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.functions import parse_mixed_date, strict_double

# Quotes inside of quoted fields are doubled.  With enforceSchema off, Spark
# compares the header of every file with the names it reads by, so files of one
# directory whose columns differ in order fail instead of being misread.
CSV_OPTIONS = {"header": True, "enforceSchema": False, "quote": '"', "escape": '"'}


def fields_of(schema: str) -> list[tuple[str, str]]:
    """(name, type) of a schema like "a STRING, b DOUBLE"."""
    return [tuple(field.split()) for field in schema.split(",")]


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _typed(column: Column, kind: str, is_text: bool) -> Column:
    if is_text and kind == "DOUBLE":
        return strict_double(column)
    if is_text and kind == "DATE":
        return parse_mixed_date(column)
    return column.cast(kind)


def _found(names: Sequence[str], wanted: Sequence[str], where: str) -> list[int]:
    """Places of the wanted names; one that is missing or there twice is an error."""
    bare = [name.strip().removeprefix("﻿") for name in names]
    for name in wanted:
        if bare.count(name) != 1:
            trouble = "no" if name not in bare else "more than one"
            raise ValueError(f"{where} has {trouble} column {name}; its columns are {', '.join(bare) or 'none'}")
    return [bare.index(name) for name in wanted]


def select_typed(rows: DataFrame, schema: str, where: str) -> DataFrame:
    """The columns of a schema, found by name, with its types; text is read strictly."""
    fields = fields_of(schema)
    places = _found(rows.columns, [name for name, _ in fields], where)
    kinds = [kind for _, kind in rows.dtypes]
    return rows.select(
        *[
            _typed(_quoted(rows.columns[place]), kind, kinds[place] == "string").alias(name)
            for place, (name, kind) in zip(places, fields)
        ]
    )


def text_schema(schema: str) -> str:
    return ", ".join(f"`{name}` STRING" for name, _ in fields_of(schema))


def read_columns(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    """The columns of a schema from the files of a directory.

    CSV files are read by their header, which one look at one file gives;
    Parquet and ORC files by the names they hold, whatever the types of their
    numbers and dates.  JSON rows have no header, and a field that a row leaves
    out is NULL there, as senders leave out what is missing.
    """
    if fmt == "csv":
        rows = spark.read.options(**CSV_OPTIONS).csv(path)
    elif fmt == "json":
        rows = spark.read.schema(text_schema(schema)).option("mode", "FAILFAST").json(path)
    else:
        rows = spark.read.format(fmt).load(path)
    return select_typed(rows, schema, path)


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The columns of a directory's CSV files; none while there is no file."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return [] if files.isEmpty() else spark.read.options(**CSV_OPTIONS).csv(path).columns


def parse_lines(lines: DataFrame, header: str | Sequence[str], schema: str, column: str = "line") -> DataFrame:
    """The columns of a schema from CSV text lines that stand under a header."""
    names = next(csv.reader([header])) if isinstance(header, str) else list(header)
    fields = fields_of(schema)
    places = _found(names, [name for name, _ in fields], "the header")
    kept = ", ".join(f"c{i} STRING" for i in range(len(names)))
    options = {"mode": "FAILFAST", "quote": CSV_OPTIONS["quote"], "escape": CSV_OPTIONS["escape"]}
    row = lines.select(F.from_csv(F.col(column), F.lit(kept), options).alias("row"))
    return row.select(*[_typed(F.col(f"row.c{place}"), kind, True).alias(name) for place, (name, kind) in zip(places, fields)])
