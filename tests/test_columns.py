"""Files are read by their columns' names, whatever the order and the company."""

from __future__ import annotations

import datetime as dt

import pytest

from monthloom.sources import parse_lines, read_catalog, read_columns, read_landed_series, read_quotes
from monthloom.streaming import land_new_files, stream_series
from tests.frames import day

CATALOG = ["source", "data_name", "secondary_name", "data_link", "paginated", "column_to_groupby", "value_name"]


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def test_catalog_in_any_order(spark, tmp_path):
    path = put(
        tmp_path / "c",
        "catalog.csv",
        'data_name,source,note,value_name,secondary_name,column_to_groupby,paginated,data_link\n'
        'X,fred,"a, ""quoted"" note",,x_name,,no,\n,eia_api,,value,_load,grp,yes,link\n',
    )
    catalog = read_catalog(spark, path)
    assert catalog.columns == CATALOG
    assert sorted(map(tuple, catalog.collect())) == [
        ("eia_api", None, "_load", "link", "yes", "grp", "value"),
        ("fred", "X", "x_name", None, "no", None, None),
    ]


def test_quotes_with_the_date_first(spark, tmp_path):
    path = put(tmp_path / "q", "a.csv", "trade_date,close,ticker,volume\n2024-01-02,1.5,T,7\n20240103,nan,T,\n")
    assert sorted(map(tuple, read_quotes(spark, path, "csv").collect())) == [
        ("T", day("2024-01-02"), 1.5),
        ("T", day("2024-01-03"), None),
    ]


@pytest.mark.parametrize("fmt", ["csv", "json", "orc", "parquet"])
def test_landed_rows_by_name_in_every_format(spark, tmp_path, fmt):
    rows = spark.createDataFrame([(7, "n", 1.5, "2024-01-31", "X")], "row INT, note STRING, value DOUBLE, date STRING, data_name STRING")
    writer = rows.write.option("header", True) if fmt == "csv" else rows.write
    writer.format(fmt).save(str(tmp_path / "rows"))
    assert [tuple(r) for r in read_landed_series(spark, str(tmp_path / "rows"), fmt).collect()] == [("X", "2024-01-31", 1.5)]


@pytest.mark.parametrize("fmt", ["orc", "parquet"])
def test_other_types_of_numbers_and_dates(spark, tmp_path, fmt):
    rows = spark.createDataFrame([(dt.date(2024, 1, 31), 3, "X")], "date DATE, value INT, data_name STRING")
    rows.write.format(fmt).save(str(tmp_path / "rows"))
    assert [tuple(r) for r in read_landed_series(spark, str(tmp_path / "rows"), fmt).collect()] == [("X", "2024-01-31", 3.0)]


@pytest.mark.parametrize("fmt", ["csv", "orc", "parquet"])
def test_a_missing_column_fails(spark, tmp_path, fmt):
    rows = spark.createDataFrame([("X", "2024-01-31", 1.0)], "data_name STRING, date STRING, price DOUBLE")
    writer = rows.write.option("header", True) if fmt == "csv" else rows.write
    writer.format(fmt).save(str(tmp_path / "rows"))
    with pytest.raises(ValueError, match="no column value; its columns are data_name, date, price"):
        read_landed_series(spark, str(tmp_path / "rows"), fmt)


def test_a_column_that_is_there_twice_fails(spark, tmp_path):
    with pytest.raises(ValueError, match="more than one column close"):
        parse_lines(spark.createDataFrame([("1,2,3",)], "line STRING"), "close,ticker,close", "close DOUBLE")
    path = put(tmp_path / "q", "a.csv", "ticker,close,close,trade_date\nT,1,2,2024-01-02\n")
    with pytest.raises(ValueError, match="no column close"):
        read_quotes(spark, path, "csv")


def test_files_of_one_directory_with_other_headers_fail(spark, tmp_path):
    put(tmp_path / "q", "a.csv", "ticker,trade_date,close\nT,2024-01-02,1\n")
    path = put(tmp_path / "q", "b.csv", "close,trade_date,ticker\n2,2024-01-03,T\n")
    with pytest.raises(Exception, match="does not conform"):
        read_quotes(spark, path, "csv").collect()


def test_text_that_is_no_number_or_date_fails(spark, tmp_path):
    path = put(tmp_path / "q", "a.csv", "ticker,trade_date,close\nT,2024-01-02,cheap\n")
    with pytest.raises(Exception, match="not a double: cheap"):
        read_quotes(spark, path, "csv").collect()
    path = put(tmp_path / "d", "a.csv", "ticker,trade_date,close\nT,soon,1\n")
    with pytest.raises(Exception, match="not a date: soon"):
        read_quotes(spark, path, "csv").collect()


def test_json_rows_by_name(spark, tmp_path):
    path = put(tmp_path / "j", "a.json", '{"value": "2.5", "z": [1], "data_name": "X", "date": "2024-01"}\n{"date": "2024-02", "data_name": "X"}\n{"value": 4, "date": "2024-03", "data_name": "X"}\n')
    assert sorted(map(tuple, read_landed_series(spark, path, "json").collect())) == [
        ("X", "2024-01", 2.5),
        ("X", "2024-02", None),
        ("X", "2024-03", 4.0),
    ]


def test_names_with_blanks_and_a_mark_at_the_files_start(spark, tmp_path):
    path = put(tmp_path / "q", "a.csv", "﻿ticker, trade_date ,a`b,close\nT,2024-01-02,x,1\n")
    assert [tuple(r) for r in read_columns(spark, path, "close DOUBLE, ticker STRING", "csv").collect()] == [(1.0, "T")]


def test_only_wanted_columns_are_read(spark, tmp_path):
    path = put(tmp_path / "q", "a.csv", "a,ticker,trade_date,b,close\n1,T,2024-01-02,2,3\n")
    plan = read_quotes(spark, path, "csv")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ticker:string,trade_date:string,close:string>" in plan


def test_stream_by_header(spark, tmp_path):
    path = put(tmp_path / "s", "a.csv", "value,data_name,note,date\n1.5,X,n,2024-01\n")

    def run():
        land_new_files(stream_series(spark, path, "csv"), str(tmp_path / "t"), str(tmp_path / "k")).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect())

    assert run() == [("X", "2024-01", 1.5)]
    put(tmp_path / "s", "b.csv", "value,data_name,note,date\n2.5,X,n,2024-02\n")
    assert run() == [("X", "2024-01", 1.5), ("X", "2024-02", 2.5)]
    put(tmp_path / "s", "c.csv", "date,data_name,note,value\n2024-03,X,n,3.5\n")
    with pytest.raises(Exception, match="does not conform|FAILED_READ_FILE"):
        run()


def test_stream_of_a_folder_that_is_empty_at_first(spark, tmp_path):
    (tmp_path / "s").mkdir()
    land_new_files(stream_series(spark, str(tmp_path / "s"), "csv"), str(tmp_path / "t"), str(tmp_path / "k")).awaitTermination()
    put(tmp_path / "s", "a.csv", "data_name,date,value\nX,2024-01,1.5\n")
    land_new_files(stream_series(spark, str(tmp_path / "s"), "csv"), str(tmp_path / "t"), str(tmp_path / "k")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [("X", "2024-01", 1.5)]
