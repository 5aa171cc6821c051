"""Every query with a SQL counterpart gives the same rows in DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks.compare import compare, open_tables
from checks.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return open_tables(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, connection, sf_dir, name):
    same, note = compare(spark, connection, name, sf_dir)
    assert same, note


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


def test_entry_gives_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["series_id", "month_end", "yoy"]
    assert frame.limit(1).count() == 1
