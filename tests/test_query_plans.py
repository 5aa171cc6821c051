"""The plans hold at scale: what is read, moved, sent and left in the JVM."""

from __future__ import annotations

import re
import time

import pytest

import __spark_entry__  # noqa: F401  registers all queries
from checks import views
from checks.registry import QUERIES
from monthloom.operators import panel, windows
from monthloom.plans import build_panel

MATRIX_QUERIES = {n for n in QUERIES if "corr_matrix" in n or n.endswith("correlation")}


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def formatted(frame) -> str:
    mode = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return frame._jdf.queryExecution().explainString(mode)


@pytest.fixture(scope="module")
def plans(spark, sf_dir):
    return {name: plan_of(build(spark, sf_dir)) for name, build in QUERIES.items()}


def test_no_product_joins(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_only_matrices_use_python(plans):
    for name, plan in plans.items():
        used = re.search(r"InPandas|InArrow|PythonUDF|BatchEvalPython|ArrowEvalPython|ExistingRDD", plan)
        assert bool(used) == (name in MATRIX_QUERIES), name


def test_every_window_is_partitioned(plans):
    for name, plan in plans.items():
        for first in re.findall(r"windowspecdefinition\(([^,]*),", plan):
            assert re.match(r"(series_id|var_a)", first.strip()), (name, first)


def test_facts_are_never_broadcast(spark, sf_dir):
    plan = plan_of(views.obs_region(spark, sf_dir))
    assert "SortMergeJoin" in plan
    for build_side in re.findall(r"BroadcastExchange.*?\n(.*)", plan):
        assert "l_orderkey" not in build_side


def test_scan_reads_three_columns_and_takes_the_date_filter(spark, sf_dir):
    text = formatted(QUERIES["date_range"](spark, sf_dir))
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>" in text
    assert "GreaterThanOrEqual(o_orderdate,1998-03-01T00:00)" in text
    assert "LessThan(o_orderdate,2001-01-01T00:00)" in text


def test_change_after_the_grid_needs_no_further_shuffle(spark, sf_dir):
    rows = panel.monthly_mean(views.obs(spark, sf_dir))
    grid = panel.month_grid(rows, "1995-01-31", "2001-08-31")
    count = lambda f: plan_of(f).count("Exchange hashpartitioning")
    assert count(windows.yoy_rows(grid)) == count(grid) == 2


def _input_rows(spark, frame) -> int:
    """Rows that all scans of a query hand over."""
    store, jvm = spark._jsc.sc().statusStore(), spark._jvm
    empty = spark.sparkContext._gateway.new_array(jvm.double, 0)

    def stages():
        found = store.stageList(jvm.java.util.ArrayList(), False, False, empty, jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).inputRecords() for i in range(found.size())}

    before = set(stages())
    frame.write.format("noop").mode("overwrite").save()
    time.sleep(0.5)
    return sum(rows for stage, rows in stages().items() if stage not in before)


@pytest.mark.parametrize(
    "name, tables",
    [
        ("month_mean", ["orders"]),
        ("month_grid", ["orders", "customer"]),
        ("complete_cases", ["orders", "customer"]),
        ("tail_months", ["orders", "customer"]),
        ("panel_inner", ["lineitem", "orders"]),
        ("cpi_rebase", ["orders", "lineitem"]),
        ("report_oil", ["lineitem"]),
        ("report_price", ["lineitem"]),
        ("report_employment", ["lineitem"]),
        ("report_industrial", ["lineitem"]),
        ("report_gas_history", ["lineitem"]),
        ("quotes_month_last", ["lineitem"]),
        ("quotes_ties", ["lineitem"]),
        # lines stand in for quotes and for observations, and each of the two is read once
        ("report_correlation", ["lineitem", "lineitem"]),
        ("report_pair", ["lineitem", "lineitem"]),
        ("report_pair_rolling", ["lineitem", "lineitem"]),
        ("report_pair_trendline", ["lineitem", "lineitem"]),
        ("report_pair_fit", ["lineitem", "lineitem"]),
        ("report_pair_ranges", ["lineitem", "lineitem"]),
        ("report_recent", ["lineitem"]),
        ("report_recent_correlation", ["lineitem"]),
        ("report_recent_lines", ["lineitem"]),
    ],
)
def test_tables_are_read_once(spark, sf_dir, name, tables):
    held = sum(views.table(spark, sf_dir, t).count() for t in tables)
    read = _input_rows(spark, QUERIES[name](spark, sf_dir))
    # A month axis starts from one row; the rest are the tables themselves.
    assert held <= read <= held + 2, name


@pytest.mark.parametrize("others", [0, 60_000])
def test_the_catalogs_size_changes_neither_plan_nor_result(spark, others):
    """A landed row of no catalogued source does not matter either, whatever its text."""
    schema = "source STRING, data_name STRING, secondary_name STRING, data_link STRING, paginated STRING, column_to_groupby STRING, value_name STRING"
    catalog = spark.createDataFrame([("fred", "X", "x", None, "no", None, None), ("eia_api", None, "_load", "l", "yes", "g", "v")], schema)
    if others:
        catalog = catalog.union(spark.range(others).selectExpr("'fred'", "concat('N', id)", "concat('n', id)", "NULL", "'no'", "NULL", "NULL"))
    landed = spark.createDataFrame([("X", "2024-01-02", 1.0), ("X", "2024-01-05", 2.0), ("Y", "no date", 3.0)], "data_name STRING, date STRING, value DOUBLE")
    pages = spark.createDataFrame([("l", (("2", [{"period": "2024-01", "g": "A", "v": "4"}, {"period": "2024-01", "g": "date of B", "v": "5"}]),))], "data_link STRING, response STRUCT<response: STRUCT<total: STRING, data: ARRAY<MAP<STRING, STRING>>>>").selectExpr("data_link", "response.response AS response")
    built = build_panel(catalog, landed, pages)
    assert "ResolvedHint" not in built._jdf.queryExecution().analyzed().toString().replace("one_row_per_month", "")
    got = {r.series_id: r.value for r in built.collect()}
    assert got == {"x": 1.5, "a_load": 4.0, "dateofb_load": 5.0, "total_load": 4.0}
