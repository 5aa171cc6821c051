"""Hand-made rows for the cases that decide the meaning of an operator."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from monthloom import plans
from monthloom.functions import half_even, nan_to_null, natural_log, parse_mixed_date, series_stem
from monthloom.operators import clean, derive, filters, panel, stats, windows
from monthloom.plans import fuel, names
from tests.frames import by_key, day, months, observations
from tests.frames import panel as make_panel


def test_gap_month_appears_as_missing(spark):
    rows = observations(spark, [("a", "2024-01-05", 1.0), ("a", "2024-03-09", 2.0)])
    grid = panel.month_grid(panel.monthly_mean(rows))
    assert by_key(grid.drop("series_id"), "month_end") == {
        day("2024-01-31"): 1.0,
        day("2024-02-29"): None,
        day("2024-03-31"): 2.0,
    }


def test_grid_spans_the_whole_panel_for_every_series(spark):
    rows = make_panel(spark, [("a", "2024-01-31", 1), ("b", "2024-03-31", 2), ("b", "2024-05-31", 3)])
    grid = by_key(panel.month_grid(rows), "series_id", "month_end")
    assert len(grid) == 10
    assert {k for k, v in grid.items() if v is not None} == {
        ("a", day("2024-01-31")),
        ("b", day("2024-03-31")),
        ("b", day("2024-05-31")),
    }
    wider = panel.month_grid(rows, "2023-12-31", "2024-06-30")
    assert wider.count() == 14
    narrower = panel.month_grid(rows, "2024-02-29", "2024-04-30")
    assert by_key(narrower, "series_id", "month_end") == {
        ("b", day("2024-02-29")): None,
        ("b", day("2024-03-31")): 2.0,
        ("b", day("2024-04-30")): None,
    }


def test_month_last_skips_missing(spark):
    quotes = spark.createDataFrame(
        [("t", day("2024-01-05"), 1.0), ("t", day("2024-01-09"), None)], "ticker STRING, trade_date DATE, close DOUBLE"
    )
    assert by_key(panel.monthly_last(quotes), "series_id", "month_end") == {("t", day("2024-01-31")): 1.0}


def test_month_last_breaks_ties(spark):
    quotes = spark.createDataFrame(
        [("t", day("2024-01-05"), 1.0, 2), ("t", day("2024-01-05"), 7.0, 1)],
        "ticker STRING, trade_date DATE, close DOUBLE, seq INT",
    )
    last = panel.monthly_last(quotes, tie_break=["seq"])
    assert by_key(last, "series_id", "month_end") == {("t", day("2024-01-31")): 1.0}


def test_several_closes_of_a_day_follow_a_rule(spark):
    rows = [("t", "2024-01-05", 9.0), ("t", "2024-01-31", 1.0), ("t", "2024-01-31", 3.0), ("t", "2024-01-31", None), ("u", "2024-01-31", 2.0), ("u", "2024-01-31", 2.0)]
    schema = "ticker STRING, trade_date DATE, close DOUBLE"
    for order in (rows, rows[::-1]):
        quotes = spark.createDataFrame([(t, day(d), v) for t, d, v in order], schema).repartition(3)
        for ties, value in (("highest", 3.0), ("lowest", 1.0)):
            found = by_key(panel.monthly_last(quotes, ties=ties), "series_id", "month_end")
            assert found == {("t", day("2024-01-31")): value, ("u", day("2024-01-31")): 2.0}
        with pytest.raises(Exception, match="several values of t on 2024-01-31"):
            panel.monthly_last(quotes, ties="fail").collect()
        same = quotes.where("ticker = 'u'")
        assert by_key(panel.monthly_last(same, ties="fail"), "series_id", "month_end") == {("u", day("2024-01-31")): 2.0}
    plan = panel.monthly_last(quotes)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_several_index_values_of_a_month_fail_the_industrial_report(spark):
    rows = [(s, m, 5.0) for s in ("cpi_all", "all_output") for m in months("2016-01-31", 14)]
    once = make_panel(spark, rows)
    assert plans.industrial_report(once)["date_bounds"].count() == 1
    shown = plans.industrial_report(once, orders=["all_output"])["orders_by_category"]
    assert {r.value for r in shown.collect()} == {5.0}
    twice = make_panel(spark, [*rows, ("cpi_all", "2016-05-31", 6.0)])
    with pytest.raises(Exception, match="several values of cpi_all in a month"):
        plans.industrial_report(twice, orders=["all_output"])["orders_by_category"].collect()


def test_calendar_change_and_row_change_differ_after_a_gap(spark):
    ends = months("2020-01-31", 20)
    rows = make_panel(spark, [("a", m, i + 1) for i, m in enumerate(ends) if i != 3])
    calendar = by_key(windows.yoy_calendar(rows).select("month_end", "yoy"), "month_end")
    by_row = by_key(windows.yoy_rows(rows).select("month_end", "yoy"), "month_end")
    assert calendar[ends[15]] is None
    assert calendar[ends[16]] == pytest.approx(100 * (17 - 5) / 5)
    assert by_row[ends[15]] == pytest.approx(100 * (16 - 3) / 3)


def test_epoch_blanks_the_first_year_but_a_range_does_not(spark):
    ends = months("2020-01-31", 30)
    rows = make_panel(spark, [("a", m, i + 1) for i, m in enumerate(ends)])
    cut = by_key(windows.yoy_after_epoch(rows, "2021-01-01").select("month_end", "yoy"), "month_end")
    ranged = by_key(
        filters.date_range(windows.yoy_calendar(rows), "2021-01-01").select("month_end", "yoy"), "month_end"
    )
    assert cut[ends[12]] is None and ranged[ends[12]] == pytest.approx(1200.0)
    assert cut[ends[24]] == pytest.approx(ranged[ends[24]])


def test_zero_base_gives_no_change(spark):
    ends = months("2020-01-31", 13)
    rows = make_panel(spark, [("a", m, 0 if i == 0 else 5) for i, m in enumerate(ends)])
    assert by_key(windows.yoy_calendar(rows).select("month_end", "yoy"), "month_end")[ends[12]] is None


def _pair(spark, points):
    ends = months("2020-01-31", len(points))
    rows = [("x", m, p[0]) for m, p in zip(ends, points)] + [("y", m, p[1]) for m, p in zip(ends, points)]
    return make_panel(spark, rows)


@pytest.mark.parametrize(
    "points, n, r",
    [
        ([(1, 2), (1, 3)], 2, None),
        ([(1, 2)], 1, None),
        ([(0.1, 2), (0.1, 3), (0.1, 9), (None, 4), (0.7, None)], 3, None),
        ([(1, 2), (2, 4), (3, None), (None, 9), (4, 7)], 3, 0.997176464952738),
        ([(1, None), (None, 2)], 0, None),
    ],
)
def test_correlation_of_complete_pairs(spark, points, n, r):
    matrix = by_key(stats.correlation_matrix(_pair(spark, points)), "var_a", "var_b")
    found_n, found_r = matrix[("x", "y")]
    assert found_n == n
    if r is None:
        assert found_r is None or math.isnan(found_r)
        assert found_r is None
    else:
        assert found_r == pytest.approx(r, abs=1e-12)


def test_correlation_keeps_its_digits_far_from_zero(spark):
    points = [(1e9 + i, 1e9 + (i * 7) % 5) for i in range(20)] + [(None, 5.0), (-1e9, None)]
    xs, ys = zip(*points[:20])
    mx, my = sum(xs) / 20, sum(ys) / 20
    want = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / math.sqrt(
        sum((x - mx) ** 2 for x in xs) * sum((y - my) ** 2 for y in ys)
    )
    found = by_key(stats.correlation_matrix(_pair(spark, points)), "var_a", "var_b")[("x", "y")][1]
    assert found == pytest.approx(want, abs=1e-9)


def test_fit_skips_incomplete_pairs_and_trendline_does_not(spark):
    rows = _pair(spark, [(1, 3), (2, 5), (3, None), (4, 9), (10, None)])
    aligned = windows.align_pairs(rows, [("x", "y")])
    fit = stats.ols_fit(aligned).first()
    assert (fit["n"], fit["slope"], fit["intercept"]) == (3, pytest.approx(2.0), pytest.approx(1.0))
    line = {r["x"]: r["y"] for r in stats.ols_trendline(aligned).collect()}
    assert line == {1.0: pytest.approx(3.0), 10.0: pytest.approx(21.0)}


def test_constant_x_has_no_fit(spark):
    aligned = windows.align_pairs(_pair(spark, [(1, 2), (1, 3)]), [("x", "y")])
    fit = stats.ols_fit(aligned).first()
    assert fit["slope"] is None and fit["intercept"] is None


def test_pair_with_itself(spark):
    aligned = windows.align_pairs(_pair(spark, [(1, 2), (4, 3)]), [("x", "x")])
    assert {(r["x"], r["y"]) for r in aligned.collect()} == {(1.0, 1.0), (4.0, 4.0)}


def test_nan_is_missing(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),)], "v DOUBLE")
    assert rows.select(F.avg(nan_to_null(F.col("v")))).first()[0] == 1.0


def test_text_values_strict_and_lenient(spark):
    text = spark.createDataFrame([("s", "1.5"), ("s", "None"), ("s", None)], "series_id STRING, value STRING")
    cleaned = clean.cast_values(clean.clean_text_values(text, "value"))
    assert [r["value"] for r in cleaned.collect()] == [1.5, None, None]
    bad = spark.createDataFrame([("s", "1.5"), ("s", "abc"), ("s", None)], "series_id STRING, value STRING")
    with pytest.raises(Exception, match="not a double: abc"):
        clean.cast_values(bad).collect()
    assert [r["value"] for r in clean.cast_values(bad, strict=False).collect()] == [1.5, None, None]
    assert clean.count_rejects(bad).first()["rejected"] == 1


def test_repeated_dates_are_counted(spark):
    rows = observations(spark, [("a", "2024-01-05", 1), ("a", "2024-01-05", 2), ("a", "2024-01-06", 3)])
    assert by_key(clean.audit_dates(rows), "series_id") == {"a": (3, 2, 1)}


def test_mixed_dates(spark):
    text = spark.createDataFrame([("2024-01",), ("2024-01-05",), ("2024",), (None,)], "t STRING")
    assert [r[0] for r in text.select(parse_mixed_date(F.col("t"))).collect()] == [
        dt.date(2024, 1, 1),
        dt.date(2024, 1, 5),
        dt.date(2024, 1, 1),
        None,
    ]
    bad = spark.createDataFrame([("soon",)], "t STRING")
    with pytest.raises(Exception, match="not a date: soon"):
        bad.select(parse_mixed_date(F.col("t"))).collect()
    assert bad.select(parse_mixed_date(F.col("t"), strict=False)).first()[0] is None


def test_duplicate_pivot_cells_are_averaged(spark):
    payload = spark.createDataFrame(
        [("d1", "g 1", 1.0), ("d1", "g 1", 3.0), ("d2", "H", 5.0)], "date STRING, grp STRING, value DOUBLE"
    )
    wide = by_key(panel.pivot_mean(payload, ["g 1", "H"], "_x"), "date")
    assert wide == {"d1": (2.0, None), "d2": (None, 5.0)}
    assert panel.pivot_mean(payload, ["g 1", "H"], "_x").columns == ["date", "g1_x", "h_x"]
    means = panel.group_means(payload)
    assert by_key(panel.group_totals(means), "date") == {"d1": 2.0, "d2": 5.0}
    assert by_key(panel.group_totals(means, exclude_groups=["H"]), "date") == {"d1": 2.0}
    dated = means.unionByName(spark.createDataFrame([("d1", "As of Date", 7.0, 1), ("d1", "da te", 9.0, 1)], "date STRING, grp STRING, value DOUBLE, rows BIGINT"))
    assert by_key(panel.group_totals(dated), "date") == {"d1": 2.0, "d2": 5.0}
    assert panel.group_totals(dated, suffix="_updated").count() == 0


def test_total_of_missing_values_is_zero(spark):
    means = spark.createDataFrame([("d1", "g", None)], "date STRING, grp STRING, value DOUBLE")
    assert by_key(panel.group_totals(means), "date") == {"d1": 0.0}


def test_group_labels(spark):
    labels = spark.createDataFrame([("PADD 1A",), ("U.S.",)], "l STRING")
    found = [r[0] for r in labels.select(series_stem(F.col("l"), "_gasprice")).collect()]
    assert found == ["padd1a_gasprice", "u.s._gasprice"]


def test_half_even_rounding(spark):
    values = spark.createDataFrame([(0.125,), (0.135,), (2.675,), (-0.125,)], "v DOUBLE")
    import numpy as np

    found = [r[0] for r in values.select(half_even(F.col("v"), 2)).collect()]
    assert found == list(np.round([0.125, 0.135, 2.675, -0.125], 2))


def test_logarithm_outside_its_domain(spark):
    values = spark.createDataFrame([(0.0,), (-1.0,), (1.0,)], "v DOUBLE")
    assert [r[0] for r in values.select(natural_log(F.col("v"))).collect()] == [None, None, 0.0]


def test_quarterly_series_never_fill_the_frame(spark):
    rows = make_panel(spark, [("q", m, i) for i, m in enumerate(months("2018-03-31", 60)) if i % 3 == 0])
    assert windows.rolling_mean(rows).where("rolling_mean IS NOT NULL").count() == 0


def test_empty_range(spark):
    rows = windows.yoy_calendar(make_panel(spark, [("r_price", "2024-01-31", 3)]))
    nothing = filters.date_range(rows, "2030-01-01")
    regions = spark.createDataFrame([("R", "r_price")], "region STRING, series_id STRING")
    latest = derive.latest_region(nothing, regions).first()
    assert (latest["price"], latest["yoy"], latest["month_end"]) == (0.0, 0.0, None)
    card = derive.with_cards(derive.latest_region(nothing, regions)).first()
    assert (card["price_card"], card["change_card"], card["marker_text"]) == (" $0", " 0%", "R: $0.00")
    assert filters.latest_values(nothing).count() == 0


def test_missing_change_on_a_card(spark):
    rows = windows.yoy_calendar(make_panel(spark, [("r_price", "2024-01-31", 3.25)]))
    regions = spark.createDataFrame([("R", "r_price")], "region STRING, series_id STRING")
    card = derive.with_cards(derive.latest_region(rows, regions)).first()
    assert (card["price_card"], card["change_card"], card["marker_text"]) == (" $3.25", " nan%", "R: $3.25")


def test_rebase_needs_its_base_month(spark):
    rows = make_panel(spark, [("a", "2016-01-31", 10), ("a", "2016-02-29", 10)])
    index = make_panel(spark, [("i", "2016-01-31", 100), ("i", "2016-02-29", 110)])
    up = by_key(derive.cpi_rebase(rows, index, "2016-01-31").select("month_end", "value"), "month_end")
    assert up == {day("2016-01-31"): 10.0, day("2016-02-29"): pytest.approx(11.0)}
    down = by_key(
        derive.cpi_rebase(rows, index, "2016-01-31", mode="deflate").select("month_end", "value"), "month_end"
    )
    assert down[day("2016-02-29")] == pytest.approx(10 / 1.1)
    with pytest.raises(Exception, match="exactly one index value"):
        derive.cpi_rebase(rows, index, "2015-01-31").collect()
    with pytest.raises(ValueError):
        derive.cpi_rebase(rows, index, "2016-01-31", mode="sideways")


def test_rebase_refuses_two_index_values_for_a_month(spark):
    rows = make_panel(spark, [("a", "2016-02-29", 10)])
    index = make_panel(spark, [("i", "2016-01-31", 100), ("i", "2016-02-29", 110), ("j", "2016-02-29", 120)])
    with pytest.raises(Exception, match="several index values"):
        derive.cpi_rebase(rows, index, "2016-01-31").collect()


def test_rebase_of_some_series_leaves_the_rest(spark):
    rows = make_panel(spark, [("a", "2016-02-29", 10), ("b", "2016-02-29", 10)])
    index = make_panel(spark, [("i", "2016-01-31", 100), ("i", "2016-02-29", 110)])
    found = derive.cpi_rebase(rows, index, "2016-01-31", series=["a"])
    assert by_key(found.select("series_id", "value"), "series_id") == {"a": pytest.approx(11.0), "b": 10.0}


def test_choosing_nothing_gives_nothing(spark):
    rows = make_panel(spark, [("a", "2016-02-29", 10)])
    assert filters.keep_series(rows, []).count() == 0
    assert clean.select_renamed(rows, {}).count() == 0
    assert clean.rename_series(rows, {}).first()["series_id"] == "a"


def test_drill_levels(spark):
    rows = make_panel(
        spark, [("us_gasprice", "2024-01-31", 3), ("padd1a_gasprice", "2024-01-31", 4), ("other", "2024-01-31", 5)]
    )
    assert {r["label"] for r in fuel.drill(rows, "national").collect()} == {"USA"}
    assert {r["label"] for r in fuel.drill(rows, "region").collect()} == {"PADD 1a"}
    assert fuel.drill(rows, "region", "PADD 1a").first()["value"] == 4.0
    assert fuel.drill(rows, "region", "PADD 9").count() == 0


def test_last_rows_count_missing_values(spark):
    rows = make_panel(spark, [("a", m, None if i == 4 else i) for i, m in enumerate(months("2020-01-31", 6))])
    assert [r["value"] for r in filters.last_rows(rows, 3).orderBy("month_end").collect()] == [3.0, None, 5.0]


def test_whole_months_is_the_same_range_on_days(spark):
    rows = observations(spark, [("a", d, 1) for d in ("2024-01-31", "2024-02-01", "2024-02-29", "2024-03-01", "2024-03-31")])
    for start, end in (("2024-02-29", "2024-03-31"), ("2024-02-10", "2024-03-30"), (None, "2024-02-29"), ("2024-03-31", None)):
        by_day = panel.monthly_mean(rows, start, end)
        by_month = filters.date_range(panel.monthly_mean(rows), start, end)
        assert sorted(map(tuple, by_day.collect())) == sorted(map(tuple, by_month.collect())), (start, end)


def test_region_dimension_has_fifty_states(spark):
    states = derive.region_states(spark, names.FUEL_REGION_STATES)
    assert states.count() == 50 and states.select("region").distinct().count() == 7


def test_inner_panels_on_shared_span(spark):
    left = make_panel(spark, [("a", m, 1) for m in months("2024-01-31", 4)])
    right = make_panel(spark, [("b", "2024-03-31", 1), ("b", "2024-06-30", 1)])
    assert by_key(panel.inner_panels(left, right), "series_id", "month_end") == {
        ("a", day("2024-03-31")): 1.0,
        ("a", day("2024-04-30")): 1.0,
        ("b", day("2024-03-31")): 1.0,
    }
    apart = make_panel(spark, [("c", "2030-03-31", 1)])
    assert panel.inner_panels(left, apart).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-01-05", "2024-01-05"), ("2024-1-5", "2024-01-05"), ("2024-02", "2024-02-01"), ("2024", "2024-01-01"), (" 2024-01-05 ", "2024-01-05"),
        ("20240105", "2024-01-05"), ("2024-Q1", "2024-01-01"), ("2024Q4", "2024-10-01"), ("2024-01-05T00:00:00", "2024-01-05"), ("2024-01-05 12:30:00.5Z", "2024-01-05"),
        ("202401", None), ("2024-01-05 garbage", None), ("2024-01-05Tjunk", None), ("01/05/2024", None), ("2024-13", None), ("2024-Q5", None), ("20241305", None), ("", None), ("12024", None),
    ],
)
def test_forms_of_dates(spark, text, want):
    frame = spark.createDataFrame([(text,)], "t STRING")
    lenient = frame.select(parse_mixed_date(F.col("t"), strict=False).alias("d")).first()["d"]
    assert (lenient and lenient.isoformat()) == want
    if want is None:
        with pytest.raises(Exception, match="not a date"):
            frame.select(parse_mixed_date(F.col("t"))).collect()


@pytest.mark.parametrize("text, want", [("1.5", 1.5), ("-2", -2.0), (" 3 ", 3.0), (".5", 0.5), ("1e3", 1000.0), ("1.", 1.0), ("NaN", None)])
def test_forms_of_numbers(spark, text, want):
    frame = spark.createDataFrame([(text,)], "value STRING")
    assert clean.cast_values(frame).first()["value"] == want


@pytest.mark.parametrize("text", ["1.5d", "1f", "Infinity", "-inf", "1e999", "0x10", "1,5", "", "--1"])
def test_texts_that_are_no_numbers(spark, text):
    frame = spark.createDataFrame([("s", text)], "series_id STRING, value STRING")
    assert clean.cast_values(frame, strict=False).first()["value"] is None
    assert clean.count_rejects(frame).first()["rejected"] == 1
    with pytest.raises(Exception, match="not a double"):
        clean.cast_values(frame).collect()


def test_several_values_in_a_month_fail(spark):
    rows = [("a", day("2024-01-31"), 1.0), ("a", day("2024-01-31"), 2.0), ("b", day("2024-01-31"), 3.0)]
    twice = spark.createDataFrame(rows, "series_id STRING, month_end DATE, value DOUBLE")
    for build in (
        lambda: panel.widen(twice, ["a", "b"]),
        lambda: windows.align_pairs(twice, [("a", "b")]),
        lambda: stats.correlation_matrix(twice),
    ):
        with pytest.raises(Exception, match="several values"):
            build().collect()


def test_matrix_of_reports_is_several_tasks(spark):
    rows = [(f"s{i}", day(f"20{j:02d}-01-31"), float((i * 7 + j * j) % 13)) for i in range(76) for j in range(10)]
    found = stats.correlation_matrix(spark.createDataFrame(rows, "series_id STRING, month_end DATE, value DOUBLE"), [f"s{i}" for i in range(76)])
    assert found.count() == 76 * 77 // 2
    wide = stats.correlation_matrix(spark.createDataFrame(rows, "series_id STRING, month_end DATE, value DOUBLE"), [f"s{i}" for i in range(76)], block=1000)
    left, right = ({(r.var_a, r.var_b): (r.n, r.r) for r in f.collect()} for f in (found, wide))
    assert left.keys() == right.keys()
    assert all(left[k][0] == right[k][0] and (left[k][1] == pytest.approx(right[k][1], abs=1e-12)) for k in left)
