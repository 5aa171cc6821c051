"""From files to the panel, to reports and back from disk."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from monthloom import job, plans
from monthloom.operators.panel import monthly_mean
from monthloom.plans import names
from monthloom.sinks import newest_month, panel_years, read_output, read_panel, write_panel, write_report
from monthloom.sources import (
    audit_pages,
    catalog_from_lines,
    catalog_series,
    distinct_pages,
    grouped_suffixes,
    read_catalog,
    read_landed_series,
    read_pages,
    read_quotes,
    unrouted,
)
from monthloom.streaming import land_new_files, stream_pages, stream_series
from tests.frames import by_key, day, months

CATALOG = """source,data_name,secondary_name,data_link,paginated,column_to_groupby,value_name
fred,CPIAUCSL,cpi_all,,no,,
fred,POP,population,,no,,
eia_api,,oil_stock,link-a,no,,
eia_api,,_gasprice,link-b,yes,area-name,price
eia_api,,_crude_oil_prod,link-c,yes,area-name,value
elsewhere,X,ignored,,no,,
"""


def write_page(folder, link, number, total, records):
    target = folder / f"data_link={link}"
    target.mkdir(parents=True, exist_ok=True)
    body = {"response": {"total": total, "data": records}, "apiVersion": "2"}
    (target / f"page{number}.json").write_text(json.dumps(body, indent=2))


@pytest.fixture
def landing(tmp_path):
    (tmp_path / "catalog.csv").write_text(CATALOG)
    pages = tmp_path / "pages"
    write_page(pages, "link-a", 0, "2", [{"period": "2024-01", "value": "4"}, {"period": "2024-02", "value": None}])
    area = "area-name"
    write_page(
        pages,
        "link-b",
        0,
        3,
        [
            {"period": "2024-01-08", "price": "3.5", area: "U.S."},
            {"period": "2024-01-15", "price": "3.7", area: "U.S."},
        ],
    )
    write_page(pages, "link-b", 1, 3, [{"period": "2024-01-08", "price": "None", area: "PADD 1A"}])
    write_page(
        pages,
        "link-c",
        0,
        "5",
        [
            {"period": "2024-01", "value": "10", area: "PADD 1", "units": "MBBL"},
            {"period": "2024-01", "value": 12, area: "PADD 1"},
            {"period": "2024-01", "value": "5", area: "PADD 2"},
            {"period": "2024-02", "value": "7", area: "PADD 2"},
        ],
    )
    landed = tmp_path / "landed"
    landed.mkdir()
    cpi = [("CPIAUCSL", m.isoformat(), 100.0 + i) for i, m in enumerate(months("2023-01-31", 14))]
    other = [("POP", "2024-01-01", 7.0), ("POP", "2024-01-31", np.nan), ("UNKNOWN", "2024-01-31", 1.0)]
    pd.DataFrame(cpi + other, columns=["data_name", "date", "value"]).to_parquet(landed / "rows.parquet")
    return tmp_path


def test_catalog(spark, landing):
    catalog = read_catalog(spark, str(landing / "catalog.csv"))
    assert catalog.count() == 6 and len(catalog.columns) == 7
    assert [r["secondary_name"] for r in unrouted(catalog).collect()] == ["ignored"]
    assert catalog.where("column_to_groupby IS NULL").count() == 4
    assert sorted(r[0] for r in grouped_suffixes(catalog).collect()) == ["_crude_oil_prod", "_gasprice"]
    lines = spark.createDataFrame([(t,) for t in CATALOG.splitlines()[1:]], "line STRING")
    assert sorted(map(str, catalog_from_lines(lines).collect())) == sorted(map(str, catalog.collect()))


def test_page_audit_flags_a_short_payload(spark, landing):
    audit = by_key(audit_pages(read_pages(spark, str(landing / "pages")), "data_link"), "data_link")
    assert audit == {"link-a": (1, 0, 2, 2, 0, True), "link-b": (2, 0, 3, 3, 0, True), "link-c": (1, 0, 4, 5, 0, False)}


def test_page_audit_tells_repeated_and_surplus_pages(spark, landing):
    pages, row = landing / "pages", {"period": "2024-01", "value": "1"}
    for number, records in ((0, [row]), (1, [row]), (2, [])):  # one page of two, twice, and an empty one
        write_page(pages, "twice", number, "2", records)
    write_page(pages, "surplus", 0, "1", [row, {"period": "2024-02", "value": "1"}])
    write_page(pages, "empty", 0, "0", [])
    write_page(pages, "empty", 1, "0", [])
    audit = by_key(audit_pages(read_pages(spark, str(pages)), "data_link"), "data_link")
    assert audit["twice"] == (3, 1, 1, 2, 0, False)
    assert audit["surplus"] == (1, 0, 2, 1, 1, False)
    assert audit["empty"] == (2, 0, 0, 0, 0, True)
    kept = distinct_pages(read_pages(spark, str(pages)), "data_link").groupBy("data_link").count()
    assert by_key(kept, "data_link") == {"link-a": 1, "link-b": 2, "link-c": 1, "twice": 2, "surplus": 1, "empty": 2}


def test_panel_job_counts_a_page_that_landed_twice_once(spark, landing):
    write_page(landing / "pages", "link-c", 1, "5", [{"period": "2024-03", "value": "7", "area-name": "PADD 1"}])
    job.build(spark, panel_options(landing))
    first = by_key(read_panel(spark, str(landing / "panel")), "series_id", "month_end")
    for name in ("page0", "page1"):
        folder = landing / "pages" / "data_link=link-c"
        (folder / f"again-{name}.json").write_text((folder / f"{name}.json").read_text())
    job.build(spark, panel_options(landing))
    assert by_key(read_panel(spark, str(landing / "panel")), "series_id", "month_end") == first


EXPECTED = {
    ("oil_stock", day("2024-01-31")): 4.0,
    ("oil_stock", day("2024-02-29")): None,
    ("us_gasprice", day("2024-01-31")): pytest.approx(3.6),
    ("padd1_crude_oil_prod", day("2024-01-31")): 11.0,
    ("padd2_crude_oil_prod", day("2024-01-31")): 5.0,
    ("padd2_crude_oil_prod", day("2024-02-29")): 7.0,
    ("total_crude_oil_prod", day("2024-01-31")): 16.0,
    ("total_crude_oil_prod", day("2024-02-29")): 7.0,
    ("population", day("2024-01-31")): 7.0,
    ("cpi_all", day("2024-01-31")): 112.0,
    ("inflation_rate", day("2023-12-31")): None,
    ("inflation_rate", day("2024-01-31")): pytest.approx(12.0),
}


def built(spark, landing):
    return plans.build_panel(
        read_catalog(spark, str(landing / "catalog.csv")),
        read_landed_series(spark, str(landing / "landed")),
        read_pages(spark, str(landing / "pages")),
    )


def test_panel_from_files(spark, landing):
    found = by_key(built(spark, landing), "series_id", "month_end")
    assert {k: found[k] for k in EXPECTED} == EXPECTED
    assert len(found) == 14 + 14 + 9


def test_groups_left_out_of_totals(spark, landing):
    rows = plans.panel.paged_observations(
        read_pages(spark, str(landing / "pages")), read_catalog(spark, str(landing / "catalog.csv")), ["PADD 1"]
    )
    totals = by_key(rows.where("series_id = 'total_crude_oil_prod'").select("obs_date", "total"), "obs_date")
    assert totals == {day("2024-01-01"): 5.0, day("2024-02-01"): 7.0}


def test_bad_number_text_fails(spark, landing):
    write_page(landing / "pages", "link-a", 1, "3", [{"period": "2024-03", "value": "n/a"}])
    with pytest.raises(Exception, match="not a double: n/a"):
        built(spark, landing).collect()


@pytest.mark.parametrize("fmt", ["csv", "json", "orc", "parquet"])
def test_landed_formats(spark, tmp_path, fmt):
    rows = spark.createDataFrame(
        [("CPIAUCSL", "2024-01-31", 1.5), ("CPIAUCSL", "2024-02-29", None)], "data_name STRING, date STRING, value DOUBLE"
    )
    path = str(tmp_path / fmt)
    writer = rows.write.option("header", True) if fmt == "csv" else rows.write
    writer.format(fmt).save(path)
    catalog = catalog_from_lines(spark.createDataFrame([("fred,CPIAUCSL,cpi_all,,no,,",)], "line STRING"))
    found = catalog_series(read_landed_series(spark, path, fmt), catalog)
    assert by_key(found, "series_id", "obs_date") == {
        ("cpi_all", day("2024-01-31")): 1.5,
        ("cpi_all", day("2024-02-29")): None,
    }


def test_panel_on_disk(spark, landing, tmp_path):
    panel = monthly_mean(
        spark.createDataFrame(
            [("a", day("2023-12-05"), 1.0), ("a", day("2024-01-05"), 2.0)], "series_id STRING, obs_date DATE, value DOUBLE"
        )
    )
    path = str(tmp_path / "panel")
    write_panel(panel, path)
    assert {p.name for p in (tmp_path / "panel").iterdir() if p.is_dir()} == {"year=2023", "year=2024"}
    assert by_key(read_panel(spark, path), "series_id", "month_end") == by_key(panel, "series_id", "month_end")
    assert [r["value"] for r in read_panel(spark, path, 2024, 2024).collect()] == [2.0]


ALL_SERIES = dict.fromkeys(
    (
        *names.INDUSTRIAL_PLAIN,
        *names.PRICE_ADJUSTED,
        *names.OIL_SERIES,
        *names.CPI_SERIES,
        *names.PRICE_SERIES,
        *names.FUEL_SERIES,
        *names.EMPLOYEE_SERIES,
        *names.LABOUR_RATE_SERIES,
        *names.MACRO_VARIABLES,
        *names.CORE_VARIABLES,
        *names.OIL_EXPORT_LINES,
    )
)


@pytest.fixture(scope="module")
def economy():
    """All series of the reports over real dates, as a wide pandas panel."""
    rng = np.random.default_rng(8)
    index = pd.date_range("1990-01-31", "2024-12-31", freq="ME")
    values = 100 + rng.normal(size=(len(index), len(ALL_SERIES))).cumsum(axis=0) * 0.5
    return pd.DataFrame(values, index=index, columns=list(ALL_SERIES))


@pytest.fixture(scope="module")
def report_files(spark, economy, tmp_path_factory):
    """Every report, run by the job from a written panel."""
    folder = tmp_path_factory.mktemp("job")
    rows = economy.rename_axis("month_end").reset_index().melt("month_end", var_name="series_id")
    rows["month_end"] = rows["month_end"].dt.date
    frame = spark.createDataFrame(rows[["series_id", "month_end", "value"]], "series_id STRING, month_end DATE, value DOUBLE")
    write_panel(frame, str(folder / "panel"))
    stamps = pd.date_range("2000-01-01", "2024-12-31", freq="7D")
    rng = np.random.default_rng(9)
    quotes = [
        (t, s.date(), float(v)) for t in names.TICKER_LABELS for s, v in zip(stamps, 50 + rng.random(len(stamps)))
    ]
    spark.createDataFrame(quotes, "ticker STRING, trade_date DATE, close DOUBLE").write.parquet(str(folder / "quotes"))
    job.build_quotes(spark, job.parse(["quotes", "--quotes", str(folder / "quotes"), "--out", str(folder / "monthly")]))
    options = job.parse(
        ["reports", "--panel", str(folder / "panel"), "--quotes", str(folder / "monthly"), "--out", str(folder / "out")]
        + ["--start", "2010-01-31", "--end", "2020-12-31", "--pair", "SP500", "Oil Price"]
    )
    job.run_reports(spark, options)
    return str(folder / "out"), quotes


def change(series):
    return 100 * (series - series.shift(12)) / series.shift(12)


def test_reports_write_their_outputs(spark, report_files):
    path, _ = report_files
    for report, output, columns in (
        ("oil", "figures", ["figure", "series_id", "month_end", "value", "yoy"]),
        ("oil", "latest_by_region", ["area", "production"]),
        ("price", "inflation", ["month_end", "value"]),
        ("employment", "change_bounds", ["series_id", "low", "high"]),
        ("industrial", "housing_by_region", ["series_id", "label", "month_end", "value"]),
        ("correlation", "pair_fit", ["var_a", "var_b", "n", "slope", "intercept"]),
    ):
        assert read_output(spark, path, report, output).columns == columns
        assert read_output(spark, path, report, output).count() > 0


def test_oil_report_against_pandas(spark, report_files, economy):
    path, _ = report_files
    want = change(economy["oil_price"]).loc["2010-01-31":"2020-12-31"]
    rows = read_output(spark, path, "oil", "figures").where("figure = 'price'").orderBy("month_end").toPandas()
    np.testing.assert_allclose(rows["yoy"], want)
    matrix = by_key(read_output(spark, path, "oil", "correlation"), "var_a", "var_b")
    shown = pd.DataFrame({"a": economy["oil_employees"], "b": change(economy["oil_employees"])}).loc["2010-01-31":"2020-12-31"]
    assert matrix[("employees", "employees YoY")] == (132, pytest.approx(shown.corr().loc["a", "b"]))
    assert len(matrix) == 55


def test_industrial_report_against_pandas(spark, report_files, economy):
    path, _ = report_files
    cut = economy.loc["2005-01-01":]
    rebased = cut["all_output"] * (cut["cpi_all"] / economy["cpi_all"].loc["2016-01-31"])
    rows = read_output(spark, path, "industrial", "output_total").orderBy("month_end").toPandas()
    np.testing.assert_allclose(rows["value"], rebased.loc["2010-01-31":"2020-12-31"])
    np.testing.assert_allclose(rows["yoy"], change(rebased).loc["2010-01-31":"2020-12-31"])


def test_price_report_rounds_before_the_change(spark, report_files, economy):
    path, _ = report_files
    dollars = np.round(economy["coffee_price"].loc["1995-01-01":] / 100, 2)
    rows = read_output(spark, path, "price", "figures").where("figure = 'coffee_price'").orderBy("month_end").toPandas()
    np.testing.assert_allclose(rows["yoy"], change(dollars).loc["2010-01-31":"2020-12-31"])


def test_fuel_report_against_pandas(spark, report_files, economy):
    path, _ = report_files
    rows = by_key(read_output(spark, path, "fuel", "latest_by_state").select("state", "price", "yoy"), "state")
    assert len(rows) == 50
    series = economy["padd3_gasprice"]
    last = series.loc["2020-12-31"], np.round(change(series).loc["2020-12-31"], 2)
    assert rows["TX"] == (pytest.approx(last[0]), pytest.approx(last[1]))


def test_correlation_report_against_pandas(spark, report_files, economy):
    path, quotes = report_files
    frame = pd.DataFrame(quotes, columns=["ticker", "date", "close"])
    frame["date"] = pd.to_datetime(frame["date"])
    market = frame[frame["ticker"] == "^GSPC"].set_index("date")["close"].resample("ME").last()
    both = pd.DataFrame({"x": market, "y": economy["oil_price"]}).loc["2010-01-31":"2020-12-31"]
    matrix = by_key(read_output(spark, path, "correlation", "correlation"), "var_a", "var_b")
    assert len(matrix) == 76 * 77 // 2
    assert matrix[("Oil Price", "SP500")] == (132, pytest.approx(both.corr().loc["x", "y"]))
    rolling = read_output(spark, path, "correlation", "pair_rolling").orderBy("month_end").toPandas()
    np.testing.assert_allclose(rolling["rolling_corr"].astype(float), both["x"].rolling(12).corr(both["y"]), atol=1e-9)
    spread = read_output(spark, path, "correlation", "pair_corr_range").first()["half_range"]
    assert spread == pytest.approx(both["x"].rolling(12).corr(both["y"]).abs().max())


def test_recent_report_against_pandas(spark, report_files, economy):
    path, _ = report_files
    tail = change(economy["total_crude_oil_prod"]).iloc[-37:].dropna().to_numpy()
    rows = read_output(spark, path, "recent", "oil_change_segments").orderBy("from_month").toPandas()
    middle = (tail[:-1] + tail[1:]) / 2
    np.testing.assert_allclose(rows["midpoint"], middle)
    np.testing.assert_allclose(rows["position"], (middle + 6) / (tail.max() + 6))
    matrix = by_key(read_output(spark, path, "recent", "correlation"), "var_a", "var_b")
    assert matrix[("egg price", "oil price")][1] == np.round(economy["egg_price"].corr(economy["oil_price"]), 2)


def panel_options(landing, *more):
    return job.parse(
        ["panel", "--catalog", str(landing / "catalog.csv"), "--landed", str(landing / "landed")]
        + ["--pages", str(landing / "pages"), "--out", str(landing / "panel"), *more]
    )


def test_panel_job_stops_at_a_short_payload(spark, landing):
    with pytest.raises(SystemExit, match=r"link-c \(4 of 5\)"):
        job.build(spark, panel_options(landing))
    assert not (landing / "panel").exists()
    assert [r.secondary_name for r in spark.read.parquet(str(landing / "panel-unrouted")).collect()] == ["ignored"]
    assert spark.read.parquet(str(landing / "panel-audit")).where("is_complete").count() == 2


def test_panel_job(spark, landing):
    job.build(spark, panel_options(landing, "--allow-incomplete"))
    found = by_key(read_panel(spark, str(landing / "panel")), "series_id", "month_end")
    assert {k: found[k] for k in EXPECTED} == EXPECTED


def test_panel_job_on_complete_and_on_landed_pages(spark, landing):
    write_page(landing / "pages", "link-c", 1, "5", [{"period": "2024-03", "value": "7", "area-name": "PADD 1"}])
    job.build(spark, panel_options(landing))
    first = by_key(read_panel(spark, str(landing / "panel")), "series_id", "month_end")
    assert first[("total_crude_oil_prod", day("2024-03-31"))] == 7.0
    query = land_new_files(stream_pages(spark, str(landing / "pages")), str(landing / "pages") + "-t", str(landing / "c"))
    query.awaitTermination()
    options = panel_options(landing, "--pages-format", "parquet")
    options.pages += "-t"
    job.build(spark, options)
    assert by_key(read_panel(spark, str(landing / "panel")), "series_id", "month_end") == first


def test_reports_skip_years_before_their_epoch(spark, report_files, capfd):
    path, _ = report_files
    panel = plans.panel_of("industrial", functools.partial(read_panel, spark, path.replace("/out", "/panel")), 1990)
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and ">= 2005" in plan


def partitions_read(spark, frame) -> set[int]:
    """Years of the panel files that a frame's scans are left with."""
    years = set()
    for scan in re.findall(r"PartitionFilters: \[([^\]]*)\]", frame._jdf.queryExecution().executedPlan().toString()):
        low = max([int(y) for y in re.findall(r">= (\d{4})", scan)] + [int(y) for y in re.findall(r"year#\d+ = (\d{4})", scan)], default=1990)
        high = min([int(y) for y in re.findall(r"<= (\d{4})", scan)] + [int(y) for y in re.findall(r"year#\d+ = (\d{4})", scan)], default=2024)
        years |= set(range(low, high + 1))
    return years


@pytest.mark.parametrize(
    ("report", "start", "end", "years"),
    [
        ("oil", "2010-01-31", "2012-12-31", range(2009, 2013)),
        ("fuel", "2010-05-31", None, range(2009, 2025)),
        ("price", "2010-01-31", "2012-12-31", range(2009, 2013)),
        ("price", "1995-02-28", None, range(1995, 2025)),
        ("employment", None, "1999-06-30", range(1990, 2000)),
        ("industrial", "2010-01-31", "2020-12-31", range(2009, 2021)),
        ("industrial", "2010-01-31", "2012-12-31", [*range(2009, 2013), 2016]),
        ("industrial", "2018-01-31", None, [2016, *range(2017, 2025)]),
    ],
)
def test_a_date_range_skips_years_and_changes_nothing(spark, report_files, report, start, end, years):
    path = report_files[0].replace("/out", "/panel")
    read = functools.partial(read_panel, spark, path)
    panel = plans.panel_of(report, read, panel_years(spark, path)[0], start, end)
    assert partitions_read(spark, panel) == set(years)
    make = {"oil": plans.oil_report, "fuel": plans.fuel_report, "price": plans.price_report}
    make |= {"employment": plans.employment_report, "industrial": plans.industrial_report}
    pruned, whole = make[report](panel, start, end, history=read()), make[report](read(), start, end)
    for name in ("date_bounds", "figures", "change_bounds", "latest_by_region", "latest_by_state", "national_history", "output_by_category"):
        if name in whole:
            assert sorted(map(str, pruned[name].collect())) == sorted(map(str, whole[name].collect())), name
            assert pruned[name].count() > 0 or name == "change_bounds", name


def test_rows_count_back_over_incomplete_months(spark, tmp_path):
    """Months without all series do not count, so the twelfth complete month may be many years back."""
    ends = months("2000-01-31", 144)
    rows = [(s, m, float(i + 1)) for i, m in enumerate(ends) for s in names.OIL_SERIES if not (24 <= i < 120 and s == names.OIL_SERIES[0] and i % 24)]
    write_panel(spark.createDataFrame(rows, "series_id STRING, month_end DATE, value DOUBLE"), str(tmp_path / "p"))
    read = functools.partial(read_panel, spark, str(tmp_path / "p"))
    for start in ("2010-03-31", "2009-01-31", "2000-06-30", "2001-06-15", "2002-01-01"):
        panel = plans.panel_of("oil", read, 2000, start)
        got, want = (plans.oil_report(p, start)["figures"] for p in (panel, read()))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert plans.years_of("oil", read, 2000, "2010-03-31") == (2001, None)
    assert plans.years_of("oil", read, 2000, "2000-06-30") == (None, None)


def test_recent_report_starts_from_one_written_frame(spark, report_files):
    path = report_files[0].replace("/out", "/panel")
    panel, frames = read_panel(spark, path), []

    def share(frame):
        frames.append(frame)
        return spark.createDataFrame(frame.collect(), frame.schema)

    newest = newest_month(spark, path)
    assert newest == day("2024-12-31")
    shared, plain = plans.recent_report(panel, newest=newest, share=share), plans.recent_report(panel)
    assert len(shared) == 6
    for name in plain:
        assert sorted(map(str, shared[name].collect())) == sorted(map(str, plain[name].collect())), name
        assert "FileScan" not in shared[name]._jdf.queryExecution().executedPlan().toString(), name
    assert len(frames) == 1  # the panel is read for it and for nothing else


def test_newest_month_comes_from_the_last_years_partition(spark, report_files, monkeypatch):
    path = report_files[0].replace("/out", "/panel")
    read = []
    monkeypatch.setattr("monthloom.sinks.tables.read_panel", lambda s, p, a, b: read.append((a, b)) or read_panel(s, p, a, b))
    assert newest_month(spark, path) == day("2024-12-31") and read == [(2024, 2024)]


def test_a_failed_report_leaves_the_old_one(spark, tmp_path):
    out = str(tmp_path / "out")
    good, other = spark.range(3), spark.range(5)
    write_report({"a": good, "b": good}, out, "oil")
    bad = spark.range(1).select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    with pytest.raises(Exception, match="no"):
        write_report({"a": other, "c": bad}, out, "oil")
    assert read_output(spark, out, "oil", "a").count() == 3 and read_output(spark, out, "oil", "b").count() == 3
    write_report({"a": other}, out, "oil")
    assert read_output(spark, out, "oil", "a").count() == 5
    assert sorted(p.name for p in (tmp_path / "out" / "report=oil").iterdir()) == ["output=a"]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["report=oil"]


def test_one_region_of_the_fuel_report(spark, landing):
    panel = spark.createDataFrame([(s, day("2024-01-31"), 3.0) for s in names.FUEL_SERIES], "series_id STRING, month_end DATE, value DOUBLE")
    region = next(iter(names.FUEL_REGIONS))
    options = job.parse(["reports", "--panel", "p", "--out", str(landing / "o"), "--region", region])
    rows = job.outputs_of("fuel", panel, options, None, lambda frame: frame)["region_history"].collect()
    assert {r.series_id for r in rows} == {names.FUEL_REGIONS[region]}


def test_quotes_files(spark, tmp_path):
    rows = spark.createDataFrame([("t", day("2024-01-05"), float("nan"))], "ticker STRING, trade_date DATE, close DOUBLE")
    rows.write.option("header", True).csv(str(tmp_path / "q"))
    assert read_quotes(spark, str(tmp_path / "q"), "csv").first()["close"] is None


def test_streams_land_each_file_once(spark, landing):
    out, checkpoint = str(landing / "table"), str(landing / "checkpoint")

    def run():
        query = land_new_files(stream_pages(spark, str(landing / "pages")), out, checkpoint)
        query.awaitTermination()
        return audit_pages(spark.read.parquet(out), "data_link").agg(F.sum("rows_held")).first()[0]

    assert run() == 9
    assert run() == 9
    write_page(landing / "pages", "link-c", 1, "5", [{"period": "2024-02", "value": "7", "area-name": "PADD 1"}])
    assert run() == 10
    query = land_new_files(stream_series(spark, str(landing / "landed")), out + "-s", checkpoint + "-s")
    query.awaitTermination()
    assert spark.read.parquet(out + "-s").count() == 17
