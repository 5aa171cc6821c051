"""Command line for spark-submit.

    job.py panel   --catalog C --landed L --pages P --out PANEL
                   [--pages-format json|parquet] [--allow-incomplete]
    job.py quotes  --quotes Q --out QUOTES [--ties highest|lowest|fail]
    job.py reports --panel PANEL --quotes QUOTES --out OUT [--report oil ...]
                   [--start DAY] [--end DAY] [--pair X Y] [--region R]

The panel and the monthly quotes are written once and every report starts from
the written tables, so losing executors during a report never goes back to the
landed files.  Beside the panel, ``OUT-audit`` says for each payload how many
of its declared rows have arrived, and ``OUT-unrouted`` holds the catalog rows
that nothing loads.  A payload whose different pages hold fewer rows than they
declare, or more, stops the job before the panel is written, unless
``--allow-incomplete`` is given; pages that were landed twice count once.

A report reads the years of the panel that its date range and its changes need.
It is written beside the report of the run before and takes its place when all
outputs are there.
"""

from __future__ import annotations

import argparse
import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from monthloom import get_session, plans
from monthloom.operators.panel import monthly_last
from monthloom.sinks import newest_month, panel_years, read_panel, shared_frame, staged_report, write_outputs, write_panel
from monthloom.sources import (
    audit_pages,
    distinct_pages,
    read_catalog,
    read_landed_series,
    read_pages,
    read_quotes,
    unrouted,
)

REPORTS = ("industrial", "oil", "price", "fuel", "employment", "correlation", "recent")

def build(spark: SparkSession, options: argparse.Namespace) -> None:
    catalog = read_catalog(spark, options.catalog)
    pages = read_pages(spark, options.pages, fmt=options.pages_format)
    unrouted(catalog).write.mode("overwrite").parquet(f"{options.out}-unrouted")
    audit_pages(pages, "data_link").write.mode("overwrite").parquet(f"{options.out}-audit")
    audit = spark.read.parquet(f"{options.out}-audit")
    short = audit.where("is_complete IS NOT TRUE")
    if not options.allow_incomplete and not short.isEmpty():
        some = ", ".join(f"{r.data_link} ({r.rows_held} of {r.rows_declared})" for r in short.orderBy("data_link").take(20))
        raise SystemExit(f"payloads whose pages do not hold the rows that they declare: {some}")
    if not audit.where("pages_repeated > 0").isEmpty():
        pages = distinct_pages(pages, "data_link")
    landed = read_landed_series(spark, options.landed, options.format)
    write_panel(plans.build_panel(catalog, landed, pages), options.out)


def build_quotes(spark: SparkSession, options: argparse.Namespace) -> None:
    """Month-end quotes of every ticker, as a panel."""
    quotes = read_quotes(spark, options.quotes, options.format)
    write_panel(monthly_last(quotes, ties=options.ties), options.out)


def outputs_of(
    report: str,
    panel: DataFrame,
    options: argparse.Namespace,
    quotes: Callable[[], DataFrame],
    share: Callable[[DataFrame], DataFrame],
    history: DataFrame | None = None,
    newest: dt.date | None = None,
) -> plans.Outputs:
    if report == "recent":
        return plans.recent_report(panel, newest=newest, share=share)
    if report == "correlation":
        pair = tuple(options.pair) if options.pair else None
        return plans.correlation_report(panel, quotes(), options.start, options.end, pair=pair, share=share)
    if report == "fuel" and options.region:
        return plans.fuel_report(panel, options.start, options.end, region=options.region, share=share, history=history)
    make = {
        "industrial": plans.industrial_report,
        "oil": plans.oil_report,
        "price": plans.price_report,
        "fuel": plans.fuel_report,
        "employment": plans.employment_report,
    }[report]
    return make(panel, options.start, options.end, share=share, history=history)


def run_reports(spark: SparkSession, options: argparse.Namespace) -> None:
    """Each report from the years that it needs, put in place when all of its outputs are written."""
    read = functools.partial(read_panel, spark, options.panel)
    oldest = min(panel_years(spark, options.panel), default=0)
    for report in options.report or REPORTS:
        panel = plans.panel_of(report, read, oldest, options.start, options.end)
        newest = newest_month(spark, options.panel) if report == "recent" else None
        with staged_report(spark, options.out, report) as folder:
            outputs = outputs_of(
                report,
                panel,
                options,
                lambda: read_panel(spark, options.quotes),
                functools.partial(shared_frame, folder=folder),
                history=read(),
                newest=newest,
            )
            write_outputs(outputs, folder)


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Economic panel jobs")
    parser.add_argument("--format", default="parquet", choices=("parquet", "orc", "csv", "json"))
    jobs = parser.add_subparsers(dest="job", required=True)
    panel = jobs.add_parser("panel")
    for name in ("catalog", "landed", "pages", "out"):
        panel.add_argument(f"--{name}", required=True)
    panel.add_argument("--pages-format", default="json", choices=("json", "parquet"))
    panel.add_argument("--allow-incomplete", action="store_true")
    quotes = jobs.add_parser("quotes")
    for name in ("quotes", "out"):
        quotes.add_argument(f"--{name}", required=True)
    quotes.add_argument("--ties", default="highest", choices=("highest", "lowest", "fail"))
    reports = jobs.add_parser("reports")
    for name in ("panel", "out"):
        reports.add_argument(f"--{name}", required=True)
    reports.add_argument("--quotes")
    reports.add_argument("--report", nargs="*", choices=REPORTS)
    reports.add_argument("--start")
    reports.add_argument("--end")
    reports.add_argument("--pair", nargs=2)
    reports.add_argument("--region")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    options = parse(argv)
    spark = get_session("monthloom " + options.job)
    {"panel": build, "quotes": build_quotes, "reports": run_reports}[options.job](spark, options)


if __name__ == "__main__":
    main()
