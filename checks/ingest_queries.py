"""Sources and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registry import query, rounded
from checks.views import sql
from monthloom.functions import format_iso, format_month_year, parse_mixed_date, series_stem
from monthloom.operators import clean
from monthloom.operators.broadcasting import literal_rows
from monthloom.operators.panel import monthly_mean
from monthloom.plans.panel import build_panel
from monthloom.schemas import LANDED_SERIES, QUOTES
from monthloom.sources import audit_pages, catalog_from_lines, catalog_series, distinct_pages, flatten_pages, parse_lines, parse_pages, route, unrouted
from monthloom.sources.catalog import PAGED_SOURCE, SERIES_SOURCE


def _landed(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("data_name"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        views.cents("o_totalprice").alias("value"),
    )


def _pages(spark, sf_dir):
    return parse_pages(views.pages(spark, sf_dir))


@query("catalog_scan", sql("catalog", "SELECT * FROM catalog"))
def catalog_scan(spark, sf_dir):
    return catalog_from_lines(views.catalog_lines(spark, sf_dir))


SHUFFLED_CATALOG = "value_name,note,data_link,secondary_name,column_to_groupby,source,owner,data_name,paginated"


@query("catalog_by_header", sql("catalog", "SELECT * FROM catalog"))
def catalog_by_header(spark, sf_dir):
    """The catalog from lines with other columns among its own, in another order."""
    lines = views.catalog_lines(spark, sf_dir)
    field = lambda name: F.split("line", ",")[views.CATALOG_FIELDS.index(name)]
    cells = [F.lit('"a ""note"", quoted"') if n == "note" else F.lit("x") if n == "owner" else field(n) for n in SHUFFLED_CATALOG.split(",")]
    return catalog_from_lines(lines.select(F.concat_ws(",", *cells).alias("line")), header=SHUFFLED_CATALOG)


@query(
    "catalog_route",
    sql(
        "catalog",
        """SELECT source, secondary_name, source IN ('fred', 'eia_api') AS is_routed,
                  CAST(CASE source WHEN 'fred' THEN (SELECT count(*) FROM orders WHERE o_orderpriority = data_name)
                                   WHEN 'eia_api' THEN (SELECT count(*) FROM records r WHERE r.data_link = c.data_link)
                                   ELSE 0 END AS BIGINT) AS landed_rows
           FROM catalog c""",
    ),
)
def catalog_route(spark, sf_dir):
    """Rows that landed for each catalog row, and the rows nothing loads."""
    catalog = catalog_scan(spark, sf_dir)
    counted = F.count(F.lit(1)).alias("landed_rows")
    landed = _landed(spark, sf_dir).groupBy("data_name").agg(counted)
    paged = audit_pages(_pages(spark, sf_dir), "data_link").select("data_link", F.col("rows_held").alias("landed_rows"))
    columns = ["source", "secondary_name"]
    parts = [
        route(catalog, SERIES_SOURCE).join(landed, "data_name", "left").select(*columns, F.lit(True), "landed_rows"),
        route(catalog, PAGED_SOURCE).join(paged, "data_link", "left").select(*columns, F.lit(True), "landed_rows"),
        unrouted(catalog).select(*columns, F.lit(False), F.lit(0).cast("bigint")),
    ]
    joined = parts[0].union(parts[1]).union(parts[2]).toDF(*columns, "is_routed", "landed_rows")
    return joined.withColumn("landed_rows", F.coalesce("landed_rows", F.lit(0)).cast("bigint"))


@query("obs_scan", sql("obs", "SELECT series_id, obs_date, value FROM obs"))
def obs_scan(spark, sf_dir):
    return catalog_series(_landed(spark, sf_dir), catalog_scan(spark, sf_dir))


@query("json_flatten", sql("records", "SELECT page, period, value, grp FROM records"))
def json_flatten(spark, sf_dir):
    rows = flatten_pages(_pages(spark, sf_dir), "page")
    record = F.col("record")
    return rows.select(
        "page", record["period"].alias("period"), record["value"].cast("double").alias("value"), record["grp"].alias("grp")
    )


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    """A field of a small JSON text column."""
    events = views.table(spark, sf_dir, "events")
    return events.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query(
    "page_union",
    sql(
        "records",
        """SELECT data_link, grp, count(*) AS rows, round(sum(value), 2) AS total
           FROM records GROUP BY ALL""",
    ),
)
def page_union(spark, sf_dir):
    """All pages of a payload taken together."""
    rows = flatten_pages(_pages(spark, sf_dir), "data_link")
    value = F.col("record")["value"].cast("double")
    return rows.groupBy("data_link", F.col("record")["grp"].alias("grp")).agg(
        F.count(F.lit(1)).alias("rows"), rounded(F.sum(value), 2).alias("total")
    )


@query(
    "page_audit",
    sql(
        "records",
        """SELECT data_link, count(DISTINCT page) AS pages, CAST(0 AS BIGINT) AS pages_repeated, count(*) AS rows_held,
                  count(*) + CAST(data_link AS BIGINT) % 2 AS rows_declared, CAST(0 AS BIGINT) AS rows_surplus,
                  CAST(data_link AS BIGINT) % 2 = 0 AS is_complete
           FROM records GROUP BY data_link""",
    ),
)
def page_audit(spark, sf_dir):
    return audit_pages(_pages(spark, sf_dir), "data_link")


# Pages that have not arrived, and pages that were landed twice; at the smallest size there are the first two only.
MISSING, TWICE = (4, 12), (0, 9, 11, 18)


def _landed_pages(spark, sf_dir):
    arrived = _pages(spark, sf_dir).where(~F.col("page").isin(*MISSING))
    return arrived.unionByName(arrived.where(F.col("page").isin(*TWICE)))


@query(
    "page_audit_repeats",
    sql(
        "records",
        f"""SELECT data_link, CAST(sum(copies) AS BIGINT) AS pages, CAST(sum(copies - 1) AS BIGINT) AS pages_repeated,
                   CAST(sum(n) AS BIGINT) AS rows_held, max(declared) AS rows_declared,
                   CAST(greatest(sum(copies * n) - max(declared), 0) AS BIGINT) AS rows_surplus, sum(n) = max(declared) AS is_complete
            FROM (SELECT data_link, page, count(*) AS n, CASE WHEN page IN {TWICE} THEN 2 ELSE 1 END AS copies,
                  FROM records WHERE page NOT IN {MISSING} GROUP BY ALL)
                 JOIN (SELECT data_link, count(*) + CAST(data_link AS BIGINT) % 2 AS declared FROM records GROUP BY data_link) USING (data_link)
            GROUP BY data_link""",
    ),
)
def page_audit_repeats(spark, sf_dir):
    """Pages landed twice neither hide missing ones nor go unreported."""
    return audit_pages(_landed_pages(spark, sf_dir), "data_link")


@query(
    "page_distinct",
    sql("records", f"SELECT data_link, page, period, value, grp FROM records WHERE page NOT IN {MISSING}"),
)
def page_distinct(spark, sf_dir):
    """Records of the pages that have arrived, each page once."""
    rows = flatten_pages(distinct_pages(_landed_pages(spark, sf_dir), "data_link"), "data_link", "page")
    record = F.col("record")
    return rows.select("data_link", "page", record["period"].alias("period"), record["value"].cast("double").alias("value"), record["grp"].alias("grp"))


@query(
    "landed_by_header",
    "SELECT o_orderpriority AS data_name, strftime(o_orderdate, '%Y-%m-%d') AS date, round(o_totalprice * 100) AS value FROM orders",
)
def landed_by_header(spark, sf_dir):
    """Landed rows from CSV text with the value first and a column that nobody asked for."""
    rows = _landed(spark, sf_dir)
    lines = rows.select(F.concat_ws(",", F.col("value").cast("decimal(18,0)"), F.lit('"1,5"'), "date", "data_name").alias("line"))
    return parse_lines(lines, "value,weight,date,data_name", LANDED_SERIES)


@query("quotes_by_header", sql("quotes", "SELECT ticker, trade_date, close FROM quotes"))
def quotes_by_header(spark, sf_dir):
    """Quotes from CSV text with the date first, as day and as compact day in turn."""
    quotes = views.quotes(spark, sf_dir)
    day = F.date_format("trade_date", "yyyy-MM-dd")
    text = F.when(F.dayofmonth("trade_date") % 2 == 0, day).otherwise(F.replace(day, F.lit("-"), F.lit("")))
    lines = quotes.select(F.concat_ws(",", text, F.lit("7"), F.col("close").cast("string"), "ticker").alias("line"))
    return parse_lines(lines, ["trade_date", "volume", "close", "ticker"], QUOTES)


@query("quotes_scan", sql("quotes", "SELECT ticker, trade_date, close FROM quotes"))
def quotes_scan(spark, sf_dir):
    return views.quotes(spark, sf_dir)


def _text_values(spark, sf_dir):
    """Prices as text, with two spellings of a missing one."""
    text = (
        F.when(F.col("obs_id") % 10 == 0, F.lit("None"))
        .when(F.col("obs_id") % 10 == 1, F.lit(None).cast("string"))
        .otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
    )
    return views.obs(spark, sf_dir).select("obs_id", "series_id", text.alias("value"))


TEXT_VALUES = """
    SELECT obs_id, series_id,
           CASE obs_id % 10 WHEN 0 THEN 'None' WHEN 1 THEN NULL
                ELSE CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) END AS value
    FROM obs"""


@query(
    "null_tokens",
    sql("obs", "SELECT obs_id, nullif(value, 'None') AS value FROM text_values", text_values=TEXT_VALUES),
)
def null_tokens(spark, sf_dir):
    return clean.clean_text_values(_text_values(spark, sf_dir), "value").select("obs_id", "value")


@query(
    "cast_values",
    sql(
        "obs",
        """SELECT obs_id, CAST(value AS DOUBLE) AS value FROM text_values
           WHERE value IS NOT NULL AND value <> 'None'""",
        text_values=TEXT_VALUES,
    ),
)
def cast_values(spark, sf_dir):
    """Null tokens and incomplete rows go, the rest must be numbers."""
    rows = clean.clean_text_values(_text_values(spark, sf_dir), "value")
    return clean.cast_values(clean.drop_incomplete_rows(rows, "value")).select("obs_id", "value")


@query(
    "cast_rejects",
    sql(
        "obs",
        """SELECT series_id, count(*) AS rows,
                  count(*) FILTER (WHERE value IS NOT NULL AND TRY_CAST(value AS DOUBLE) IS NULL) AS rejected
           FROM text_values GROUP BY series_id""",
        text_values=TEXT_VALUES,
    ),
)
def cast_rejects(spark, sf_dir):
    return clean.count_rejects(_text_values(spark, sf_dir))


@query(
    "date_audit",
    sql(
        "obs",
        """SELECT series_id, CAST(sum(n) AS BIGINT) AS rows, count(*) AS dates,
                  count(*) FILTER (WHERE n > 1) AS repeated_dates
           FROM (SELECT series_id, obs_date, count(*) AS n FROM obs GROUP BY ALL) GROUP BY series_id""",
    ),
)
def date_audit(spark, sf_dir):
    return clean.audit_dates(views.obs(spark, sf_dir))


@query(
    "parse_dates",
    sql(
        "obs",
        """SELECT obs_id, CAST(CASE obs_id % 3 WHEN 0 THEN obs_date WHEN 1 THEN date_trunc('month', obs_date)
                          ELSE date_trunc('year', obs_date) END AS DATE) AS obs_date
           FROM obs""",
    ),
)
def parse_dates(spark, sf_dir):
    """Dates sent as day, as month and as year."""
    form = F.col("obs_id") % 3
    text = (
        F.when(form == 0, F.date_format("obs_date", "yyyy-MM-dd"))
        .when(form == 1, F.date_format("obs_date", "yyyy-MM"))
        .otherwise(F.date_format("obs_date", "yyyy"))
    )
    return views.obs(spark, sf_dir).select("obs_id", parse_mixed_date(text).alias("obs_date"))


@query(
    "format_dates",
    sql(
        "obs",
        """SELECT obs_id, strftime(obs_date, '%Y-%m-%d') AS iso_date, strftime(obs_date, '%m-%Y') AS month_label
           FROM obs""",
    ),
)
def format_dates(spark, sf_dir):
    day = F.col("obs_date")
    return views.obs(spark, sf_dir).select(
        "obs_id", format_iso(day).alias("iso_date"), format_month_year(day).alias("month_label")
    )


@query(
    "label_normalise",
    "SELECT o_orderkey, concat(lower(replace(o_orderpriority, ' ', '')), '_orders') AS series_id FROM orders",
)
def label_normalise(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey", series_stem(F.col("o_orderpriority"), "_orders").alias("series_id")
    )


@query(
    "rename_labels",
    sql(
        "monthly",
        """SELECT CASE series_id WHEN '1-urgent' THEN 'urgent' WHEN '5-low' THEN 'low' ELSE series_id END AS series_id,
                  month_end, round(value, 4) AS value
           FROM monthly""",
    ),
)
def rename_labels(spark, sf_dir):
    panel = monthly_mean(views.obs(spark, sf_dir))
    renamed = clean.rename_series(panel, {"1-urgent": "urgent", "5-low": "low"})
    return renamed.withColumn("value", rounded("value", 4))


@query(
    "label_lookup",
    sql(
        "obs",
        """SELECT obs_id, series_id, CASE series_id WHEN '1-urgent' THEN 'Urgent' WHEN '2-high' THEN 'High'
                                                    ELSE series_id END AS label
           FROM obs""",
    ),
)
def label_lookup(spark, sf_dir):
    labels = literal_rows(spark, [("1-urgent", "Urgent"), ("2-high", "High")], "code STRING, label STRING")
    return clean.with_labels(views.obs(spark, sf_dir), labels).select("obs_id", "series_id", "label")


@query(
    "panel_build",
    sql(
        "obs records",
        """SELECT series_id, month_end, round(value, 4) AS value FROM panel
           UNION ALL
           SELECT 'inflation_rate', c.month_end, round(100 * (c.value - p.value) / nullif(p.value, 0), 4)
           FROM panel c LEFT JOIN panel p
                ON p.series_id = c.series_id AND p.month_end = last_day(c.month_end - INTERVAL 12 MONTH)
           WHERE c.series_id = 'cpi_all'""",
        means="SELECT data_link, period, grp, avg(value) AS value FROM records GROUP BY ALL",
        daily="""
            SELECT CASE series_id WHEN '1-urgent' THEN 'cpi_all' ELSE series_id END AS series_id, obs_date, value FROM obs
            UNION ALL
            SELECT concat(lower(replace(grp, ' ', '')), '_load', data_link), CAST(period AS DATE), value FROM means
            UNION ALL
            SELECT concat('total_load', data_link), CAST(period AS DATE), sum(value) FROM means GROUP BY ALL""",
        panel="SELECT series_id, last_day(obs_date) AS month_end, avg(value) AS value FROM daily GROUP BY ALL",
    ),
)
def panel_build(spark, sf_dir):
    """From catalog text, landed rows and JSON pages to the panel."""
    catalog = catalog_from_lines(views.catalog_lines(spark, sf_dir, "cpi_all"))
    panel = build_panel(catalog, _landed(spark, sf_dir), _pages(spark, sf_dir))
    return panel.withColumn("value", rounded("value", 4))
