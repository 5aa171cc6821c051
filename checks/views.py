"""The engine's input frames, derived from the driver tables.

Each is defined twice: as a DataFrame over the whole Parquet tables, and as a
SQL common table expression over views of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.functions import series_stem
from monthloom.operators.panel import monthly_mean
from monthloom.plans import names
from monthloom.plans.panel import with_inflation

PAGE_ROWS = 500
PAYLOADS = 7

# Every series the reports read, except the price index and its change.
REPORT_SERIES = tuple(
    s
    for s in dict.fromkeys(
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
    if s not in (names.INFLATION, names.CPI)
)
TICKERS = tuple(names.TICKER_LABELS)

# Dates that suit the years the driver tables cover.
EPOCH = "1997-01-01"
BASE_MONTH = "1998-01-31"
START, END = "1998-03-31", "2000-12-31"


# Said rather than inferred, which would read file footers in a job per table.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_nationkey INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
    "o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_extendedprice DOUBLE, l_returnflag STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], number: str) -> Column:
    """The value at the place that a key gives, counted round."""
    options = F.split(F.lit("|".join(values)), "[|]")
    return F.element_at(options, (F.col(number) % len(values) + 1).cast("int"))


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _pick_sql(values: tuple[str, ...], number: str) -> str:
    return f"([{sql_list(values)}])[{number} % {len(values)} + 1]"


def cents(price: str) -> Column:
    """A price in whole cents, so that sums are exact in any order of rows."""
    return F.rint(F.col(price) * 100)


# --- observations ------------------------------------------------------------


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices as observations, one series per order priority."""
    return table(spark, sf_dir, "orders").select(
        series_stem(F.col("o_orderpriority")).alias("series_id"),
        F.col("o_orderdate").cast("date").alias("obs_date"),
        cents("o_totalprice").alias("value"),
        F.col("o_orderkey").alias("obs_id"),
    )


def obs_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many series with missing months: nation and priority."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.concat(F.col("c_nationkey").cast("string"), F.lit("_"), F.left("o_orderpriority", F.lit(1))).alias(
            "series_id"
        ),
        F.col("o_orderdate").cast("date").alias("obs_date"),
        cents("o_totalprice").alias("value"),
    )


def obs_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line prices by the region of the customer.

    Orders get their places before they meet the lines, so that the lines move once.  Lines and orders both grow with the
    data, so they are joined by sorting, which needs neither to fit in memory.
    """
    places = region_state(spark, sf_dir, keep_key=True)
    customers = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    placed = orders.select("o_orderkey", series_stem(F.col("region"), "_price").alias("series_id"))
    lines = table(spark, sf_dir, "lineitem").hint("merge")
    return lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "series_id",
        F.col("l_shipdate").cast("date").alias("obs_date"),
        cents("l_extendedprice").alias("value"),
    )


def region_state(spark: SparkSession, sf_dir: str, keep_key: bool = False) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    pair = [F.col("r_name").alias("region"), F.col("n_name").alias("state")]
    return joined.select(*pair, "n_nationkey") if keep_key else joined.select(*pair)


def region_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    return region.select(F.col("r_name").alias("region"), series_stem(F.col("r_name"), "_price").alias("series_id"))


def price_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean line price per month, standing in for a price index."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.lit("index").alias("series_id"),
        F.col("l_shipdate").cast("date").alias("obs_date"),
        cents("l_extendedprice").alias("value"),
    )
    return monthly_mean(lines)


def economy_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line prices dealt out to the series that the reports read.

    The price index takes in every line on top, so that one series holds half
    of all observations.
    """
    own = _pick(REPORT_SERIES, "l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.explode(F.array(own, F.lit(names.CPI))).alias("series_id"),
        F.col("l_shipdate").cast("date").alias("obs_date"),
        cents("l_extendedprice").alias("value"),
    )


def economy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly panel of the report series, with inflation."""
    return with_inflation(monthly_mean(economy_obs(spark, sf_dir)))


# --- quotes --------------------------------------------------------------------


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last event value of a day per event type; no two events share a time."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("ticker"), F.col("ts").cast("date").alias("trade_date")).agg(
        F.max_by("value", "ts").alias("close")
    )


def _line_quotes(spark: SparkSession, sf_dir: str, ticker: Column) -> DataFrame:
    """The highest line price of a day, standing in for its close."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(ticker.alias("ticker"), F.col("l_shipdate").cast("date").alias("trade_date")).agg(
        F.max("l_extendedprice").alias("close")
    )


def quotes_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily quotes per return flag."""
    return _line_quotes(spark, sf_dir, F.col("l_returnflag"))


def market_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily quotes, dealt out to the tickers of the report."""
    return _line_quotes(spark, sf_dir, _pick(TICKERS, "l_suppkey"))


# --- pages and catalog -----------------------------------------------------------


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events packed into JSON pages of 500 records, pages dealt to payloads.

    A page declares its payload's total.  That of odd payloads is one too high,
    as when the last page has not arrived.
    """
    events = table(spark, sf_dir, "events").withColumn("page", F.expr(f"event_id div {PAGE_ROWS}"))
    events = events.withColumn("data_link", (F.col("page") % PAYLOADS).cast("string"))
    record = F.create_map(
        F.lit("period"), F.date_format("ts", "yyyy-MM-dd"),
        F.lit("value"), F.col("value").cast("string"),
        F.lit("grp"), F.col("event_type"),
    )
    packed = events.groupBy("data_link", "page").agg(F.array_agg(record).alias("data"))
    totals = packed.groupBy("data_link").agg(F.sum(F.size("data")).alias("held"))
    declared = (F.col("held") + F.col("data_link").cast("bigint") % 2).cast("string")
    body = F.to_json(F.struct(F.struct(declared.alias("total"), "data").alias("response")))
    return packed.join(totals, "data_link").select("data_link", "page", body.alias("body"))


CATALOG_FIELDS = "source data_name secondary_name data_link paginated column_to_groupby value_name".split()


def catalog_lines(spark: SparkSession, sf_dir: str, index_name: str | None = None) -> DataFrame:
    """Catalog rows as CSV text: a series per order priority, a payload per
    remainder of the nation keys, and a row that nothing loads per region."""
    priority, region = F.col("o_orderpriority"), F.col("r_name")
    name = series_stem(priority)
    if index_name is not None:
        name = F.when(priority == "1-URGENT", F.lit(index_name)).otherwise(name)
    payload = (F.col("n_nationkey") % PAYLOADS).cast("string")
    series = table(spark, sf_dir, "orders").select(priority).distinct()
    paged = table(spark, sf_dir, "nation").select(payload.alias("p")).distinct()
    other = table(spark, sf_dir, "region").select(region)
    parts = (
        series.select(F.concat(F.lit("fred,"), priority, F.lit(","), name, F.lit(",,no,,"))),
        paged.select(F.concat(F.lit("eia_api,,_load"), F.col("p"), F.lit(","), F.col("p"), F.lit(",yes,grp,value"))),
        other.select(F.concat(F.lit("manual,"), region, F.lit(",region"), region, F.lit(",,,,"))),
    )
    return parts[0].union(parts[1]).union(parts[2]).toDF("line")


# --- the same in SQL ---------------------------------------------------------------

VIEWS: dict[str, str] = {
    "obs": """
        SELECT lower(replace(o_orderpriority, ' ', '')) AS series_id, CAST(o_orderdate AS DATE) AS obs_date,
               round(o_totalprice * 100) AS value, o_orderkey AS obs_id
        FROM orders""",
    "payload": """
        SELECT lower(replace(o_orderpriority, ' ', '')) AS series_id, CAST(o_orderdate AS DATE) AS obs_date,
               round_even(o_totalprice, 0) AS value
        FROM orders""",
    "obs_sparse": """
        SELECT concat(CAST(c_nationkey AS VARCHAR), '_', left(o_orderpriority, 1)) AS series_id,
               CAST(o_orderdate AS DATE) AS obs_date, round(o_totalprice * 100) AS value
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "obs_region": """
        SELECT concat(lower(replace(r_name, ' ', '')), '_price') AS series_id,
               CAST(l_shipdate AS DATE) AS obs_date, round(l_extendedprice * 100) AS value
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "region_state": """
        SELECT r_name AS region, n_name AS state
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "region_dim": """
        SELECT r_name AS region, concat(lower(replace(r_name, ' ', '')), '_price') AS series_id FROM region""",
    "monthly": """
        SELECT series_id, last_day(obs_date) AS month_end, avg(value) AS value FROM obs GROUP BY ALL""",
    "monthly_sparse": """
        SELECT series_id, last_day(obs_date) AS month_end, avg(value) AS value FROM obs_sparse GROUP BY ALL""",
    "monthly_region": """
        SELECT series_id, last_day(obs_date) AS month_end, avg(value) AS value FROM obs_region GROUP BY ALL""",
    "price_index": """
        SELECT 'index' AS series_id, last_day(CAST(l_shipdate AS DATE)) AS month_end, avg(round(l_extendedprice * 100)) AS value
        FROM lineitem GROUP BY ALL""",
    "quotes": """
        SELECT event_type AS ticker, CAST(ts AS DATE) AS trade_date,
               arg_max(value, ts) AS close
        FROM events GROUP BY ALL""",
    "quotes_by_flag": """
        SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS trade_date,
               max(l_extendedprice) AS close
        FROM lineitem GROUP BY ALL""",
    "market_quotes": f"""
        SELECT {_pick_sql(TICKERS, 'l_suppkey')} AS ticker, CAST(l_shipdate AS DATE) AS trade_date,
               max(l_extendedprice) AS close
        FROM lineitem GROUP BY ALL""",
    "records": f"""
        SELECT CAST((event_id // {PAGE_ROWS}) % {PAYLOADS} AS VARCHAR) AS data_link, event_id // {PAGE_ROWS} AS page,
               strftime(ts, '%Y-%m-%d') AS period, value, event_type AS grp
        FROM events""",
    "catalog": f"""
        SELECT DISTINCT 'fred' AS source, o_orderpriority AS data_name,
               lower(replace(o_orderpriority, ' ', '')) AS secondary_name, NULL::VARCHAR AS data_link,
               'no' AS paginated, NULL::VARCHAR AS column_to_groupby, NULL::VARCHAR AS value_name
        FROM orders
        UNION ALL
        SELECT DISTINCT 'eia_api', NULL, concat('_load', n_nationkey % {PAYLOADS}), CAST(n_nationkey % {PAYLOADS} AS VARCHAR),
               'yes', 'grp', 'value'
        FROM nation
        UNION ALL
        SELECT 'manual', r_name, concat('region', r_name), NULL, NULL, NULL, NULL FROM region""",
    "economy_base": f"""
        SELECT {_pick_sql(REPORT_SERIES, 'l_partkey')} AS series_id, last_day(CAST(l_shipdate AS DATE)) AS month_end,
               avg(round(l_extendedprice * 100)) AS value
        FROM lineitem GROUP BY ALL
        UNION ALL
        SELECT '{names.CPI}', month_end, value FROM price_index""",
    "economy": """
        SELECT series_id, month_end, value FROM economy_base
        UNION ALL
        SELECT 'inflation_rate', c.month_end, 100 * (c.value - p.value) / nullif(p.value, 0)
        FROM economy_base c LEFT JOIN economy_base p
             ON p.series_id = c.series_id AND p.month_end = last_day(c.month_end - INTERVAL 12 MONTH)
        WHERE c.series_id = 'cpi_all'""",
}

NEEDS: dict[str, tuple[str, ...]] = {
    "monthly": ("obs",),
    "monthly_sparse": ("obs_sparse",),
    "monthly_region": ("obs_region",),
    "catalog": ("records",),
    "economy_base": ("price_index",),
    "economy": ("economy_base",),
}


def sql(views: str, body: str, **extra: str) -> str:
    """A query over named views; ``extra`` adds further named steps in order."""
    ordered: list[str] = []

    def add(view: str) -> None:
        for needed in NEEDS.get(view, ()):
            add(needed)
        if view not in ordered:
            ordered.append(view)

    for view in views.split():
        add(view)
    steps = [f"{v} AS ({VIEWS[v]})" for v in ordered] + [f"{v} AS ({text})" for v, text in extra.items()]
    return "WITH " + ",\n".join(steps) + "\n" + body
