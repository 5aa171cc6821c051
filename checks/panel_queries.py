"""The panel, its shapes, row selection and derived measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registry import query, rounded
from checks.views import BASE_MONTH, END, EPOCH, START, sql
from monthloom.functions import half_even, natural_log
from monthloom.operators import derive, filters, panel
from monthloom.operators.windows import scale_positions
from monthloom.operators.windows import yoy_calendar as add_yoy

SERIES = ("1-urgent", "2-high", "3-medium", "4-notspecified", "5-low")
WIDE_NAMES = ("urgent", "high", "medium", "unspecified", "low")
REGION_SERIES = ("africa_price", "america_price", "asia_price", "europe_price", "middleeast_price")


def monthly(spark, sf_dir):
    return panel.monthly_mean(views.obs(spark, sf_dir))


def monthly_sparse(spark, sf_dir):
    return panel.monthly_mean(views.obs_sparse(spark, sf_dir))


def monthly_region(spark, sf_dir):
    return panel.monthly_mean(views.obs_region(spark, sf_dir))


def money(frame, *columns):
    return frame.withColumns({c: rounded(c, 4) for c in columns or ("value",)})


# --- aggregation and shape -------------------------------------------------------


@query("month_mean", sql("monthly", "SELECT series_id, month_end, round(value, 4) AS value FROM monthly"))
def month_mean(spark, sf_dir):
    return money(monthly(spark, sf_dir))


GRID = """
    SELECT s.series_id, last_day(CAST(m.g AS DATE)) AS month_end
    FROM (SELECT DISTINCT series_id FROM monthly_sparse) s,
         (SELECT unnest(generate_series(date_trunc('month', min(month_end)), date_trunc('month', max(month_end)),
                                        INTERVAL 1 MONTH)) AS g FROM monthly_sparse) m"""


@query(
    "month_grid",
    sql(
        "monthly_sparse",
        """SELECT series_id, month_end, round(value, 4) AS value
           FROM grid LEFT JOIN monthly_sparse USING (series_id, month_end)""",
        grid=GRID,
    ),
)
def month_grid(spark, sf_dir):
    return money(panel.month_grid(monthly_sparse(spark, sf_dir)))


@query(
    "quotes_month_last",
    sql(
        "quotes_by_flag",
        """SELECT ticker AS series_id, last_day(trade_date) AS month_end, arg_max(close, trade_date) AS value
           FROM quotes_by_flag GROUP BY ALL""",
    ),
)
def quotes_month_last(spark, sf_dir):
    return panel.monthly_last(views.quotes_by_flag(spark, sf_dir))


@query(
    "quotes_ties",
    """SELECT series_id, month_end, max(close) AS value
       FROM (SELECT *
             FROM (SELECT l_returnflag AS series_id, last_day(CAST(l_shipdate AS DATE)) AS month_end,
                          CAST(l_shipdate AS DATE) AS trade_date, l_extendedprice AS close
                   FROM lineitem)
             QUALIFY trade_date = max(trade_date) OVER (PARTITION BY series_id, month_end))
       GROUP BY series_id, month_end""",
)
def quotes_ties(spark, sf_dir):
    """Every line price as a quote, so that a day has many closes, of which the highest stands."""
    lines = views.table(spark, sf_dir, "lineitem")
    quotes = lines.select(
        F.col("l_returnflag").alias("ticker"), F.col("l_shipdate").cast("date").alias("trade_date"), F.col("l_extendedprice").alias("close")
    )
    return panel.monthly_last(quotes)


def _pivot_sql(source: str, key: str, names: tuple[str, ...], codes: tuple[str, ...]) -> str:
    columns = ", ".join(
        f"round(avg(value) FILTER (WHERE series_id = '{code}'), 4) AS \"{name}\"" for code, name in zip(codes, names)
    )
    return f"SELECT {key}, {columns} FROM {source} GROUP BY {key}"


@query("panel_wide", sql("monthly", _pivot_sql("monthly", "month_end", WIDE_NAMES, SERIES)))
def panel_wide(spark, sf_dir):
    wide = panel.widen(monthly(spark, sf_dir), SERIES)
    return wide.select("month_end", *[rounded(F.col(f"`{s}`"), 4).alias(n) for s, n in zip(SERIES, WIDE_NAMES)])


@query(
    "panel_unpivot",
    sql(
        "monthly",
        """SELECT m.month_end, s.series_id, round(v.value, 4) AS value
           FROM (SELECT DISTINCT month_end FROM monthly) m CROSS JOIN (SELECT DISTINCT series_id FROM monthly) s
                LEFT JOIN monthly v ON v.month_end = m.month_end AND v.series_id = s.series_id""",
    ),
)
def panel_unpivot(spark, sf_dir):
    return money(panel.lengthen(panel.widen(monthly(spark, sf_dir), SERIES), SERIES))


@query(
    "pivot_mean",
    sql(
        "payload",
        _pivot_sql("payload", "obs_date", tuple(f"{s}_orders" for s in SERIES), SERIES).replace("obs_date,", "obs_date AS date,", 1),
    ),
)
def pivot_mean(spark, sf_dir):
    """Mean per day and priority, one column per priority."""
    groups = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    wide = panel.pivot_mean(_payload(spark, sf_dir), groups, "_orders")
    return money(wide, *[c for c in wide.columns if c != "date"])


def _payload(spark, sf_dir):
    """Orders in whole dollars, so that totals of means keep their digits."""
    return views.table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderpriority").alias("grp"),
        F.rint("o_totalprice").alias("value"),
    )


@query(
    "pivot_total",
    sql(
        "payload",
        """SELECT date, round(sum(value), 4) AS total_orders FROM means
           WHERE series_id <> '5-low' GROUP BY date""",
        means="SELECT obs_date AS date, series_id, avg(value) AS value FROM payload GROUP BY ALL",
    ),
)
def pivot_total(spark, sf_dir):
    """One group is named like a date column, and so is in no total."""
    label = F.when(F.col("grp") == "5-LOW", F.lit("Up To Date")).otherwise(F.col("grp"))
    totals = panel.group_totals(panel.group_means(_payload(spark, sf_dir).withColumn("grp", label)), suffix="_orders")
    return totals.select("date", rounded("value", 4).alias("total_orders"))


@query(
    "group_series",
    sql(
        "payload",
        """SELECT concat(series_id, '_orders') AS series_id, obs_date AS date, round(avg(value), 4) AS value
           FROM payload GROUP BY ALL""",
    ),
)
def group_series(spark, sf_dir):
    """The same means as series of a long frame."""
    named = panel.named_groups(panel.group_means(_payload(spark, sf_dir)), "_orders")
    return money(named.select("series_id", "date", "value"))


def _wide_sql(series, view: str) -> str:
    cells = ", ".join(f"""max(value) FILTER (WHERE series_id = '{s}') AS "{s}\"""" for s in series)
    return f"(SELECT month_end, {cells} FROM {view} GROUP BY 1)"


@query(
    "panel_full_outer",
    sql(
        "monthly monthly_region",
        "SELECT month_end, "
        + ", ".join(f"""round("{s}", 4) AS "{s}\"""" for s in (*SERIES, *REGION_SERIES))
        + f" FROM {_wide_sql(SERIES, 'monthly')} l FULL OUTER JOIN {_wide_sql(REGION_SERIES, 'monthly_region')} r USING (month_end)",
    ),
)
def panel_full_outer(spark, sf_dir):
    left = panel.widen(monthly(spark, sf_dir), SERIES)
    right = panel.widen(monthly_region(spark, sf_dir), REGION_SERIES)
    wide = panel.full_outer_wide(left, right)
    return wide.select("month_end", *[rounded(F.col(f"`{s}`"), 4).alias(s) for s in (*SERIES, *REGION_SERIES)])


@query(
    "panel_inner",
    sql(
        "monthly quotes_by_flag",
        """SELECT series_id, month_end, round(value, 4) AS value
           FROM (SELECT * FROM last_quotes UNION ALL SELECT * FROM monthly)
           WHERE month_end IN (SELECT month_end FROM last_quotes) AND month_end IN (SELECT month_end FROM monthly)""",
        last_quotes="""SELECT ticker AS series_id, last_day(trade_date) AS month_end, arg_max(close, trade_date) AS value
                       FROM quotes_by_flag GROUP BY ALL""",
    ),
)
def panel_inner(spark, sf_dir):
    return money(panel.inner_panels(quotes_month_last(spark, sf_dir), monthly(spark, sf_dir)))


COMPLETE = """
    SELECT series_id, month_end, value FROM monthly_sparse
    WHERE series_id IN ('0_1', '1_1', '2_1', '3_1', '4_1')
      AND month_end IN (SELECT month_end FROM monthly_sparse
                        WHERE series_id IN ('0_1', '1_1', '2_1', '3_1', '4_1')
                        GROUP BY month_end HAVING count(value) = 5)"""
COMPLETE_SERIES = ("0_1", "1_1", "2_1", "3_1", "4_1")


@query(
    "complete_cases",
    sql("monthly_sparse", "SELECT series_id, month_end, round(value, 4) AS value FROM complete", complete=COMPLETE),
)
def complete_cases(spark, sf_dir):
    return money(panel.complete_cases(monthly_sparse(spark, sf_dir), COMPLETE_SERIES))


# --- row selection ---------------------------------------------------------------


@query(
    "date_range",
    sql(
        "monthly",
        f"""SELECT series_id, month_end, round(value, 4) AS value FROM monthly
            WHERE month_end BETWEEN DATE '{START}' AND DATE '{END}'""",
    ),
)
def date_range(spark, sf_dir):
    """The range said of months, and of days so that the scan is cut too."""
    rows = panel.monthly_mean(views.obs(spark, sf_dir), START, END)
    return money(filters.date_range(rows, START, END))


@query("date_bounds", sql("monthly", "SELECT min(month_end) AS first_date, max(month_end) AS last_date FROM monthly"))
def date_bounds(spark, sf_dir):
    return filters.date_bounds(monthly(spark, sf_dir))


@query(
    "epoch_filter",
    sql(
        "monthly",
        f"SELECT series_id, month_end, round(value, 4) AS value FROM monthly WHERE month_end >= DATE '{EPOCH}'",
    ),
)
def epoch_filter(spark, sf_dir):
    return money(filters.since(panel.monthly_mean(views.obs(spark, sf_dir), EPOCH), EPOCH))


@query(
    "tail_n",
    sql(
        "monthly_sparse",
        """SELECT series_id, month_end, round(value, 4) AS value
           FROM grid LEFT JOIN monthly_sparse USING (series_id, month_end)
           QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY month_end DESC) <= 37""",
        grid=GRID,
    ),
)
def tail_n(spark, sf_dir):
    return money(filters.last_rows(panel.month_grid(monthly_sparse(spark, sf_dir)), 37))


@query(
    "tail_months",
    sql(
        "monthly_sparse",
        """SELECT series_id, month_end, round(value, 4) AS value FROM monthly_sparse
           WHERE month_end > last_day((SELECT max(month_end) FROM monthly_sparse) - INTERVAL 37 MONTH)""",
    ),
)
def tail_months(spark, sf_dir):
    return money(panel.last_months(monthly_sparse(spark, sf_dir), 37))


@query(
    "category_select",
    sql(
        "monthly",
        "SELECT series_id, month_end, round(value, 4) AS value FROM monthly WHERE series_id IN ('2-high', '5-low')",
    ),
)
def category_select(spark, sf_dir):
    return money(filters.keep_series(monthly(spark, sf_dir), ["2-high", "5-low"]))


@query(
    "category_except",
    sql(
        "obs_region obs",
        """SELECT DISTINCT series_id FROM obs_region
           EXCEPT SELECT concat(lower(r_name), '_price') FROM region WHERE r_name = 'ASIA'""",
    ),
)
def category_except(spark, sf_dir):
    """All categories but the ones another frame lists."""
    left_out = views.region_dim(spark, sf_dir).where(F.col("region") == "ASIA")
    return filters.series_except(views.obs_region(spark, sf_dir), left_out)


DRILL_REGIONS = {"Urgent": "1-urgent", "High": "2-high", "Medium": "3-medium", "Low": "5-low"}
DRILL_SQL = """
    SELECT {view} AS shown, CASE series_id WHEN '4-notspecified' THEN 'USA' WHEN '1-urgent' THEN 'Urgent'
           WHEN '2-high' THEN 'High' WHEN '3-medium' THEN 'Medium' ELSE 'Low' END AS label,
           month_end, round(value, 4) AS value
    FROM monthly WHERE series_id IN ({series})"""


@query(
    "drill_series",
    sql(
        "monthly",
        " UNION ALL ".join(
            (
                DRILL_SQL.format(view="'national'", series="'4-notspecified'"),
                DRILL_SQL.format(view="'regions'", series="'1-urgent', '2-high', '3-medium', '5-low'"),
                DRILL_SQL.format(view="'one'", series="'5-low'"),
            )
        ),
    ),
)
def drill_series(spark, sf_dir):
    """The nation, all regions, one region and an unknown one."""
    rows = monthly(spark, sf_dir)
    parts = [
        derive.drill_series(rows, "4-notspecified", DRILL_REGIONS, level, selected)
        .select(F.lit(shown).alias("shown"), "label", "month_end", "value")
        for shown, level, selected in (
            ("national", "national", None),
            ("regions", "region", None),
            ("one", "region", "Low"),
            ("unknown", "region", "Nowhere"),
        )
    ]
    return money(panel.union_panels(*parts))


# --- derived measures --------------------------------------------------------------


@query(
    "unit_convert",
    sql(
        "obs",
        """SELECT obs_id, CASE WHEN series_id = '5-low' THEN round_even(value / 100, 0) ELSE value END AS value
           FROM obs""",
    ),
)
def unit_convert(spark, sf_dir):
    rows = derive.convert_units(views.obs(spark, sf_dir), ["5-low"], 100.0, 0)
    return rows.select("obs_id", "value")


@query("log_values", sql("obs", "SELECT obs_id, round(ln(value), 6) AS log_value FROM obs"))
def log_values(spark, sf_dir):
    return views.obs(spark, sf_dir).select("obs_id", rounded(natural_log(F.col("value")), 6).alias("log_value"))


@query(
    "cpi_rebase",
    sql(
        "monthly price_index",
        f"""SELECT m.series_id, m.month_end, round(m.value * (i.value / b.value), 4) AS inflated,
                   round(m.value * (b.value / i.value), 4) AS deflated
            FROM monthly m LEFT JOIN price_index i ON i.month_end = m.month_end,
                 (SELECT value FROM price_index WHERE month_end = DATE '{BASE_MONTH}') b""",
    ),
)
def cpi_rebase(spark, sf_dir):
    rows, index = monthly(spark, sf_dir), views.price_index(spark, sf_dir)
    both = rows.withColumn("kept", F.col("value"))
    up = derive.cpi_rebase(both, index, BASE_MONTH).withColumnRenamed("value", "inflated").withColumnRenamed("kept", "value")
    down = derive.cpi_rebase(up, index, BASE_MONTH, mode="deflate").withColumnRenamed("value", "deflated")
    return money(down, "inflated", "deflated").select("series_id", "month_end", "inflated", "deflated")


@query(
    "minmax_scale",
    sql(
        "monthly",
        """SELECT series_id, month_end,
                  round((value + 6) / (max(value) OVER (PARTITION BY series_id) + 6), 6) AS position
           FROM monthly""",
    ),
)
def minmax_scale(spark, sf_dir):
    rows = scale_positions(monthly(spark, sf_dir), -6.0)
    return rows.select("series_id", "month_end", rounded("position", 6).alias("position"))


YOY_REGION = f"""
    SELECT c.series_id, c.month_end, c.value, 100 * (c.value - p.value) / nullif(p.value, 0) AS yoy
    FROM monthly_region c LEFT JOIN monthly_region p
         ON p.series_id = c.series_id AND p.month_end = last_day(c.month_end - INTERVAL 12 MONTH)"""
LATEST = """
    SELECT region, l.month_end, coalesce(l.value, 0) AS price,
           CASE WHEN l.month_end IS NULL THEN 0 ELSE round_even(l.yoy, 2) END AS yoy
    FROM region_dim LEFT JOIN (
        SELECT series_id, max(month_end) AS month_end, arg_max(value, month_end) AS value,
               arg_max(yoy, month_end) AS yoy
        FROM with_yoy WHERE month_end <= DATE '{end}' AND month_end >= DATE '{start}' GROUP BY series_id) l
    USING (series_id)"""


def _latest(spark, sf_dir, start=START, end=END):
    shown = filters.date_range(add_yoy(monthly_region(spark, sf_dir)), start, end)
    return derive.latest_region(shown, views.region_dim(spark, sf_dir))


@query(
    "latest_region",
    sql(
        "monthly_region region_dim",
        "SELECT region, month_end, round(price, 4) AS price, yoy FROM latest",
        with_yoy=YOY_REGION,
        latest=LATEST.format(start=START, end=END),
    ),
)
def latest_region(spark, sf_dir):
    return money(_latest(spark, sf_dir), "price")


@query(
    "latest_region_empty",
    sql(
        "monthly_region region_dim",
        "SELECT region, month_end, price, yoy FROM latest",
        with_yoy=YOY_REGION,
        latest=LATEST.format(start="2030-01-01", end="2031-01-01"),
    ),
)
def latest_region_empty(spark, sf_dir):
    """A range after the data: zeros for every region."""
    return _latest(spark, sf_dir, "2030-01-01", "2031-01-01")


@query(
    "region_rollout",
    sql(
        "monthly_region region_dim region_state",
        "SELECT region, state, month_end, round(price, 4) AS price, yoy FROM latest JOIN region_state USING (region)",
        with_yoy=YOY_REGION,
        latest=LATEST.format(start=START, end=END),
    ),
)
def region_rollout(spark, sf_dir):
    rows = derive.region_rollout(_latest(spark, sf_dir), views.region_state(spark, sf_dir))
    return money(rows, "price").select("region", "state", "month_end", "price", "yoy")


@query(
    "region_cards",
    sql(
        "monthly_region region_dim",
        """SELECT region, concat(' $', CAST(round_even(price, 2) AS VARCHAR)) AS price_card,
                  concat(' ', CAST(yoy AS VARCHAR), '%') AS change_card,
                  printf('%s: $%.2f', region, round_even(price, 2)) AS marker_text
           FROM latest""",
        with_yoy=YOY_REGION,
        latest=LATEST.format(start=START, end=END),
    ),
)
def region_cards(spark, sf_dir):
    latest = _latest(spark, sf_dir).withColumn("price", half_even(F.col("price")))
    return derive.with_cards(latest).select("region", "price_card", "change_card", "marker_text")


@query(
    "latest_unpivot",
    sql(
        "monthly",
        """SELECT series_id AS area, round(arg_max(value, month_end), 4) AS production FROM monthly
           WHERE month_end <= DATE '2000-12-31' GROUP BY series_id""",
    ),
)
def latest_unpivot(spark, sf_dir):
    rows = filters.date_range(monthly(spark, sf_dir), None, END)
    return filters.latest_values(rows).select(F.col("series_id").alias("area"), rounded("value", 4).alias("production"))
