"""Reports over a panel of the series they read."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registry import query, rounded
from checks.views import BASE_MONTH, END, EPOCH, START, sql, sql_list
from checks.window_queries import MATRIX, PEARSON
from monthloom import plans
from monthloom.operators.panel import union_panels
from monthloom.plans import names
from monthloom.operators.panel import monthly_last

RANGE = f"month_end BETWEEN DATE '{START}' AND DATE '{END}'"
PAIR = ("SP500", "Oil Price")


def figure_lines(frame):
    return frame.select("figure", "month_end", rounded("value", 4).alias("value"), rounded("yoy", 6).alias("yoy"))


def matrix(frame):
    return frame.withColumn("r", rounded("r", 6))


def values(mapping: dict[str, str]) -> str:
    return ", ".join(f"({sql_list(pair)})" for pair in mapping.items())


def calendar_yoy(rows: str) -> str:
    return f"""
        SELECT c.series_id, c.month_end, c.value, 100 * (c.value - p.value) / nullif(p.value, 0) AS yoy
        FROM {rows} c LEFT JOIN {rows} p
             ON p.series_id = c.series_id AND p.month_end = last_day(c.month_end - INTERVAL 12 MONTH)"""


def complete_row_yoy(series) -> str:
    return f"""
        SELECT series_id, month_end, value,
               100 * (value - lag(value, 12) OVER w) / nullif(lag(value, 12) OVER w, 0) AS yoy
        FROM economy
        WHERE series_id IN ({sql_list(series)})
              AND month_end IN (SELECT month_end FROM economy WHERE series_id IN ({sql_list(series)})
                                GROUP BY month_end HAVING count(value) = {len(series)})
        WINDOW w AS (PARTITION BY series_id ORDER BY month_end)"""


def figures_sql(figures: dict[str, str]) -> str:
    return f"""
        SELECT figure, month_end, round(value, 4) AS value, round(yoy, 6) AS yoy
        FROM shown JOIN (VALUES {values(figures)}) f(figure, series_id) USING (series_id)"""


def variables_sql(levels: dict[str, str], changes: dict[str, str] | None = None, source: str = "shown") -> str:
    text = f"""
        SELECT label AS series_id, month_end, value
        FROM {source} JOIN (VALUES {values(levels)}) f(series_id, label) USING (series_id)"""
    if changes:
        text += f"""
        UNION ALL
        SELECT label, month_end, yoy
        FROM {source} JOIN (VALUES {values(changes)}) f(series_id, label) USING (series_id)"""
    return text


CORRELATION = MATRIX.format(panel="vars", r=f"round({PEARSON}, 6)")
SHOWN = f"SELECT * FROM changed WHERE {RANGE}"
SINCE = f"SELECT * FROM economy WHERE month_end >= DATE '{EPOCH}'"


# --- oil -----------------------------------------------------------------------


def _oil(spark, sf_dir):
    return plans.oil_report(views.economy(spark, sf_dir), START, END)


OIL = {"changed": complete_row_yoy(names.OIL_SERIES), "shown": SHOWN}


@query("report_oil", sql("economy", figures_sql(names.OIL_FIGURES), **OIL))
def report_oil(spark, sf_dir):
    return figure_lines(_oil(spark, sf_dir)["figures"])


@query(
    "report_oil_latest",
    sql(
        "economy",
        f"""SELECT label AS area, round(arg_max(value, month_end), 4) AS production
            FROM shown JOIN (VALUES {values(names.OIL_REGIONS)}) f(series_id, label) USING (series_id) GROUP BY label""",
        **OIL,
    ),
)
def report_oil_latest(spark, sf_dir):
    return _oil(spark, sf_dir)["latest_by_region"].withColumn("production", rounded("production", 4))


@query(
    "report_oil_bounds",
    sql(
        "economy",
        f"""SELECT series_id, round(min(yoy), 6) AS low, round(max(yoy), 6) AS high FROM shown
            WHERE series_id IN ({sql_list(names.OIL_FIGURES.values())}) GROUP BY series_id""",
        **OIL,
    ),
)
def report_oil_bounds(spark, sf_dir):
    bounds = _oil(spark, sf_dir)["change_bounds"]
    return bounds.withColumns({"low": rounded("low", 6), "high": rounded("high", 6)})


@query(
    "report_oil_correlation",
    sql("economy", CORRELATION, **OIL, vars=variables_sql(names.OIL_LEVEL_VARIABLES, names.OIL_CHANGE_VARIABLES)),
)
def report_oil_correlation(spark, sf_dir):
    return matrix(_oil(spark, sf_dir)["correlation"])


@query(
    "report_date_bounds",
    sql(
        "economy",
        f"""SELECT 'oil' AS report, min(month_end) AS first_date, max(month_end) AS last_date FROM changed
            UNION ALL
            SELECT 'employment', min(month_end), max(month_end) FROM economy
            WHERE month_end >= DATE '{EPOCH}'
                  AND series_id IN ({sql_list(names.EMPLOYEE_SERIES + names.LABOUR_RATE_SERIES)})""",
        changed=OIL["changed"],
    ),
)
def report_date_bounds(spark, sf_dir):
    """The dates a reader can choose from, whatever range is shown."""
    parts = [
        outputs["date_bounds"].select(F.lit(name).alias("report"), "first_date", "last_date")
        for name, outputs in (("oil", _oil(spark, sf_dir)), ("employment", _employment(spark, sf_dir)))
    ]
    return parts[0].union(parts[1])


# --- fuel ----------------------------------------------------------------------


def _fuel(spark, sf_dir):
    return plans.fuel_report(views.economy(spark, sf_dir), START, END)


FUEL = {"changed": complete_row_yoy(names.FUEL_SERIES), "shown": SHOWN}
REGION_STATES = {state: region for region, states in names.FUEL_REGION_STATES.items() for state in states}


@query(
    "report_gas",
    sql(
        "economy",
        f"""SELECT region, state, month_end, round(price, 4) AS price, yoy,
                   concat(' ', CASE WHEN month_end IS NULL THEN '0' ELSE coalesce(CAST(yoy AS VARCHAR), 'nan') END, '%')
                   AS change_card,
                   printf('%s: $%.2f', region, round_even(price, 2)) AS marker_text
            FROM (SELECT region, max(month_end) AS month_end, coalesce(arg_max(value, month_end), 0) AS price,
                         CASE WHEN max(month_end) IS NULL THEN 0 ELSE round_even(arg_max_null(yoy, month_end), 2) END
                         AS yoy
                  FROM (VALUES {values(names.FUEL_REGIONS)}) f(region, series_id) LEFT JOIN shown USING (series_id)
                  GROUP BY region)
                 JOIN (VALUES {values(REGION_STATES)}) s(state, region) USING (region)""",
        **FUEL,
    ),
)
def report_gas(spark, sf_dir):
    """The map: every state with its region's last price and change."""
    rows = _fuel(spark, sf_dir)["latest_by_state"]
    return rows.select(
        "region", "state", "month_end", rounded("price", 4).alias("price"), "yoy", "change_card", "marker_text"
    )


@query(
    "report_gas_history",
    sql(
        "economy",
        f"""SELECT label, month_end, round(value, 4) AS value, round(yoy, 6) AS yoy
            FROM shown JOIN (VALUES {values({**names.FUEL_REGIONS, 'USA': names.FUEL_NATIONAL})}) f(label, series_id)
                 USING (series_id)""",
        **FUEL,
    ),
)
def report_gas_history(spark, sf_dir):
    outputs = _fuel(spark, sf_dir)
    both = outputs["region_history"].unionByName(outputs["national_history"])
    return both.select("label", "month_end", rounded("value", 4).alias("value"), rounded("yoy", 6).alias("yoy"))


@query(
    "report_gas_national",
    sql(
        "economy",
        f"""SELECT month_end, price, yoy,
                   concat(' $', CASE WHEN month_end IS NULL THEN '0' ELSE CAST(price AS VARCHAR) END) AS price_card,
                   concat(' ', CASE WHEN month_end IS NULL THEN '0' ELSE coalesce(CAST(yoy AS VARCHAR), 'nan') END, '%')
                   AS change_card,
                   printf('USA Avg: $%.2f', price) AS marker_text
            FROM (SELECT max(month_end) AS month_end, coalesce(round_even(arg_max(value, month_end), 2), 0) AS price,
                         CASE WHEN max(month_end) IS NULL THEN 0 ELSE round_even(arg_max_null(yoy, month_end), 2) END
                         AS yoy
                  FROM shown WHERE series_id = '{names.FUEL_NATIONAL}')""",
        **FUEL,
    ),
)
def report_gas_national(spark, sf_dir):
    return _fuel(spark, sf_dir)["national_card"].select(
        "month_end", "price", "yoy", "price_card", "change_card", "marker_text"
    )


# --- price ---------------------------------------------------------------------


def _price(spark, sf_dir):
    return plans.price_report(views.economy(spark, sf_dir), START, END, epoch=EPOCH)


IN_DOLLARS = f"""
    SELECT series_id, month_end,
           CASE WHEN series_id IN ({sql_list(names.PRICES_IN_CENTS)}) THEN round_even(value / 100, 2) ELSE value END AS value
    FROM economy WHERE month_end >= DATE '{EPOCH}'"""
PRICE = {"cut": IN_DOLLARS, "changed": calendar_yoy("cut"), "shown": SHOWN}
PRICE_FIGURES = {s: s for s in names.PRICE_FIGURES + names.CPI_FIGURES}


@query("report_price", sql("economy", figures_sql(PRICE_FIGURES), **PRICE))
def report_price(spark, sf_dir):
    return figure_lines(_price(spark, sf_dir)["figures"])


@query(
    "report_price_inflation",
    sql(
        "economy",
        f"SELECT month_end, round(value, 6) AS value FROM shown WHERE series_id = '{names.INFLATION}'",
        **PRICE,
    ),
)
def report_price_inflation(spark, sf_dir):
    return _price(spark, sf_dir)["inflation"].withColumn("value", rounded("value", 6))


@query("report_price_correlation", sql("economy", CORRELATION, **PRICE, vars=variables_sql(names.PRICE_VARIABLES)))
def report_price_correlation(spark, sf_dir):
    return matrix(_price(spark, sf_dir)["correlation"])


def bounds_sql(series, source: str = "shown") -> str:
    return f"""SELECT series_id, round(min(yoy), 6) AS low, round(max(yoy), 6) AS high
               FROM {source} WHERE series_id IN ({sql_list(series)}) GROUP BY series_id"""


def _bounds(outputs):
    return outputs["change_bounds"].withColumns({c: rounded(c, 6) for c in ("low", "high")})


@query("report_price_bounds", sql("economy", bounds_sql(PRICE_FIGURES), **PRICE))
def report_price_bounds(spark, sf_dir):
    return _bounds(_price(spark, sf_dir))


# --- employment ----------------------------------------------------------------


def _employment(spark, sf_dir):
    return plans.employment_report(views.economy(spark, sf_dir), START, END, epoch=EPOCH)


EMPLOYMENT = {"cut": SINCE, "changed": calendar_yoy("cut"), "shown": SHOWN}
EMPLOYMENT_FIGURES = {s: s for s in names.EMPLOYEE_SERIES + names.LABOUR_RATE_SERIES}


@query("report_employment", sql("economy", figures_sql(EMPLOYMENT_FIGURES), **EMPLOYMENT))
def report_employment(spark, sf_dir):
    return figure_lines(_employment(spark, sf_dir)["figures"])


@query(
    "report_employment_correlation",
    sql("economy", CORRELATION, **EMPLOYMENT, vars=variables_sql(names.EMPLOYMENT_VARIABLES)),
)
def report_employment_correlation(spark, sf_dir):
    return matrix(_employment(spark, sf_dir)["correlation"])


@query("report_employment_bounds", sql("economy", bounds_sql(EMPLOYMENT_FIGURES), **EMPLOYMENT))
def report_employment_bounds(spark, sf_dir):
    return _bounds(_employment(spark, sf_dir))


# --- industrial ----------------------------------------------------------------


def _industrial(spark, sf_dir):
    return plans.industrial_report(views.economy(spark, sf_dir), START, END, epoch=EPOCH, base_month=BASE_MONTH)


INDUSTRIAL = {
    "rebased": f"""
        SELECT e.series_id, e.month_end,
               CASE WHEN e.series_id IN ({sql_list(names.PRICE_ADJUSTED)}) THEN e.value * (i.value / b.value)
                    ELSE e.value END AS value
        FROM economy e LEFT JOIN economy i ON i.series_id = 'cpi_all' AND i.month_end = e.month_end,
             (SELECT value FROM economy WHERE series_id = 'cpi_all' AND month_end = DATE '{BASE_MONTH}') b
        WHERE e.month_end >= DATE '{EPOCH}'""",
    "changed": calendar_yoy("rebased"),
    "shown": SHOWN,
    "output": f"""
        SELECT * FROM shown
        WHERE series_id IN ('all_output', {sql_list(names.OUTPUT_LABELS)})
              AND month_end IN (SELECT month_end FROM shown
                                WHERE series_id IN ({sql_list(names.OUTPUT_LABELS)})
                                      OR (series_id = 'all_output' AND yoy IS NOT NULL)
                                GROUP BY month_end HAVING count(value) = 12)""",
}
INDUSTRIAL_TOTALS = {
    "orders_total": names.ORDERS_TOTAL,
    "housing_total": names.HOUSING_TOTAL,
    "manufacturing_employment": "manufact_employee",
}


@query(
    "report_industrial",
    sql(
        "economy",
        figures_sql(INDUSTRIAL_TOTALS)
        + """
        UNION ALL
        SELECT 'output_total', month_end, round(value, 4), round(yoy, 6) FROM output WHERE series_id = 'all_output'""",
        **INDUSTRIAL,
    ),
)
def report_industrial(spark, sf_dir):
    outputs = _industrial(spark, sf_dir)
    return figure_lines(outputs["figures"].unionByName(outputs["output_total"]))


@query(
    "report_industrial_bounds",
    sql(
        "economy",
        bounds_sql(INDUSTRIAL_TOTALS.values()) + " UNION ALL " + bounds_sql([names.OUTPUT_TOTAL], "output"),
        **INDUSTRIAL,
    ),
)
def report_industrial_bounds(spark, sf_dir):
    return _bounds(_industrial(spark, sf_dir))


@query(
    "report_industrial_categories",
    sql(
        "economy",
        " UNION ALL ".join(
            f"""SELECT '{name}' AS figure, label, month_end, round(value, 4) AS value
                FROM {source} JOIN (VALUES {values(labels)}) f(series_id, label) USING (series_id)"""
            for name, source, labels in (
                ("output_by_category", "output", names.OUTPUT_LABELS),
                ("orders_by_category", "shown", names.ORDERS_LABELS),
                ("housing_by_region", "shown", names.HOUSING_LABELS),
            )
        ),
        **INDUSTRIAL,
    ),
)
def report_industrial_categories(spark, sf_dir):
    outputs = _industrial(spark, sf_dir)
    parts = [
        outputs[name].select(F.lit(name).alias("figure"), "label", "month_end", rounded("value", 4).alias("value"))
        for name in ("output_by_category", "orders_by_category", "housing_by_region")
    ]
    return union_panels(*parts)


@query(
    "report_industrial_correlation",
    sql(
        "economy",
        CORRELATION,
        **INDUSTRIAL,
        vars=variables_sql(names.INDUSTRIAL_LEVEL_VARIABLES, names.INDUSTRIAL_CHANGE_VARIABLES),
    ),
)
def report_industrial_correlation(spark, sf_dir):
    return matrix(_industrial(spark, sf_dir)["correlation"])


# --- correlation ---------------------------------------------------------------


def _correlation(spark, sf_dir, pair=None):
    return plans.correlation_report(
        views.economy(spark, sf_dir), monthly_last(views.market_quotes(spark, sf_dir)), START, END, pair=pair
    )


MARKETS = {
    "last_quotes": """
        SELECT ticker AS series_id, last_day(trade_date) AS month_end, arg_max(close, trade_date) AS value
        FROM market_quotes GROUP BY ALL""",
    "merged": f"""
        SELECT label AS series_id, month_end, value
        FROM last_quotes JOIN (VALUES {values(names.TICKER_LABELS)}) f(series_id, label) USING (series_id)
        UNION ALL {variables_sql(names.MACRO_VARIABLES, source='economy')}""",
    "vars": f"""
        SELECT * FROM merged
        WHERE {RANGE} AND month_end IN (SELECT month_end FROM last_quotes)
              AND month_end IN (SELECT month_end FROM economy)""",
}


@query("report_correlation", sql("economy market_quotes", CORRELATION, **MARKETS))
def report_correlation(spark, sf_dir):
    return matrix(_correlation(spark, sf_dir)["correlation"])


PAIR_DETAIL = {
    **MARKETS,
    "pair": f"""
        SELECT month_end, max(value) FILTER (WHERE series_id = '{PAIR[0]}') AS x,
               max(value) FILTER (WHERE series_id = '{PAIR[1]}') AS y
        FROM vars WHERE series_id IN ({sql_list(PAIR)}) GROUP BY ALL""",
}


@query(
    "report_pair_rolling",
    sql(
        "economy market_quotes",
        f"""SELECT '{PAIR[0]}' AS var_a, '{PAIR[1]}' AS var_b, month_end,
                   CASE WHEN count(x + y) OVER w = 12 THEN round(corr(x, y) OVER w, 6) END AS rolling_corr,
                   CASE WHEN count(x + y) OVER w = 12 THEN round(regr_slope(ln(y), ln(x)) OVER w, 6) END AS rolling_beta
            FROM pair WINDOW w AS (ORDER BY year(month_end) * 12 + month(month_end)
                                   RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)""",
        **PAIR_DETAIL,
    ),
)
def report_pair_rolling(spark, sf_dir):
    rows = _correlation(spark, sf_dir, PAIR)["pair_rolling"]
    return rows.withColumns({c: rounded(c, 6) for c in ("rolling_corr", "rolling_beta")})


@query(
    "report_pair_trendline",
    sql(
        "economy market_quotes",
        f"""SELECT '{PAIR[0]}' AS var_a, '{PAIR[1]}' AS var_b, round(x, 4) AS x, round(intercept + slope * x, 2) AS y
            FROM (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, unnest([min(x), max(x)]) AS x
                  FROM pair)""",
        **PAIR_DETAIL,
    ),
)
def report_pair_trendline(spark, sf_dir):
    line = _correlation(spark, sf_dir, PAIR)["pair_trendline"]
    return line.withColumns({"x": rounded("x", 4), "y": rounded("y", 2)})


@query(
    "report_pair",
    sql(
        "economy market_quotes",
        f"""SELECT '{PAIR[0]}' AS var_a, '{PAIR[1]}' AS var_b, month_end, round(x, 4) AS x, round(y, 4) AS y FROM pair""",
        **PAIR_DETAIL,
    ),
)
def report_pair(spark, sf_dir):
    rows = _correlation(spark, sf_dir, PAIR)["pair"]
    return rows.withColumns({c: rounded(c, 4) for c in "xy"})


@query(
    "report_pair_fit",
    sql(
        "economy market_quotes",
        f"""SELECT '{PAIR[0]}' AS var_a, '{PAIR[1]}' AS var_b, count(x + y) AS n,
                   round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept
            FROM pair""",
        **PAIR_DETAIL,
    ),
)
def report_pair_fit(spark, sf_dir):
    fit = _correlation(spark, sf_dir, PAIR)["pair_fit"]
    return fit.withColumns({"slope": rounded("slope", 4), "intercept": rounded("intercept", 2)})


@query(
    "report_pair_ranges",
    sql(
        "economy market_quotes",
        f"""SELECT '{PAIR[0]}' AS var_a, '{PAIR[1]}' AS var_b, measure, round(max(abs(v)), 5) AS half_range
            FROM (SELECT CASE WHEN count(x + y) OVER w = 12 THEN corr(x, y) OVER w END AS rolling_corr,
                         CASE WHEN count(x + y) OVER w = 12 THEN regr_slope(ln(y), ln(x)) OVER w END AS rolling_beta
                  FROM pair WINDOW w AS (ORDER BY year(month_end) * 12 + month(month_end)
                                         RANGE BETWEEN 11 PRECEDING AND CURRENT ROW))
                 UNPIVOT INCLUDE NULLS (v FOR measure IN (rolling_corr, rolling_beta))
            GROUP BY measure""",
        **PAIR_DETAIL,
    ),
)
def report_pair_ranges(spark, sf_dir):
    """Half-widths of the axes of both rolling measures."""
    outputs = _correlation(spark, sf_dir, PAIR)
    rows = [outputs[f"pair_{m}_range"].withColumn("measure", F.lit(f"rolling_{m}")) for m in ("corr", "beta")]
    both = rows[0].unionByName(rows[1])
    return both.select("var_a", "var_b", "measure", rounded("half_range", 5).alias("half_range"))


# --- recent --------------------------------------------------------------------


def _recent(spark, sf_dir):
    return plans.recent_report(views.economy(spark, sf_dir), epoch=EPOCH, correlation_epoch=START)


@query(
    "report_recent",
    sql(
        "economy",
        """SELECT from_month, to_month, round(midpoint, 6) AS midpoint,
                  round((midpoint + 6) / nullif(max(greatest(yoy, to_yoy)) OVER () + 6, 0), 6) AS position,
                  strftime(from_month, '%m-%Y') AS from_label
           FROM (SELECT *, (yoy + to_yoy) / 2 AS midpoint FROM segments WHERE to_month IS NOT NULL)""",
        changed=calendar_yoy("economy"),
        segments=f"""
            SELECT month_end AS from_month, yoy, lead(month_end) OVER w AS to_month, lead(yoy) OVER w AS to_yoy
            FROM changed
            WHERE series_id = '{names.OIL_TOTAL}' AND yoy IS NOT NULL
                  AND month_end > last_day((SELECT max(month_end) FROM economy) - INTERVAL 37 MONTH)
            WINDOW w AS (ORDER BY month_end)""",
    ),
)
def report_recent(spark, sf_dir):
    """The last 37 months of the yearly change of oil production, as segments."""
    rows = _recent(spark, sf_dir)["oil_change_segments"]
    return rows.select(
        "from_month",
        "to_month",
        rounded("midpoint", 6).alias("midpoint"),
        rounded("position", 6).alias("position"),
        "from_label",
    )


@query(
    "report_recent_correlation",
    sql(
        "economy",
        f"""SELECT 'all' AS months, * FROM ({MATRIX.format(panel='every', r=f'round_even({PEARSON}, 2)')})
            UNION ALL
            SELECT 'recent', * FROM ({MATRIX.format(panel='late', r=f'round({PEARSON}, 6)')})""",
        every=variables_sql(names.CORE_VARIABLES, source="economy"),
        late=f"SELECT * FROM every WHERE month_end >= DATE '{START}'",
    ),
)
def report_recent_correlation(spark, sf_dir):
    outputs = _recent(spark, sf_dir)
    every = outputs["correlation"].withColumn("months", F.lit("all"))
    return every.unionByName(matrix(outputs["recent_correlation"]).withColumn("months", F.lit("recent")))


@query(
    "report_recent_lines",
    sql(
        "economy",
        " UNION ALL ".join(
            f"""SELECT '{name}' AS figure, series_id, month_end, round(value, 4) AS value FROM economy
                WHERE month_end >= DATE '{EPOCH}' AND series_id IN ({sql_list(series)})"""
            for name, series in (
                ("spending_and_staff", names.SPENDING_AND_STAFF),
                ("oil_production", names.OIL_PRODUCTION_LINES),
                ("oil_exports", names.OIL_EXPORT_LINES),
            )
        ),
    ),
)
def report_recent_lines(spark, sf_dir):
    outputs = _recent(spark, sf_dir)
    parts = [
        outputs[name].select(F.lit(name).alias("figure"), "series_id", "month_end", rounded("value", 4).alias("value"))
        for name in ("spending_and_staff", "oil_production", "oil_exports")
    ]
    return union_panels(*parts)
