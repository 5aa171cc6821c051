"""Changes, rolling measures and statistics of pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.panel_queries import COMPLETE, COMPLETE_SERIES, money, monthly, monthly_region, monthly_sparse
from checks.registry import query, rounded
from checks.views import EPOCH, sql
from monthloom.operators import panel, stats, windows
from monthloom.operators.filters import last_rows

YOY = """
    SELECT c.series_id, c.month_end, round(100 * (c.value - p.value) / nullif(p.value, 0), 6) AS yoy
    FROM {rows} c LEFT JOIN {rows} p
         ON p.series_id = c.series_id AND p.month_end = last_day(c.month_end - INTERVAL 12 MONTH)"""


def _yoy(frame):
    return frame.select("series_id", "month_end", rounded("yoy", 6).alias("yoy"))


@query("yoy_calendar", sql("monthly_sparse", YOY.format(rows="monthly_sparse")))
def yoy_calendar(spark, sf_dir):
    return _yoy(windows.yoy_calendar(monthly_sparse(spark, sf_dir)))


@query(
    "yoy_rows",
    sql(
        "monthly_sparse",
        """SELECT series_id, month_end,
                  round(100 * (value - lag(value, 12) OVER w) / nullif(lag(value, 12) OVER w, 0), 6) AS yoy
           FROM complete WINDOW w AS (PARTITION BY series_id ORDER BY month_end)""",
        complete=COMPLETE,
    ),
)
def yoy_rows(spark, sf_dir):
    complete = panel.complete_cases(monthly_sparse(spark, sf_dir), COMPLETE_SERIES)
    return _yoy(windows.yoy_rows(complete))


@query(
    "yoy_after_epoch",
    sql(
        "monthly_sparse",
        YOY.format(rows="cut"),
        cut=f"SELECT * FROM monthly_sparse WHERE month_end >= DATE '{EPOCH}'",
    ),
)
def yoy_after_epoch(spark, sf_dir):
    rows = panel.monthly_mean(views.obs_sparse(spark, sf_dir), EPOCH)
    return _yoy(windows.yoy_after_epoch(rows, EPOCH))


@query(
    "yoy_all_series",
    sql(
        "monthly_sparse monthly monthly_region",
        """SELECT series_id, month_end,
                  round(100 * (value - before) / nullif(before, 0), 6) AS yoy
           FROM (SELECT *, first_value(value) OVER (
                     PARTITION BY series_id ORDER BY year(month_end) * 12 + month(month_end)
                     RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING) AS before
                 FROM every)""",
        every="""SELECT * FROM monthly_sparse UNION ALL SELECT * FROM monthly UNION ALL SELECT * FROM monthly_region""",
    ),
)
def yoy_all_series(spark, sf_dir):
    """Every series of three sources in one pass."""
    every = panel.union_panels(monthly_sparse(spark, sf_dir), monthly(spark, sf_dir), monthly_region(spark, sf_dir))
    return _yoy(windows.yoy_calendar(every))


LAST_YEAR = """WINDOW w AS (PARTITION BY {keys} ORDER BY year(month_end) * 12 + month(month_end)
                            RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)"""


@query(
    "rolling_mean",
    sql(
        "monthly",
        """SELECT series_id, month_end, CASE WHEN count(value) OVER w = 12 THEN round(avg(value) OVER w, 4) END
                  AS rolling_mean
           FROM monthly """ + LAST_YEAR.format(keys="series_id"),
    ),
)
def rolling_mean(spark, sf_dir):
    rows = windows.rolling_mean(monthly(spark, sf_dir))
    return money(rows.select("series_id", "month_end", "rolling_mean"), "rolling_mean")


@query(
    "rolling_quarterly",
    sql(
        "obs",
        """SELECT series_id, month_end, count(value) OVER w AS months_held,
                  CASE WHEN count(value) OVER w = 12 THEN round(avg(value) OVER w, 4) END AS rolling_mean
           FROM quarterly """
        + LAST_YEAR.format(keys="series_id"),
        quarterly="""SELECT series_id, last_day(obs_date) AS month_end, avg(value) AS value
                     FROM obs WHERE month(obs_date) IN (1, 4, 7, 10) GROUP BY ALL""",
    ),
)
def rolling_quarterly(spark, sf_dir):
    """Quarterly series never fill a frame of twelve months."""
    quarterly = views.obs(spark, sf_dir).where(F.month("obs_date").isin(1, 4, 7, 10))
    rows = windows.rolling_count(windows.rolling_mean(panel.monthly_mean(quarterly)))
    return money(rows.select("series_id", "month_end", "months_held", "rolling_mean"), "rolling_mean")


PAIRS = (("1-urgent", "5-low"), ("2-high", "3-medium"))
PAIR_VIEW = """
    SELECT var_a, var_b, month_end, max(value) FILTER (WHERE series_id = var_a) AS x,
           max(value) FILTER (WHERE series_id = var_b) AS y
    FROM monthly JOIN (VALUES ('1-urgent', '5-low'), ('2-high', '3-medium')) p(var_a, var_b)
         ON series_id IN (var_a, var_b)
    GROUP BY ALL"""
PAIR_KEYS = ("var_a", "var_b", "month_end")


def _aligned(spark, sf_dir):
    return windows.align_pairs(monthly(spark, sf_dir), PAIRS)


@query(
    "pair_align",
    sql(
        "monthly",
        "SELECT var_a, var_b, month_end, round(x, 4) AS x, round(y, 4) AS y FROM pair",
        pair=PAIR_VIEW,
    ),
)
def pair_align(spark, sf_dir):
    return money(_aligned(spark, sf_dir), "x", "y")


@query(
    "rolling_moments",
    sql(
        "monthly",
        """SELECT var_a, var_b, month_end,
                  CASE WHEN count(x) OVER w = 12 THEN round(avg(x) OVER w, 4) END AS mean_x,
                  CASE WHEN count(y) OVER w = 12 THEN round(avg(y) OVER w, 4) END AS mean_y,
                  CASE WHEN count(x * y) OVER w = 12 THEN round(avg(x * y) OVER w, -4) END AS mean_xy,
                  CASE WHEN count(x * x) OVER w = 12 THEN round(avg(x * x) OVER w, -4) END AS mean_xx
           FROM pair """ + LAST_YEAR.format(keys="var_a, var_b"),
        pair=PAIR_VIEW,
    ),
)
def rolling_moments(spark, sf_dir):
    rows = windows.rolling_moments(_aligned(spark, sf_dir)).select(*PAIR_KEYS, "mean_x", "mean_y", "mean_xy", "mean_xx")
    rows = money(rows, "mean_x", "mean_y")
    return rows.withColumns({c: rounded(c, -4) for c in ("mean_xy", "mean_xx")})


CORR_SQL = """
    SELECT *, CASE WHEN count(CASE WHEN x IS NOT NULL THEN y END) OVER w = 12
                   THEN corr(x, y) OVER w END AS rolling_corr
    FROM pair """ + LAST_YEAR.format(keys="var_a, var_b")
BETA_SQL = """
    SELECT *, CASE WHEN count(CASE WHEN x IS NOT NULL THEN y END) OVER w = 12
                   THEN regr_slope(ln(y), ln(x)) OVER w END AS rolling_beta
    FROM pair """ + LAST_YEAR.format(keys="var_a, var_b")


@query(
    "rolling_corr",
    sql(
        "monthly",
        "SELECT var_a, var_b, month_end, round(rolling_corr, 6) AS rolling_corr FROM rolling",
        pair=PAIR_VIEW,
        rolling=CORR_SQL,
    ),
)
def rolling_corr(spark, sf_dir):
    rows = windows.rolling_corr(_aligned(spark, sf_dir))
    return rows.select(*PAIR_KEYS, rounded("rolling_corr", 6).alias("rolling_corr"))


@query(
    "rolling_beta",
    sql(
        "monthly",
        "SELECT var_a, var_b, month_end, round(rolling_beta, 6) AS rolling_beta FROM rolling",
        pair=PAIR_VIEW,
        rolling=BETA_SQL,
    ),
)
def rolling_beta(spark, sf_dir):
    rows = windows.rolling_beta(_aligned(spark, sf_dir))
    return rows.select(*PAIR_KEYS, rounded("rolling_beta", 6).alias("rolling_beta"))


@query(
    "symmetric_range",
    sql(
        "monthly",
        """SELECT var_a, var_b, round(greatest(abs(min(rolling_corr)), abs(max(rolling_corr))), 6) AS half_range
           FROM rolling GROUP BY ALL""",
        pair=PAIR_VIEW,
        rolling=CORR_SQL,
    ),
)
def symmetric_range(spark, sf_dir):
    rolling = windows.rolling_corr(_aligned(spark, sf_dir))
    rows = stats.symmetric_range(rolling, "rolling_corr", "var_a", "var_b")
    return rows.withColumn("half_range", rounded("half_range", 6))


FIT_SQL = """
    SELECT var_a, var_b, count(CASE WHEN x IS NOT NULL THEN y END) AS n, regr_slope(y, x) AS slope,
           regr_intercept(y, x) AS intercept, min(x) AS low, max(x) AS high
    FROM pair GROUP BY ALL"""


@query(
    "ols_fit",
    sql(
        "monthly",
        "SELECT var_a, var_b, n, round(slope, 6) AS slope, round(intercept, 2) AS intercept FROM fit",
        pair=PAIR_VIEW,
        fit=FIT_SQL,
    ),
)
def ols_fit(spark, sf_dir):
    fit = stats.ols_fit(_aligned(spark, sf_dir))
    return fit.withColumns({"slope": rounded("slope", 6), "intercept": rounded("intercept", 2)})


@query(
    "ols_trendline",
    sql(
        "monthly",
        """SELECT var_a, var_b, round(x, 4) AS x, round(intercept + slope * x, 2) AS y
           FROM (SELECT *, unnest([low, high]) AS x FROM fit)""",
        pair=PAIR_VIEW,
        fit=FIT_SQL,
    ),
)
def ols_trendline(spark, sf_dir):
    line = stats.ols_trendline(_aligned(spark, sf_dir))
    return line.withColumns({"x": rounded("x", 4), "y": rounded("y", 2)})


@query(
    "segment_midpoint",
    sql(
        "monthly",
        """SELECT series_id, month_end AS from_month, to_month, round((value + to_value) / 2, 4) AS midpoint
           FROM (SELECT *, lead(month_end) OVER w AS to_month, lead(value) OVER w AS to_value FROM tail
                 WINDOW w AS (PARTITION BY series_id ORDER BY month_end))
           WHERE to_month IS NOT NULL""",
        tail="SELECT * FROM monthly QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY month_end DESC) <= 37",
    ),
)
def segment_midpoint(spark, sf_dir):
    rows = windows.segment_midpoints(last_rows(monthly(spark, sf_dir), 37))
    return rows.select("series_id", "from_month", "to_month", rounded("midpoint", 4).alias("midpoint"))


@query(
    "measure_bounds",
    sql(
        "monthly",
        """SELECT series_id, round(min(value), 4) AS low, round(max(value), 4) AS high
           FROM monthly GROUP BY series_id""",
    ),
)
def measure_bounds(spark, sf_dir):
    return money(stats.measure_bounds(monthly(spark, sf_dir)), "low", "high")


MATRIX = """
    SELECT a.series_id AS var_a, b.series_id AS var_b, count(x.value + y.value) AS n,
           {r} AS r
    FROM (SELECT DISTINCT series_id FROM {panel} WHERE value IS NOT NULL) a
         JOIN (SELECT DISTINCT series_id FROM {panel} WHERE value IS NOT NULL) b ON a.series_id <= b.series_id
         LEFT JOIN {panel} x ON x.series_id = a.series_id
         LEFT JOIN {panel} y ON y.series_id = b.series_id AND y.month_end = x.month_end
    GROUP BY ALL"""
# The counterpart of a constant or single pair is no number, as here.
PEARSON = """CASE WHEN min(x.value) FILTER (y.value IS NOT NULL) < max(x.value) FILTER (y.value IS NOT NULL)
                   AND min(y.value) FILTER (x.value IS NOT NULL) < max(y.value) FILTER (x.value IS NOT NULL)
                  THEN corr(x.value, y.value) END"""


def _ten_series(spark, sf_dir):
    return panel.union_panels(monthly(spark, sf_dir), monthly_region(spark, sf_dir))


TEN = "SELECT * FROM monthly UNION ALL SELECT * FROM monthly_region"


@query(
    "corr_matrix",
    sql("monthly monthly_region", MATRIX.format(panel="ten", r=f"round({PEARSON}, 6)"), ten=TEN),
)
def corr_matrix(spark, sf_dir):
    matrix = stats.correlation_matrix(_ten_series(spark, sf_dir))
    return matrix.withColumn("r", rounded("r", 6))


@query(
    "corr_matrix_rounded",
    sql("monthly monthly_region", MATRIX.format(panel="ten", r=f"round_even({PEARSON}, 2)"), ten=TEN),
)
def corr_matrix_rounded(spark, sf_dir):
    return stats.rounded(stats.correlation_matrix(_ten_series(spark, sf_dir)))


@query(
    "corr_matrix_sparse",
    sql("monthly_sparse", MATRIX.format(panel="monthly_sparse", r=f"round({PEARSON}, 6)")),
)
def corr_matrix_sparse(spark, sf_dir):
    """Many series with gaps, dealt into several blocks."""
    matrix = stats.correlation_matrix(monthly_sparse(spark, sf_dir), block=32)
    return matrix.withColumn("r", rounded("r", 6))
