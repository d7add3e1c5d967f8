"""Queries on rows that are not tidy: one-day treatments, missing starts, NaN, types, segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.catalog.base import register, table
from trialframe.catalog.curves import BROKEN, BROKEN_FITS, GUESSES, broken_cells
from trialframe.catalog.standins import DAY_SQL, RESPONSES, f_p_sql, lineitem, observations_sql, t_crit_sql
from trialframe.operators import cleaning
from trialframe.operators import curves as C
from trialframe.operators import linear as L
from trialframe.operators import means as M
from trialframe.operators.cells import cell_stats, line_moments
from trialframe.session import materialize

# Return flag N has all its rows on one day.
_ONE_DAY_SQL = f"CASE WHEN l_returnflag = 'N' THEN 400 ELSE {DAY_SQL} END"
_ONE_DAY = f"""obs AS ({observations_sql('l_returnflag', _ONE_DAY_SQL)}),
lines AS (SELECT family, treatment, count(*) AS n, avg(x) AS x_mean, avg(y) AS y_mean, regr_sxx(y, x) AS sxx, count(DISTINCT x) > 1 AS sloped,
 CASE WHEN count(DISTINCT x) > 1 THEN regr_slope(y, x) END AS slope, CASE WHEN count(DISTINCT x) > 1 THEN regr_intercept(y, x) END AS intercept
 FROM obs GROUP BY family, treatment),
own AS (SELECT o.family, o.treatment, o.x, o.y, CASE WHEN sloped THEN intercept + slope * x ELSE y_mean END AS own, y_mean, x_mean
 FROM obs o JOIN lines l ON o.family = l.family AND o.treatment = l.treatment),
ranks AS (SELECT family, count(*) AS k, count(*) FILTER (sloped) AS m FROM lines GROUP BY family),
pooled AS (SELECT o.family, sum((y - own) ** 2) AS rss, CAST(count(*) - any_value(k) - any_value(m) AS BIGINT) AS df,
 sqrt(sum((y - own) ** 2) / (count(*) - any_value(k) - any_value(m))) AS sigma FROM own o JOIN ranks r ON o.family = r.family GROUP BY o.family)"""


def one_day_lines(spark, folder):
    day = F.when(F.col("l_returnflag") == "N", 400).otherwise(F.col("day"))
    return materialize(line_moments(lineitem(spark, folder), RESPONSES, day, "l_returnflag"))


@register(
    "ancova_fit_one_day",
    exact=["family", "treatment", "n", "df"],
    sig=["slope", "intercept", "rss", "sigma"],
    sql=f"WITH {_ONE_DAY} SELECT family, treatment, n, df, slope, intercept, rss, sigma FROM lines JOIN pooled USING (family)",
)
def ancova_fit_one_day_query(spark, folder):
    return L.ancova_fit(one_day_lines(spark, folder))


@register(
    "trend_slopes_one_day",
    exact=["family", "treatment", "df"],
    sig=["slope", "se", "lower", "upper"],
    sql=f"""WITH {_ONE_DAY}, s AS (SELECT family, treatment, slope, CASE WHEN sloped THEN sigma / sqrt(sxx) END AS se, df FROM lines JOIN pooled USING (family))
SELECT *, slope - {t_crit_sql('df')} * se AS lower, slope + {t_crit_sql('df')} * se AS upper FROM s""",
)
def trend_slopes_one_day_query(spark, folder):
    return M.trend_slopes(one_day_lines(spark, folder))


@register(
    "anova_ancova_one_day",
    exact=["family", "term_order", "term", "df"],
    sig=["ss", "ms", "f"],
    prob=["p"],
    sql=f"""WITH {_ONE_DAY},
m AS (SELECT family, avg(y) AS my, count(*) AS n FROM obs GROUP BY family),
common AS (SELECT family, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM obs GROUP BY family),
w AS (SELECT family, sum((x - x_mean) * (y - y_mean)) / sum((x - x_mean) * (x - x_mean)) AS wb FROM own GROUP BY family),
ss AS (SELECT o.family, sum((a + b * x - my) ** 2) AS ssx, sum((y_mean + wb * (x - x_mean) - a - b * x) ** 2) AS sst,
 sum((own - y_mean - wb * (x - x_mean)) ** 2) AS ssi, sum((y - own) ** 2) AS rss
 FROM own o JOIN m ON o.family = m.family JOIN common c ON o.family = c.family JOIN w ON o.family = w.family GROUP BY o.family),
long AS (SELECT ss.family, term_order, term, CAST(df AS BIGINT) AS df, ss, ss / df AS ms, CAST(n - k - r.m AS BIGINT) AS rdf, rss / (n - k - r.m) AS ems
 FROM ss JOIN m ON ss.family = m.family JOIN ranks r ON ss.family = r.family CROSS JOIN LATERAL (VALUES (1, 'x', 1, ssx), (2, 'treatment', k - 1, sst),
 (3, 'x:treatment', r.m - 1, ssi), (4, 'residual', n - k - r.m, rss)) AS v(term_order, term, df, ss)),
tested AS (SELECT *, CASE WHEN term_order < 4 THEN ms / ems END AS f FROM long)
SELECT *, CASE WHEN f IS NOT NULL THEN {f_p_sql('f', 'df', 'rdf')} END AS p FROM tested""",
)
def anova_ancova_one_day_query(spark, folder):
    return L.anova_ancova(one_day_lines(spark, folder))


@register(
    "segmented_fit_missing_start",
    exact=["family", "treatment", "n", "converged", "status"],
    sig=["start", "slope", "turn", "brk", "rss", "sigma"],
    sql=f"""WITH {BROKEN}, {BROKEN_FITS},
sizes AS (SELECT family, treatment, count(*) AS n FROM obs GROUP BY family, treatment)
SELECT s.family, s.treatment, s.n, s.treatment <> 'view' AS converged, CASE WHEN s.treatment = 'view' THEN 'no start' ELSE 'converged' END AS status,
 CASE WHEN s.treatment <> 'view' THEN start END AS start, CASE WHEN s.treatment <> 'view' THEN slope END AS slope,
 CASE WHEN s.treatment <> 'view' THEN turn END AS turn, CASE WHEN s.treatment <> 'view' THEN brk END AS brk,
 CASE WHEN s.treatment <> 'view' THEN rss END AS rss, CAST(NULL AS DOUBLE) AS sigma
FROM sizes s JOIN fits f ON s.family = f.family AND s.treatment = f.treatment""",
)
def segmented_fit_missing_start_query(spark, folder):
    """A treatment without a first guess: its row stays, and the family's error is unknown."""
    guesses = {k: v for k, v in GUESSES.items() if k != "view"}
    fits = C.segmented_fit(broken_cells(spark, folder), guesses).withColumnRenamed("break", "brk")
    return fits.join(C.curve_error(fits).select("family", "sigma"), "family")


@register(
    "cell_stats_segmented",
    exact=["family", "treatment", "x", "n"],
    sig=["mean", "ss"],
    sql="""WITH obs AS (SELECT 'quantity:' || l_returnflag AS family, l_linestatus AS treatment, l_linenumber AS x, CAST(l_quantity AS DOUBLE) AS y FROM lineitem
UNION ALL SELECT 'price:' || l_returnflag, l_linestatus, l_linenumber, CAST(l_extendedprice AS DOUBLE) FROM lineitem)
SELECT family, treatment, x, count(*) AS n, avg(y) AS mean, var_pop(y) * count(*) AS ss FROM obs GROUP BY family, treatment, x""",
)
def cell_stats_segmented_query(spark, folder):
    responses = {"quantity": "l_quantity", "price": "l_extendedprice"}
    return cell_stats(table(spark, folder, "lineitem"), responses, "l_linestatus", "l_linenumber", segment="l_returnflag")


@register(
    "cell_stats_nan",
    exact=["family", "treatment", "x", "n"],
    sig=["mean", "ss"],
    sql="""SELECT 'value' AS family, event_type AS treatment, CAST(day(ts) AS INTEGER) AS x, count(value) AS n, avg(value) AS mean,
 var_pop(value) * count(value) AS ss FROM events WHERE user_id % 7 <> 0 GROUP BY ALL""",
)
def cell_stats_nan_query(spark, folder):
    """NaN in a seventh of the rows counts as missing."""
    value = F.when(F.col("user_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return cell_stats(table(spark, folder, "events"), {"value": value}, "event_type", F.dayofmonth("ts"))


@register(
    "duplicate_mask_types",
    exact=["o_orderkey", "priority", "large"],
    sql="""WITH o AS (SELECT o_orderkey, o_orderpriority AS priority, 9007199254740992 + o_custkey AS large FROM orders)
SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY priority ORDER BY o_orderkey) = 1 THEN priority END AS priority,
 CASE WHEN row_number() OVER (PARTITION BY large ORDER BY o_orderkey) = 1 THEN CAST(large AS VARCHAR) END AS large FROM o""",
)
def duplicate_mask_types_query(spark, folder):
    """A text column, and whole numbers beyond what a double tells apart."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("priority"),
        (F.lit(9007199254740992) + F.col("o_custkey")).alias("large"),
    )
    masked = cleaning.duplicate_mask(orders, ["priority", "large"], "o_orderkey")
    return masked.withColumn("large", F.col("large").cast("string"))
