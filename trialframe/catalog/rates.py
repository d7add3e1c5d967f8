"""Windows, reshapes, domain formulas and chart-layer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.catalog.base import register, table
from trialframe.catalog.linear import DAY_OBS, LINES, OBS, day_lines, line_cells
from trialframe.catalog.means import MEANS
from trialframe.catalog.standins import DAY_SQL, lineitem
from trialframe.functions import scalar as S
from trialframe.operators import charts as V
from trialframe.operators import means as M
from trialframe.operators import rates as R
from trialframe.operators import reshape as P
from trialframe.operators import windows as W
from trialframe.operators.cells import cell_stats
from trialframe.session import materialize
from trialframe.sources import factor_grid


def event_means(spark, folder):
    """family = event type, treatment = half of the users, x = day of the month."""
    events = table(spark, folder, "events").withColumn("day", F.dayofmonth("ts"))
    half = F.when(F.col("user_id") % 2 == 0, "Cold").otherwise("Room")
    cells = cell_stats(events, {"": "value"}, half, "day", segment="event_type")
    return cells.select("family", "treatment", "x", F.col("mean").alias("value"))


EVENT_MEANS = """ev AS (SELECT event_type AS family, CASE WHEN user_id % 2 = 0 THEN 'Cold' ELSE 'Room' END AS treatment,
 CAST(day(ts) AS INTEGER) AS x, avg(value) AS value FROM events GROUP BY ALL)"""
RATES = f"""{EVENT_MEANS}, rates AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0.0 ELSE value - lag(value) OVER w END AS rate
 FROM ev WINDOW w AS (PARTITION BY family, treatment ORDER BY x))"""


@register(
    "daily_rate",
    exact=["family", "treatment", "x"],
    sig=["rate"],
    sql=f"WITH {RATES} SELECT * FROM rates",
)
def daily_rate_query(spark, folder):
    return W.daily_rate(event_means(spark, folder))


@register(
    "interval_loss",
    exact=["family", "treatment", "x"],
    sig=["loss"],
    sql=f"""WITH {EVENT_MEANS} SELECT family, treatment, x, lag(value) OVER (PARTITION BY family, treatment ORDER BY x) - value AS loss FROM ev""",
)
def interval_loss_query(spark, folder):
    return W.interval_loss(event_means(spark, folder))


@register(
    "running_interval",
    exact=["family", "treatment", "x"],
    sig=["gap", "elapsed"],
    sql=f"""WITH {EVENT_MEANS}, g AS (SELECT family, treatment, x, lead(x) OVER w - x AS gap FROM ev WINDOW w AS (PARTITION BY family, treatment ORDER BY x))
SELECT *, CASE WHEN gap IS NOT NULL THEN CAST(sum(gap) OVER (PARTITION BY family, treatment ORDER BY x) AS BIGINT) END AS elapsed FROM g""",
)
def running_interval_query(spark, folder):
    return W.running_interval(event_means(spark, folder))


@register(
    "accumulated_area",
    exact=["family", "treatment", "x"],
    sig=["running_value", "accumulated"],
    sql=f"""WITH {EVENT_MEANS}, g AS (SELECT *, lead(x) OVER w - x AS gap, sum(value * 0.035185) OVER w AS running_value
 FROM ev WINDOW w AS (PARTITION BY family, treatment ORDER BY x))
SELECT *, CASE WHEN gap IS NOT NULL THEN running_value * sum(gap) OVER (PARTITION BY family, treatment ORDER BY x) / 2 END AS accumulated FROM g""",
)
def accumulated_area_query(spark, folder):
    return W.accumulated_area(event_means(spark, folder), 0.035185, "value")


@register(
    "stage_window",
    exact=["family", "treatment", "start_x", "end_x"],
    sql=f"""WITH {EVENT_MEANS}, m AS (SELECT *, max(value) OVER (PARTITION BY family, treatment) AS top FROM ev)
SELECT family, treatment, min(x) FILTER (value >= top * 0.8) AS start_x, max(x) FILTER (value <= top * 0.7) AS end_x FROM m GROUP BY family, treatment""",
)
def stage_window_query(spark, folder):
    return W.stage_window(
        materialize(event_means(spark, folder)), start_share=0.8, end_share=0.7
    )


@register(
    "stage_window_raw",
    exact=["family", "start_x", "end_x"],
    sql="""WITH m AS (SELECT event_type AS family, event_id, value, max(value) OVER (PARTITION BY event_type) AS top FROM events)
SELECT family, min(event_id) FILTER (value >= top * 0.15) AS start_x, max(event_id) FILTER (value <= top * 0.85) AS end_x FROM m GROUP BY family""",
)
def stage_window_raw_query(spark, folder):
    """The same on raw rows: five groups hold the whole table, no group is sorted."""
    events = table(spark, folder, "events").select(
        F.col("event_type").alias("family"), F.col("event_id").alias("x"), "value"
    )
    return W.stage_window(events, keys=["family"])


@register(
    "relative_rate",
    exact=["family", "treatment", "x"],
    sig=["rate", "relative_rate"],
    sql=f"WITH {RATES} SELECT *, rate / max(rate) OVER (PARTITION BY family) AS relative_rate FROM rates WHERE rate > 0",
)
def relative_rate_query(spark, folder):
    return W.relative_rate(materialize(W.daily_rate(event_means(spark, folder))))


@register(
    "relative_allocation",
    exact=["family", "treatment", "x"],
    sig=["rate", "relative_allocation"],
    sql=f"WITH {RATES} SELECT *, rate / sum(rate) OVER (PARTITION BY x, treatment) AS relative_allocation FROM rates WHERE rate > 0",
)
def relative_allocation_query(spark, folder):
    return W.relative_allocation(materialize(W.daily_rate(event_means(spark, folder))))


@register(
    "predictions_long",
    exact=["o_orderkey", "family"],
    sig=["value"],
    sql="""SELECT o_orderkey, family, value FROM (SELECT o_orderkey, o_totalprice AS price, CAST(o_custkey AS DOUBLE) AS customer FROM orders)
UNPIVOT (value FOR family IN (price, customer))""",
)
def predictions_long_query(spark, folder):
    wide = table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").cast("double").alias("customer"),
    )
    return P.predictions_long(wide, ["o_orderkey"], ["price", "customer"])


@register(
    "treatment_contrast_wide",
    exact=["family", "x"],
    sig=["Cold", "Room", "ratio", "difference"],
    sql=f"""WITH {RATES}, w AS (SELECT family, x, max(CASE WHEN treatment = 'Cold' THEN rate END) AS Cold, max(CASE WHEN treatment = 'Room' THEN rate END) AS Room
 FROM rates WHERE rate > 0 GROUP BY family, x) SELECT *, Room / Cold AS ratio, Room - Cold AS difference FROM w""",
)
def treatment_contrast_wide_query(spark, folder):
    rates = W.daily_rate(event_means(spark, folder)).where(F.col("rate") > 0)
    return P.treatment_contrast_wide(rates, "Cold", "Room")


@register(
    "q10",
    exact=["family"],
    sig=["rate_low", "rate_high", "q10"],
    sql=f"""WITH {EVENT_MEANS}, r AS (SELECT family, avg(value) FILTER (treatment = 'Cold') AS rate_low, avg(value) FILTER (treatment = 'Room') AS rate_high FROM ev GROUP BY family)
SELECT *, pow(rate_high / rate_low, 10.0 / (25 - 5)) AS q10 FROM r""",
)
def q10_query(spark, folder):
    """Mean rate at the two storage temperatures, 5 and 25 degrees."""
    at = lambda t: F.avg(F.when(F.col("treatment") == t, F.col("value")))
    rates = event_means(spark, folder).groupBy("family").agg(
        at("Cold").alias("rate_low"), at("Room").alias("rate_high")
    )
    return rates.withColumn("q10", S.q10("rate_low", "rate_high", F.lit(5.0), F.lit(25.0)))


_AT_MEAN = f"""{DAY_OBS}, {LINES}, centre AS (SELECT family, avg(x) AS at_x FROM obs GROUP BY family),
at_mean AS (SELECT l.family, treatment, intercept + slope * at_x AS emmean FROM lines l JOIN centre c ON c.family = l.family)"""
_EMISSION = f"""{_AT_MEAN}, e AS (SELECT treatment, CAST(days AS INTEGER) AS days, round(emmean * 60 * 24 * days) AS co2_umol
 FROM at_mean CROSS JOIN (VALUES (8), (14)) AS d(days) WHERE family = 'l_tax'),
emission AS (SELECT *, co2_umol / 1000000 * 44 * 1000 AS co2_mg, co2_umol / 1000000 * 44 * 1000 * 12 / 44 AS co2_mg_c FROM e)"""
_TREND_LOSS = f"""t AS (SELECT treatment, CAST(days AS INTEGER) AS days, -slope * 1e5 * 10 AS loss_rate_mg, round(-slope * 1e5 * 10 * days, 2) AS loss_mg
 FROM lines CROSS JOIN (VALUES (8), (14)) AS d(days) WHERE family = 'l_quantity'),
loss AS (SELECT *, loss_mg * 12 * 6 / 162.0 AS loss_mg_c FROM t)"""


def _emission(moments):
    at_mean = M.emmeans_at_mean(moments, None).where(F.col("family") == "l_tax")
    return R.cumulative_emission(at_mean, [8, 14])


def _trend_loss(moments):
    slopes = M.trend_slopes(moments, None).where(F.col("family") == "l_quantity")
    return R.trend_loss(slopes.withColumn("slope", F.col("slope") * 1e5), [8, 14])


@register(
    "cumulative_emission",
    exact=["treatment", "days"],
    sig=["co2_umol", "co2_mg", "co2_mg_c"],
    sql=f"WITH {_EMISSION} SELECT * FROM emission",
)
def cumulative_emission_query(spark, folder):
    return _emission(day_lines(spark, folder))


@register(
    "interval_loss_report",
    exact=["family", "treatment", "x", "days"],
    sig=["amount_mg", "loss_mg", "loss_mg_c"],
    sql=f"""WITH {OBS}, {MEANS}, a AS (SELECT family, treatment, x, CAST(abs(x - 4) AS INTEGER) AS days, emmean * 10 AS amount_mg,
 lag(emmean * 10) OVER (PARTITION BY family, treatment ORDER BY x) - emmean * 10 AS loss_mg FROM means)
SELECT *, loss_mg * 12 * 6 / 162.0 AS loss_mg_c FROM a""",
)
def interval_loss_report_query(spark, folder):
    means = M.emmeans_cell(materialize(line_cells(spark, folder)), None)
    return R.interval_loss_report(means, -4)


@register(
    "trend_loss",
    exact=["treatment", "days"],
    sig=["loss_rate_mg", "loss_mg", "loss_mg_c"],
    sql=f"WITH {DAY_OBS}, {LINES}, {_TREND_LOSS} SELECT * FROM loss",
)
def trend_loss_query(spark, folder):
    return _trend_loss(day_lines(spark, folder))


@register(
    "percent_explained",
    exact=["treatment", "days"],
    sig=["co2_mg_c", "loss_mg_c", "percent"],
    sql=f"""WITH {_EMISSION}, {_TREND_LOSS}
SELECT treatment, days, co2_mg_c, loss_mg_c, 100 * co2_mg_c / nullif(loss_mg_c, 0) AS percent FROM emission LEFT JOIN loss USING (treatment, days)""",
)
def percent_explained_query(spark, folder):
    moments = day_lines(spark, folder)
    return R.percent_explained(_emission(moments), _trend_loss(moments))


@register(
    "relocation_estimate",
    exact=["l_returnflag", "n"],
    sig=["tissue_kg"],
    sql="""SELECT l_returnflag, count(*) AS n, sum(l_quantity * l_discount * l_tax * 1000 * (72.0 / 162.0) / 0.4) AS tissue_kg FROM lineitem GROUP BY l_returnflag""",
)
def relocation_estimate_query(spark, folder):
    tissue = S.relocation_estimate("l_quantity", "l_discount", "l_tax", F.lit(0.4))
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum(tissue).alias("tissue_kg")
    )


@register(
    "smooth_line",
    exact=["treatment", "point"],
    sig=["x", "fitted"],
    sql=f"""WITH o AS (SELECT l_linestatus AS treatment, {DAY_SQL} AS x, l_quantity AS y FROM lineitem),
l AS (SELECT treatment, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, min(x) AS lo, max(x) AS hi FROM o GROUP BY treatment)
SELECT treatment, CAST(i AS INTEGER) AS point, lo + (hi - lo) * i / 79.0 AS x, a + b * (lo + (hi - lo) * i / 79.0) AS fitted FROM l CROSS JOIN range(80) AS p(i)""",
)
def smooth_line_query(spark, folder):
    return V.smooth_line(lineitem(spark, folder), "day", "l_quantity", "l_linestatus").withColumnRenamed(
        "l_linestatus", "treatment"
    )


@register(
    "smooth_line_full_range",
    exact=["treatment", "point"],
    sig=["x", "fitted"],
    sql=f"""WITH o AS (SELECT l_linestatus AS treatment, {DAY_SQL} AS x, l_quantity AS y FROM lineitem),
l AS (SELECT treatment, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM o WHERE x BETWEEN 500 AND 2000 AND y BETWEEN 5 AND 45 GROUP BY treatment)
SELECT treatment, CAST(i AS INTEGER) AS point, 3000.0 * i / 79.0 AS x, a + b * 3000.0 * i / 79.0 AS fitted FROM l CROSS JOIN range(80) AS p(i)""",
)
def smooth_line_full_range_query(spark, folder):
    """Rows outside the axis limits are dropped first; the line spans the whole axis."""
    clipped = V.range_clip(lineitem(spark, folder), "day", "l_quantity", (500, 2000), (5, 45))
    smooth = V.smooth_line(clipped, "day", "l_quantity", "l_linestatus", full_range=(0, 3000))
    return smooth.withColumnRenamed("l_linestatus", "treatment")


@register(
    "range_clip",
    exact=["event_id", "value"],
    sql="SELECT event_id, value FROM events WHERE day(ts) BETWEEN 3 AND 20 AND value BETWEEN 10 AND 90",
)
def range_clip_query(spark, folder):
    events = table(spark, folder, "events").withColumn("x", F.dayofmonth("ts"))
    return V.range_clip(events, "x", "value", (3, 20), (10, 90))


@register(
    "smooth_quadratic",
    exact=["treatment", "x"],
    sig=["fitted"],
    sql="""WITH o AS (SELECT l_linestatus AS treatment, l_linenumber AS x, l_quantity AS y FROM lineitem),
m AS (SELECT treatment, avg(x) AS mx, avg(x * x) AS mq, avg(y) AS my FROM o GROUP BY treatment),
c AS (SELECT o.treatment, x - mx AS u, x * x - mq AS v, y - my AS w FROM o JOIN m ON o.treatment = m.treatment),
s AS (SELECT treatment, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * w) AS uw, sum(v * w) AS vw FROM c GROUP BY treatment),
f AS (SELECT s.treatment, (uw * vv - vw * uv) / (uu * vv - uv * uv) AS b, (vw * uu - uw * uv) / (uu * vv - uv * uv) AS q, mx, mq, my FROM s JOIN m USING (treatment))
SELECT treatment, CAST(g.x AS INTEGER) AS x, my + b * (g.x - mx) + q * (g.x * g.x - mq) AS fitted FROM f CROSS JOIN range(1, 8) AS g(x)""",
)
def smooth_quadratic_query(spark, folder):
    df = lineitem(spark, folder).select(
        F.col("l_linestatus").alias("treatment"), F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("y")
    )
    return V.smooth_quadratic(df, factor_grid(df.select("treatment").distinct(), 1, 7))


@register(
    "stack_bounds",
    exact=["family", "treatment", "x"],
    sig=["lower", "upper"],
    sql=f"""WITH {EVENT_MEANS}, o AS (SELECT *, CASE WHEN family = 'purchase' THEN 5 ELSE list_position(['view', 'click', 'signup', 'error'], family) END AS k FROM ev),
s AS (SELECT *, sum(value) OVER (PARTITION BY treatment, x ORDER BY k) AS upper FROM o) SELECT *, upper - value AS lower FROM s""",
)
def stack_bounds_query(spark, folder):
    return V.stack_bounds(event_means(spark, folder), ["view", "click", "signup", "error"], "value")


@register(
    "stage_bars",
    exact=["family", "treatment", "start_x", "end_x"],
    sig=["y", "ymin", "ymax"],
    sql=f"""WITH {EVENT_MEANS}, m AS (SELECT *, max(value) OVER (PARTITION BY family, treatment) AS top FROM ev),
s AS (SELECT family, treatment, min(x) FILTER (value >= top * 0.15) AS start_x, max(x) FILTER (value <= top * 0.85) AS end_x FROM m GROUP BY family, treatment)
SELECT *, CASE treatment WHEN 'Room' THEN -0.1 ELSE -0.2 END AS y, CASE treatment WHEN 'Room' THEN -0.15 ELSE -0.25 END AS ymin,
 CASE treatment WHEN 'Room' THEN -0.05 ELSE -0.15 END AS ymax FROM s""",
)
def stage_bars_query(spark, folder):
    return V.stage_bars(materialize(event_means(spark, folder)), {"Room": -0.1, "Cold": -0.2})
