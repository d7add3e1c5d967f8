"""Cell statistics, linear models and ANOVA queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.catalog.base import register, table
from trialframe.catalog.standins import (
    DAY_SQL,
    EFFECT_SQL,
    RESPONSES,
    cells_sql,
    det_sql,
    effect_response,
    f_p_sql,
    fit_sql,
    lineitem,
    observations_sql,
    t_p_sql,
)
from trialframe.operators import least_squares as G
from trialframe.operators import linear as L
from trialframe.operators.cells import cell_stats, line_moments
from trialframe.session import materialize
from trialframe.sources import factor_grid

OBS = f"obs AS ({observations_sql()})"
DAY_OBS = f"obs AS ({observations_sql(x=DAY_SQL)})"
FLAG_OBS = f"obs AS ({observations_sql('l_returnflag')})"
EFFECT_OBS = (
    f"obs AS (SELECT 'effect' AS family, l_linestatus AS treatment, l_linenumber AS x, {EFFECT_SQL} AS y FROM lineitem)"
)
LINES = """lines AS (
SELECT family, treatment, count(*) AS n, avg(x) AS x_mean, avg(y) AS y_mean, regr_sxx(y, x) AS sxx,
 regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM obs GROUP BY family, treatment),
resid AS (
SELECT o.family, sum((y - intercept - slope * x) ** 2) AS rss, count(*) AS n_total FROM obs o JOIN lines l
 ON o.family = l.family AND o.treatment = l.treatment GROUP BY o.family),
pooled AS (
SELECT r.family, rss, n_total, CAST(n_total - 2 * k AS BIGINT) AS df, 2 * k AS parameters, sqrt(rss / (n_total - 2 * k)) AS sigma
FROM resid r JOIN (SELECT family, count(*) AS k FROM lines GROUP BY family) c ON r.family = c.family)"""


def line_cells(spark, folder, treatment="l_linestatus"):
    return cell_stats(lineitem(spark, folder), RESPONSES, treatment, "l_linenumber")


def effect_cells(spark, folder):
    return cell_stats(
        lineitem(spark, folder), {"effect": effect_response()}, "l_linestatus", "l_linenumber"
    )


def day_lines(spark, folder, treatment="l_linestatus"):
    """Line moments of the four responses: a handful of rows, made in one pass."""
    return materialize(line_moments(lineitem(spark, folder), RESPONSES, "day", treatment))


@register(
    "cell_stats",
    exact=["family", "treatment", "x", "n"],
    sig=["mean", "ss"],
    sql=f"WITH {OBS}, {cells_sql()} SELECT * FROM cells",
)
def cell_stats_query(spark, folder):
    return line_cells(spark, folder)


@register(
    "cell_stats_by_day",
    exact=["family", "treatment", "x", "n"],
    sig=["mean", "ss"],
    sql=f"WITH {DAY_OBS}, {cells_sql()} SELECT * FROM cells",
)
def cell_stats_by_day_query(spark, folder):
    return cell_stats(lineitem(spark, folder), RESPONSES, "l_linestatus", "day")


@register(
    "cell_means_fit",
    exact=["family", "n", "parameters", "df"],
    sig=["rss", "sigma"],
    sql=f"WITH {OBS}, {cells_sql()}, {fit_sql()} SELECT * FROM fit",
)
def cell_means_fit_query(spark, folder):
    return L.cell_means_fit(line_cells(spark, folder))


@register(
    "one_way_fit",
    exact=["family", "n", "parameters", "df"],
    sig=["rss", "sigma"],
    sql=f"""WITH obs AS ({observations_sql('o_orderpriority', "'all'").replace('FROM lineitem', 'FROM lineitem JOIN orders ON l_orderkey = o_orderkey')}),
{cells_sql()}, {fit_sql()} SELECT * FROM fit""",
)
def one_way_fit_query(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    rows = lineitem(spark, folder).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return L.one_way_fit(cell_stats(rows, RESPONSES, "o_orderpriority", F.lit("all")))


@register(
    "ancova_fit",
    exact=["family", "treatment", "n", "df"],
    sig=["slope", "intercept", "rss", "sigma"],
    sql=f"""WITH {DAY_OBS}, {LINES}
SELECT family, treatment, n, df, slope, intercept, rss, sigma FROM lines JOIN pooled USING (family)""",
)
def ancova_fit_query(spark, folder):
    return L.ancova_fit(day_lines(spark, folder))


_NO_INTERCEPT = """
base AS (SELECT family, arg_min(slope, treatment) AS b, arg_min(sxx, treatment) AS bxx, min(treatment) AS bt FROM lines GROUP BY family),
terms AS (
SELECT family, 'treatment' || treatment AS term, intercept AS estimate, sigma * sqrt(1.0 / n + x_mean ** 2 / sxx) AS se, df
FROM lines JOIN pooled USING (family)
UNION ALL SELECT family, 'x', b, sigma / sqrt(bxx), df FROM base JOIN pooled USING (family)
UNION ALL SELECT family, 'x:treatment' || treatment, slope - b, sigma * sqrt(1 / sxx + 1 / bxx), df
FROM lines JOIN base USING (family) JOIN pooled USING (family) WHERE treatment <> bt)"""


@register(
    "ancova_no_intercept",
    exact=["family", "term", "df"],
    sig=["estimate", "se", "t"],
    prob=["p"],
    sql=f"""WITH {DAY_OBS}, {LINES}, {_NO_INTERCEPT}, tested AS (SELECT *, estimate / se AS t FROM terms)
SELECT *, {t_p_sql('t', 'df')} AS p FROM tested""",
)
def ancova_no_intercept_query(spark, folder):
    return L.ancova_no_intercept(day_lines(spark, folder))


@register(
    "coef_summary",
    exact=["family", "term", "df"],
    sig=["estimate", "se", "t"],
    prob=["p"],
    sql=f"""WITH {DAY_OBS}, {LINES},
base AS (SELECT family, min(treatment) AS bt FROM lines GROUP BY family),
b AS (SELECT l.* FROM lines l JOIN base ON l.family = base.family AND treatment = bt),
terms AS (
SELECT family, '(intercept)' AS term, intercept AS estimate, sigma * sqrt(1.0 / n + x_mean ** 2 / sxx) AS se, df FROM b JOIN pooled USING (family)
UNION ALL SELECT family, 'x', slope, sigma / sqrt(sxx), df FROM b JOIN pooled USING (family)
UNION ALL SELECT l.family, 'treatment' || l.treatment, l.intercept - b.intercept,
 sigma * sqrt(1.0 / l.n + l.x_mean ** 2 / l.sxx + 1.0 / b.n + b.x_mean ** 2 / b.sxx), df
 FROM lines l JOIN b ON l.family = b.family AND l.treatment <> b.treatment JOIN pooled p ON p.family = l.family
UNION ALL SELECT l.family, 'x:treatment' || l.treatment, l.slope - b.slope, sigma * sqrt(1 / l.sxx + 1 / b.sxx), df
 FROM lines l JOIN b ON l.family = b.family AND l.treatment <> b.treatment JOIN pooled p ON p.family = l.family),
tested AS (SELECT *, estimate / se AS t FROM terms)
SELECT *, {t_p_sql('t', 'df')} AS p FROM tested""",
)
def coef_summary_query(spark, folder):
    return L.coef_summary(day_lines(spark, folder))


@register(
    "model_summary",
    exact=["family", "n", "df", "df_model"],
    sig=["sigma", "r2", "f"],
    prob=["p"],
    sql=f"""WITH {DAY_OBS}, {LINES},
total AS (SELECT family, regr_syy(y, y) AS tss FROM obs GROUP BY family),
stats AS (SELECT family, n_total AS n, df, CAST(parameters - 1 AS BIGINT) AS df_model, sigma, 1 - rss / tss AS r2,
 (tss - rss) / (parameters - 1) / (sigma * sigma) AS f FROM pooled JOIN total USING (family))
SELECT *, {f_p_sql('f', 'df_model', 'df')} AS p FROM stats""",
)
def model_summary_query(spark, folder):
    return L.model_summary(day_lines(spark, folder))


@register(
    "model_summary_no_intercept",
    exact=["family", "n", "df", "df_model"],
    sig=["sigma", "r2", "f"],
    prob=["p"],
    sql=f"""WITH {DAY_OBS}, {LINES},
total AS (SELECT family, sum(y * y) AS tss FROM obs GROUP BY family),
stats AS (SELECT family, n_total AS n, df, CAST(parameters AS BIGINT) AS df_model, sigma, 1 - rss / tss AS r2,
 (tss - rss) / parameters / (sigma * sigma) AS f FROM pooled JOIN total USING (family))
SELECT *, {f_p_sql('f', 'df_model', 'df')} AS p FROM stats""",
)
def model_summary_no_intercept_query(spark, folder):
    return L.model_summary(day_lines(spark, folder), with_intercept=False)


@register(
    "anova_no_intercept",
    exact=["family", "term_order", "term", "df"],
    sig=["ss", "ms", "f"],
    prob=["p"],
    sql=f"""WITH {DAY_OBS},
m AS (SELECT family, count(*) AS n, count(DISTINCT treatment) AS k, sum(x * y) / sum(x * x) AS b0 FROM obs GROUP BY family),
g AS (SELECT family, treatment, avg(x) AS gx, avg(y) AS gy, regr_slope(y, x) AS gb, regr_intercept(y, x) AS ga FROM obs GROUP BY family, treatment),
w AS (SELECT o.family, sum((x - gx) * (y - gy)) / sum((x - gx) * (x - gx)) AS b
 FROM obs o JOIN g ON o.family = g.family AND o.treatment = g.treatment GROUP BY o.family),
fitted AS (SELECT o.family, y, b0 * x AS one, gy + w.b * (x - gx) AS parallel, ga + gb * x AS own
 FROM obs o JOIN m ON o.family = m.family JOIN w ON o.family = w.family JOIN g ON o.family = g.family AND o.treatment = g.treatment),
ss AS (SELECT family, sum(one ** 2) AS ssx, sum((parallel - one) ** 2) AS sst, sum((own - parallel) ** 2) AS ssi, sum((y - own) ** 2) AS rss FROM fitted GROUP BY family),
long AS (SELECT family, term_order, term, CAST(df AS BIGINT) AS df, ss, ss / df AS ms, CAST(n - 2 * k AS BIGINT) AS rdf, rss / (n - 2 * k) AS ems
 FROM ss JOIN m USING (family) CROSS JOIN LATERAL (VALUES (1, 'x', 1, ssx), (2, 'treatment', k, sst), (3, 'x:treatment', k - 1, ssi),
 (4, 'residual', n - 2 * k, rss)) AS v(term_order, term, df, ss)),
tested AS (SELECT *, CASE WHEN term_order < 4 THEN ms / ems END AS f FROM long)
SELECT *, CASE WHEN f IS NOT NULL THEN {f_p_sql('f', 'df', 'rdf')} END AS p FROM tested""",
)
def anova_no_intercept_query(spark, folder):
    return L.anova_no_intercept(day_lines(spark, folder))


@register(
    "simple_regression",
    exact=["family", "n", "df"],
    sig=["slope", "intercept", "sigma", "r2", "slope_se", "intercept_se", "slope_t", "intercept_t"],
    prob=["slope_p", "intercept_p"],
    sql=f"""WITH {DAY_OBS},
line AS (SELECT family, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
 avg(x) AS xm, regr_sxx(y, x) AS sxx, regr_r2(y, x) AS r2 FROM obs GROUP BY family),
err AS (SELECT o.family, sqrt(sum((y - intercept - slope * x) ** 2) / (count(*) - 2)) AS sigma
 FROM obs o JOIN line l ON o.family = l.family GROUP BY o.family),
tested AS (SELECT *, CAST(n - 2 AS BIGINT) AS df, sigma / sqrt(sxx) AS slope_se, sigma * sqrt(1.0 / n + xm * xm / sxx) AS intercept_se,
 slope / (sigma / sqrt(sxx)) AS slope_t, intercept / (sigma * sqrt(1.0 / n + xm * xm / sxx)) AS intercept_t FROM line JOIN err USING (family))
SELECT *, {t_p_sql('slope_t', 'df')} AS slope_p, {t_p_sql('intercept_t', 'df')} AS intercept_p FROM tested""",
)
def simple_regression_query(spark, folder):
    moments = line_moments(lineitem(spark, folder), RESPONSES, "day", treatment=None)
    return L.simple_regression(moments)


_ANCOVA_SS = f"""WITH {DAY_OBS},
m AS (SELECT family, avg(x) AS mx, avg(y) AS my, count(*) AS n, count(DISTINCT treatment) AS k FROM obs GROUP BY family),
common AS (SELECT family, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM obs GROUP BY family),
g AS (SELECT family, treatment, avg(x) AS gx, avg(y) AS gy, regr_slope(y, x) AS gb, regr_intercept(y, x) AS ga FROM obs GROUP BY family, treatment),
w AS (SELECT o.family, sum((x - gx) * (y - gy)) / sum((x - gx) * (x - gx)) AS b
 FROM obs o JOIN g ON o.family = g.family AND o.treatment = g.treatment GROUP BY o.family),
fitted AS (SELECT o.family, y, my, a + common.b * x AS one, gy + w.b * (x - gx) AS parallel, ga + gb * x AS own
 FROM obs o JOIN m ON o.family = m.family JOIN common ON o.family = common.family JOIN w ON o.family = w.family
 JOIN g ON o.family = g.family AND o.treatment = g.treatment),
ss AS (SELECT family, sum((one - my) ** 2) AS ssx, sum((parallel - one) ** 2) AS sst, sum((own - parallel) ** 2) AS ssi,
 sum((y - own) ** 2) AS rss FROM fitted GROUP BY family),
long AS (SELECT family, term_order, term, CAST(df AS BIGINT) AS df, ss, ss / df AS ms, CAST(n - 2 * k AS BIGINT) AS rdf, rss / (n - 2 * k) AS ems
 FROM ss JOIN m USING (family) CROSS JOIN LATERAL (VALUES (1, 'x', 1, ssx), (2, 'treatment', k - 1, sst), (3, 'x:treatment', k - 1, ssi),
 (4, 'residual', n - 2 * k, rss)) AS v(term_order, term, df, ss)),
tested AS (SELECT *, CASE WHEN term_order < 4 THEN ms / ems END AS f FROM long)
SELECT *, CASE WHEN f IS NOT NULL THEN {f_p_sql('f', 'df', 'rdf')} END AS p FROM tested"""


@register(
    "anova_ancova",
    exact=["family", "term_order", "term", "df"],
    sig=["ss", "ms", "f"],
    prob=["p"],
    sql=_ANCOVA_SS,
)
def anova_ancova_query(spark, folder):
    return L.anova_ancova(day_lines(spark, folder))


_FACTORIAL = """
m AS (SELECT family, avg(y) AS my, count(*) AS n FROM obs GROUP BY family),
t AS (SELECT family, treatment, avg(y) AS ty, count(*) AS n FROM obs GROUP BY family, treatment),
d AS (SELECT family, x, avg(y) AS dy, count(*) AS n FROM obs GROUP BY family, x),
wide AS (SELECT family, x, max(CASE WHEN treatment = 'F' THEN mean END) - max(CASE WHEN treatment = 'O' THEN mean END) AS gap,
 max(CASE WHEN treatment = 'F' THEN n END) * max(CASE WHEN treatment = 'O' THEN n END) * 1.0 / sum(n) AS w FROM cells GROUP BY family, x),
given AS (SELECT family, sum(w * gap) ** 2 / sum(w) AS ss_td FROM wide GROUP BY family),
parts AS (SELECT m.family, m.n, (SELECT sum(n * (ty - my) ** 2) FROM t WHERE t.family = m.family) AS ss_t,
 (SELECT sum(n * (dy - my) ** 2) FROM d WHERE d.family = m.family) AS ss_d,
 (SELECT sum(n * (mean - my) ** 2) FROM cells c WHERE c.family = m.family) AS ss_c,
 (SELECT sum(ss) FROM cells c WHERE c.family = m.family) AS rss, (SELECT count(*) FROM cells c WHERE c.family = m.family) AS k,
 (SELECT count(*) FROM t WHERE t.family = m.family) AS a, (SELECT count(*) FROM d WHERE d.family = m.family) AS b, ss_td
 FROM m JOIN given USING (family))"""


def _factorial_sql(obs: str, first: str) -> str:
    if first == "treatment":
        mains = "(1, 'treatment', a - 1, ss_t), (2, 'x', b - 1, ss_d + ss_td - ss_t)"
    else:
        mains = "(1, 'x', b - 1, ss_d), (2, 'treatment', a - 1, ss_td)"
    return f"""WITH {obs}, {cells_sql()}, {_FACTORIAL},
long AS (SELECT family, term_order, term, CAST(df AS BIGINT) AS df, ss, ss / df AS ms, CAST(n - k AS BIGINT) AS rdf, rss / (n - k) AS ems
 FROM parts CROSS JOIN LATERAL (VALUES {mains}, (3, 'treatment:x', k - a - b + 1, ss_c - ss_d - ss_td), (4, 'residual', n - k, rss))
 AS v(term_order, term, df, ss)),
tested AS (SELECT *, CASE WHEN term_order < 4 THEN ms / ems END AS f FROM long)
SELECT *, CASE WHEN f IS NOT NULL THEN {f_p_sql('f', 'df', 'rdf')} END AS p FROM tested"""


@register(
    "anova_factorial",
    exact=["family", "term_order", "term", "df"],
    sig=["ss", "ms", "f"],
    prob=["p"],
    sql=_factorial_sql(OBS, "treatment"),
)
def anova_factorial_query(spark, folder):
    return L.anova_factorial(materialize(line_cells(spark, folder)))


@register(
    "anova_factorial_x_first",
    exact=["family", "term_order", "term", "df"],
    sig=["ss", "ms", "f"],
    prob=["p"],
    sql=_factorial_sql(EFFECT_OBS, "x"),
)
def anova_factorial_x_first_query(spark, folder):
    return L.anova_factorial(materialize(effect_cells(spark, folder)), first="x")


@register(
    "anova_factorial_three_levels",
    exact=["family", "term_order", "term", "df"],
    sig=["ss", "f"],
    sql=f"""WITH {FLAG_OBS}, {cells_sql()},
m AS (SELECT family, avg(y) AS my, count(*) AS n FROM obs GROUP BY family),
d AS (SELECT family, x, avg(y) AS dy, count(*) AS n FROM obs GROUP BY family, x),
wide AS (SELECT c.family, c.x, d.n, max(dy) AS dy,
 max(CASE WHEN treatment = 'A' THEN c.n END) AS na, max(CASE WHEN treatment = 'N' THEN c.n END) AS nn,
 max(CASE WHEN treatment = 'A' THEN c.n * (mean - dy) END) AS ba, max(CASE WHEN treatment = 'N' THEN c.n * (mean - dy) END) AS bn
 FROM cells c JOIN d ON c.family = d.family AND c.x = d.x GROUP BY c.family, c.x, d.n),
eq AS (SELECT family, sum(na - na * na * 1.0 / n) AS aa, sum(nn - nn * nn * 1.0 / n) AS bb, -sum(na * nn * 1.0 / n) AS ab,
 sum(ba) AS u, sum(bn) AS v FROM wide GROUP BY family),
given AS (SELECT family, (bb * u * u - 2 * ab * u * v + aa * v * v) / (aa * bb - ab * ab) AS ss_td FROM eq),
parts AS (SELECT m.family, n, (SELECT sum(c * (ty - my) ** 2) FROM (SELECT family, avg(y) AS ty, count(*) AS c FROM obs GROUP BY family, treatment) t WHERE t.family = m.family) AS ss_t,
 (SELECT sum(d.n * (dy - my) ** 2) FROM d WHERE d.family = m.family) AS ss_d,
 (SELECT sum(c.n * (mean - my) ** 2) FROM cells c WHERE c.family = m.family) AS ss_c,
 (SELECT sum(ss) FROM cells c WHERE c.family = m.family) AS rss, ss_td FROM m JOIN given USING (family)),
long AS (SELECT family, term_order, term, CAST(df AS BIGINT) AS df, ss, ss / df AS ms, rss / (n - 21) AS ems
 FROM parts CROSS JOIN LATERAL (VALUES (1, 'treatment', 2, ss_t), (2, 'x', 6, ss_d + ss_td - ss_t), (3, 'treatment:x', 12, ss_c - ss_d - ss_td), (4, 'residual', n - 21, rss))
 AS v(term_order, term, df, ss))
SELECT family, term_order, term, df, ss, CASE WHEN term_order < 4 THEN ms / ems END AS f FROM long""",
)
def anova_factorial_three_levels_query(spark, folder):
    return L.anova_factorial(materialize(line_cells(spark, folder, "l_returnflag")))


def _line_model(moments):
    return L.pooled_line_error(moments).select(
        "family", F.col("n_total").alias("n"), "rss", "df", "parameters"
    )


@register(
    "nested_f_test",
    exact=["family", "df_small", "df_large", "df_diff"],
    sig=["rss_small", "rss_large", "ss_diff", "f"],
    prob=["p"],
    sql=f"""WITH {DAY_OBS}, {LINES},
line AS (SELECT family, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM obs GROUP BY family),
small AS (SELECT o.family, sum((y - a - b * x) ** 2) AS rss_small, CAST(count(*) - 2 AS BIGINT) AS df_small FROM obs o JOIN line l ON o.family = l.family GROUP BY o.family),
tested AS (SELECT family, df_small, df AS df_large, CAST(df_small - df AS BIGINT) AS df_diff, rss_small, rss AS rss_large,
 rss_small - rss AS ss_diff, (rss_small - rss) / (df_small - df) / (rss / df) AS f FROM small JOIN pooled USING (family))
SELECT *, {f_p_sql('f', 'df_diff', 'df_large')} AS p FROM tested""",
)
def nested_f_test_query(spark, folder):
    """One common line against a line per treatment."""
    small = L.simple_regression(
        line_moments(lineitem(spark, folder), RESPONSES, "day", treatment=None)
    )
    return L.nested_f_test(small, _line_model(day_lines(spark, folder)))


@register(
    "information_criteria",
    exact=["family", "model", "n", "model_df"],
    sig=["loglik", "aic", "bic"],
    sql=f"""WITH {DAY_OBS}, {LINES}, flat AS (SELECT family, count(*) AS n, count(DISTINCT treatment) AS parameters FROM obs GROUP BY family),
flat_rss AS (SELECT o.family, sum((y - y_mean) ** 2) AS rss FROM obs o JOIN lines l ON o.family = l.family AND o.treatment = l.treatment GROUP BY o.family),
models AS (SELECT family, 'lines' AS model, n_total AS n, rss, parameters FROM pooled
 UNION ALL SELECT family, 'means', n, rss, parameters FROM flat JOIN flat_rss USING (family)),
ll AS (SELECT *, -n / 2.0 * (ln(2 * pi() * rss / n) + 1) AS loglik, CAST(parameters + 1 AS BIGINT) AS model_df FROM models)
SELECT *, -2 * loglik + 2 * model_df AS aic, -2 * loglik + ln(n) * model_df AS bic FROM ll""",
)
def information_criteria_query(spark, folder):
    moments = day_lines(spark, folder)
    means = moments.groupBy("family").agg(
        F.sum("n").alias("n"), F.sum("syy").alias("rss"), F.count(F.lit(1)).alias("parameters")
    )
    models = _line_model(moments).drop("df").withColumn("model", F.lit("lines")).unionByName(
        means.withColumn("model", F.lit("means"))
    )
    return L.information_criteria(models)


@register(
    "predict_linear",
    exact=["family", "treatment", "x"],
    sig=["fitted"],
    sql=f"""WITH {DAY_OBS}, {LINES} SELECT family, treatment, CAST(g.x AS INTEGER) AS x, intercept + slope * g.x AS fitted
FROM lines CROSS JOIN range(1, 181) AS g(x)""",
)
def predict_linear_query(spark, folder):
    moments = day_lines(spark, folder)
    grid = factor_grid(moments.select("treatment").distinct(), 1, 180)
    return L.predict_linear(grid, L.ancova_fit(moments))


def _scaled_day():
    return F.col("day") / 1000.0


def _cubic_terms():
    """x, x², x³ and their products with the treatment, over cells."""
    x = F.col("x") / 1000.0
    room = F.when(F.col("treatment") == "O", 1.0).otherwise(0.0)
    terms = {"x": x, "x2": x * x, "x3": x * x * x, "room": room}
    return {**terms, **{f"{name}:room": terms[name] * room for name in ("x", "x2", "x3")}}


def flag_cells(spark, folder):
    """Quantity by status and day, one family per return flag."""
    rows = lineitem(spark, folder)
    return materialize(cell_stats(rows, {"": "l_quantity"}, "l_linestatus", "day", segment="l_returnflag"))


@register(
    "gram_table",
    exact=["family", "n", "i"],
    sig=["value"],
    sql=f"""WITH rows AS (SELECT CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS room, {DAY_SQL} / 1000.0::DOUBLE AS x,
 l_returnflag AS family, l_quantity AS y FROM lineitem),
v AS (SELECT family, x, x * x AS x2, room, y FROM rows),
m AS (SELECT family, count(*) AS n, avg(x) AS m1, avg(x2) AS m2, avg(room) AS m3, avg(y) AS m4 FROM v GROUP BY family),
c AS (SELECT v.family, n, x - m1 AS a, x2 - m2 AS b, room - m3 AS c, y - m4 AS d FROM v JOIN m ON v.family = m.family),
s AS (SELECT family, any_value(n) AS n, sum(a*a) AS g0, sum(a*b) AS g1, sum(a*c) AS g2, sum(a*d) AS g3, sum(b*b) AS g4, sum(b*c) AS g5, sum(b*d) AS g6,
 sum(c*c) AS g7, sum(c*d) AS g8, sum(d*d) AS g9 FROM c GROUP BY family)
SELECT family, n, CAST(i AS INTEGER) AS i, value FROM s CROSS JOIN LATERAL (VALUES (0,g0),(1,g1),(2,g2),(3,g3),(4,g4),(5,g5),(6,g6),(7,g7),(8,g8),(9,g9)) AS t(i, value)""",
)
def gram_table_query(spark, folder):
    x = _scaled_day()
    room = F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)
    gram = G.gram_table(
        lineitem(spark, folder), "l_quantity", {"x": x, "x2": x * x, "room": room}, "l_returnflag"
    )
    return gram.select("family", "n", F.posexplode("gram").alias("i", "value"))


def _cubic_sql() -> str:
    """CTEs: a cubic per return flag and status, and the pooled error of each flag."""
    names = ("x", "x * x", "x * x * x")
    gram = [[f"g{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    det = det_sql(gram)
    slope, inverse = [], []
    for i in range(3):
        swapped = [row[:i] + [f"b{n}"] + row[i + 1 :] for n, row in enumerate(gram)]
        slope.append(f"({det_sql(swapped)}) / ({det}) AS s{i + 1}")
        for j in range(3):
            minor = [row[:i] + row[i + 1 :] for n, row in enumerate(gram) if n != j]
            inverse.append(f"{'-' if (i + j) % 2 else ''}({det_sql(minor)}) / ({det}) AS v{i}{j}")
    means = ", ".join(f"avg({v}) AS m{i}" for i, v in enumerate(names))
    away = ", ".join(f"{v} - m{i} AS d{i}" for i, v in enumerate(names))
    sums = ", ".join(f"sum(d{i} * d{j}) AS g{i}{j}" for i in range(3) for j in range(i, 3))
    right = ", ".join(f"sum(d{i} * e) AS b{i}" for i in range(3))
    spread = " + ".join(f"m{i} * m{j} * v{i}{j}" for i in range(3) for j in range(3))
    return f"""o AS (SELECT l_returnflag AS family, l_linestatus AS treatment, {DAY_SQL} / 1000.0::DOUBLE AS x, l_quantity AS y FROM lineitem),
m AS (SELECT family, treatment, count(*) AS n, avg(y) AS my, {means} FROM o GROUP BY family, treatment),
c AS (SELECT o.family, o.treatment, y - my AS e, {away} FROM o JOIN m ON o.family = m.family AND o.treatment = m.treatment),
g AS (SELECT family, treatment, sum(e * e) AS yy, {sums}, {right} FROM c GROUP BY family, treatment),
solved AS (SELECT m.*, yy, b0, b1, b2, {', '.join(slope)}, {', '.join(inverse)} FROM g JOIN m USING (family, treatment)),
cubic AS (SELECT *, my - m0 * s1 - m1 * s2 - m2 * s3 AS s0, 1.0 / n + {spread} AS u0, v00 AS u1, v11 AS u2, v22 AS u3,
 yy - b0 * s1 - b1 * s2 - b2 * s3 AS group_rss FROM solved),
cubic_err AS (SELECT family, sum(group_rss) AS rss, CAST(sum(n) - 8 AS BIGINT) AS df, sqrt(sum(group_rss) / (sum(n) - 8)) AS sigma FROM cubic GROUP BY family)"""


@register(
    "gram_ols_cubic",
    exact=["family", "term", "df"],
    sig=["estimate", "se", "t", "sigma"],
    prob=["p"],
    sql=f"""WITH {_cubic_sql()},
long AS (SELECT family, treatment, name, s, u FROM cubic CROSS JOIN LATERAL (VALUES ('(intercept)', s0, u0), ('x', s1, u1), ('x2', s2, u2), ('x3', s3, u3)) AS v(name, s, u)),
terms AS (SELECT family, name AS term, s AS estimate, u FROM long WHERE treatment = 'F'
 UNION ALL SELECT a.family, CASE WHEN a.name = '(intercept)' THEN 'room' ELSE a.name || ':room' END, b.s - a.s, a.u + b.u
 FROM long a JOIN long b ON a.family = b.family AND a.name = b.name AND a.treatment = 'F' AND b.treatment = 'O'),
tested AS (SELECT t.family, term, estimate, df, sigma, sigma * sqrt(u) AS se, estimate / (sigma * sqrt(u)) AS t FROM terms t JOIN cubic_err e ON t.family = e.family)
SELECT *, {t_p_sql('t', 'df')} AS p FROM tested""",
)
def gram_ols_cubic_query(spark, folder):
    """Cubic in the day by treatment, one model per return flag."""
    return G.gram_ols_cells(flag_cells(spark, folder), _cubic_terms())


@register(
    "gram_ols",
    exact=["family", "term", "df"],
    sig=["estimate", "se", "t"],
    prob=["p"],
    sql=f"""WITH obs AS (SELECT l_returnflag AS family, l_linestatus AS treatment, {DAY_SQL} / 1000.0::DOUBLE AS x, l_quantity AS y FROM lineitem),
{LINES},
f AS (SELECT * FROM lines WHERE treatment = 'F'), o AS (SELECT * FROM lines WHERE treatment = 'O'),
terms AS (SELECT family, '(intercept)' AS term, intercept AS estimate, sigma * sqrt(1.0 / n + x_mean ** 2 / sxx) AS se, df FROM f JOIN pooled USING (family)
UNION ALL SELECT family, 'room', o.intercept - f.intercept, sigma * sqrt(1.0 / o.n + o.x_mean ** 2 / o.sxx + 1.0 / f.n + f.x_mean ** 2 / f.sxx), df
 FROM f JOIN o USING (family) JOIN pooled USING (family)
UNION ALL SELECT family, 'x_cold', slope, sigma / sqrt(sxx), df FROM f JOIN pooled USING (family)
UNION ALL SELECT family, 'x_room', slope, sigma / sqrt(sxx), df FROM o JOIN pooled USING (family)),
tested AS (SELECT *, estimate / se AS t FROM terms)
SELECT *, {t_p_sql('t', 'df')} AS p FROM tested""",
)
def gram_ols_query(spark, folder):
    """Treatment plus split slopes: the same model as separate lines, fitted from its Gram matrix."""
    from trialframe.functions.scalar import split_regressor

    df = lineitem(spark, folder).withColumn("xs", _scaled_day())
    terms = {
        "room": F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0),
        "x_room": split_regressor("xs", "l_linestatus", "O"),
        "x_cold": split_regressor("xs", "l_linestatus", "F"),
    }
    return G.gram_ols(df, "l_quantity", terms, "l_returnflag")


@register(
    "gram_ols_cells",
    exact=["family", "n", "df"],
    sig=["c", "b", "q", "rss"],
    sql=f"""WITH o AS (SELECT l_returnflag AS family, {DAY_SQL} / 1000.0::DOUBLE AS x, l_quantity AS y FROM lineitem),
m AS (SELECT family, avg(x) AS mx, avg(x * x) AS mq, avg(y) AS my FROM o GROUP BY family),
c AS (SELECT o.family, x - mx AS u, x * x - mq AS v, y - my AS w FROM o JOIN m ON o.family = m.family),
s AS (SELECT family, count(*) AS n, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * w) AS uw, sum(v * w) AS vw, sum(w * w) AS ww FROM c GROUP BY family),
f AS (SELECT s.*, mx, mq, my, (uw * vv - vw * uv) / (uu * vv - uv * uv) AS b, (vw * uu - uw * uv) / (uu * vv - uv * uv) AS q FROM s JOIN m USING (family))
SELECT family, n, CAST(n - 3 AS BIGINT) AS df, my - b * mx - q * mq AS c, b, q, ww - b * uw - q * vw AS rss FROM f""",
)
def gram_ols_cells_query(spark, folder):
    """Quadratic in the day fitted from cell statistics, equal to the fit on raw rows."""
    x = F.col("x") / 1000.0
    fit = G.gram_ols_cells(flag_cells(spark, folder), {"x": x, "x2": x * x})
    pick = lambda term: F.max(F.when(F.col("term") == term, F.col("estimate")))
    return fit.groupBy("family", "n", "df", "rss").agg(
        pick("(intercept)").alias("c"), pick("x").alias("b"), pick("x2").alias("q")
    )


@register(
    "nested_f_test_cubic",
    exact=["family", "df_small", "df_large", "df_diff"],
    sig=["rss_small", "rss_large", "f"],
    prob=["p"],
    sql=f"""WITH {_cubic_sql()}, line AS (SELECT family, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM o GROUP BY family),
small AS (SELECT o.family, sum((y - a - b * x) ** 2) AS rss_small, CAST(count(*) - 2 AS BIGINT) AS df_small FROM o JOIN line l ON o.family = l.family GROUP BY o.family),
tested AS (SELECT s.family, df_small, df AS df_large, CAST(df_small - df AS BIGINT) AS df_diff, rss_small, rss AS rss_large,
 (rss_small - rss) / (df_small - df) / (rss / df) AS f FROM small s JOIN cubic_err e ON s.family = e.family)
SELECT *, {f_p_sql('f', 'df_diff', 'df_large')} AS p FROM tested""",
)
def nested_f_test_cubic_query(spark, folder):
    """A straight line against the cubic by treatment."""
    cells = flag_cells(spark, folder)
    small = G.fit_summary(G.gram_ols_cells(cells, {"x": F.col("x") / 1000.0}))
    large = G.fit_summary(G.gram_ols_cells(cells, _cubic_terms()))
    return L.nested_f_test(small, large)
