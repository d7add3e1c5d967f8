"""Marginal means, contrasts, letters, slopes and the chart tables built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.catalog.base import register
from trialframe.catalog.linear import (
    DAY_OBS,
    EFFECT_OBS,
    LINES,
    OBS,
    day_lines,
    effect_cells,
    line_cells,
)
from trialframe.catalog.standins import (
    EFFECT_SQL,
    RESPONSES,
    cells_sql,
    effect_response,
    fit_sql,
    lineitem,
    range_p_ctes,
    t_crit_sql,
    t_p_sql,
)
from trialframe.functions.scalar import signif_code
from trialframe.operators import charts as V
from trialframe.operators import letters as K
from trialframe.operators import means as M
from trialframe.operators import rates as R
from trialframe.operators import windows as W
from trialframe.operators.cells import cell_stats, merge_cells
from trialframe.plans.response_report import response_report
from trialframe.session import materialize

MEANS = f"""{cells_sql()}, {fit_sql()},
means AS (SELECT c.family, c.treatment, c.x, c.n, c.mean AS emmean, sigma / sqrt(c.n) AS se, df
 FROM cells c JOIN fit f ON c.family = f.family)"""

# Two treatments inside one family and x, first minus second.
PAIRS = f"""{MEANS},
pairs AS (SELECT a.family, a.x, a.treatment AS level_a, b.treatment AS level_b, a.emmean - b.emmean AS difference,
 sqrt(a.se ** 2 + b.se ** 2) AS se, a.df, (a.emmean - b.emmean) / sqrt(a.se ** 2 + b.se ** 2) AS t
 FROM means a JOIN means b ON a.family = b.family AND a.x = b.x AND a.treatment < b.treatment),
tested AS (SELECT *, {t_p_sql('t', 'df')} AS p FROM pairs)"""

# Samplings inside one family and treatment.
DAY_PAIRS = f"""{MEANS},
pairs AS (SELECT a.family, a.treatment, a.x AS level_a, b.x AS level_b, a.emmean - b.emmean AS difference,
 sqrt(a.se ** 2 + b.se ** 2) AS se, a.df, (a.emmean - b.emmean) / sqrt(a.se ** 2 + b.se ** 2) AS t
 FROM means a JOIN means b ON a.family = b.family AND a.treatment = b.treatment AND a.x < b.x),
numbered AS (SELECT *, row_number() OVER () AS rid, abs(t) * sqrt(2.0) AS q,
 (SELECT count(DISTINCT x) FROM cells) AS k FROM pairs),
{range_p_ctes('numbered')},
tested AS (SELECT numbered.*, p FROM numbered JOIN ranged USING (rid))"""

# Letters of two treatments: the larger mean has a, the other b when they differ.
TWO_LETTERS = f"""{PAIRS},
lettered AS (SELECT m.*, CASE WHEN p >= 0.05 OR (m.treatment = level_a) = (difference > 0) THEN 'a' ELSE 'b' END AS letters, p
 FROM means m JOIN tested t ON m.family = t.family AND m.x = t.x)"""


def four_means(spark, folder, level=0.95):
    return M.emmeans_cell(materialize(line_cells(spark, folder)), level)


def effect_means(spark, folder):
    return M.emmeans_cell(materialize(effect_cells(spark, folder)), None)


@register(
    "emmeans_cell",
    exact=["family", "treatment", "x", "n", "df"],
    sig=["emmean", "se", "lower", "upper"],
    sql=f"""WITH {OBS}, {MEANS} SELECT *, emmean - {t_crit_sql('df')} * se AS lower, emmean + {t_crit_sql('df')} * se AS upper FROM means""",
)
def emmeans_cell_query(spark, folder):
    return four_means(spark, folder)


@register(
    "emmeans_one_way",
    exact=["family", "treatment", "df"],
    sig=["emmean", "se", "lower", "upper"],
    sql=f"""WITH {OBS.replace('l_linestatus', 'l_returnflag').replace('l_linenumber', "'all'")}, {MEANS}
SELECT *, emmean - {t_crit_sql('df')} * se AS lower, emmean + {t_crit_sql('df')} * se AS upper FROM means""",
)
def emmeans_one_way_query(spark, folder):
    cells = cell_stats(lineitem(spark, folder), RESPONSES, "l_returnflag", F.lit("all"))
    return M.emmeans_one_way(materialize(cells))


@register(
    "merge_cells",
    exact=["family", "treatment", "n"],
    sig=["mean", "ss"],
    sql=f"""WITH {OBS} SELECT family, treatment, count(*) AS n, avg(y) AS mean, regr_syy(y, y) AS ss FROM obs GROUP BY family, treatment""",
)
def merge_cells_query(spark, folder):
    """Coarser cell statistics merged from finer ones."""
    return merge_cells(materialize(line_cells(spark, folder)), ["family", "treatment"])


@register(
    "emmeans_at_mean",
    exact=["family", "treatment", "df"],
    sig=["at_x", "emmean", "se", "lower", "upper"],
    sql=f"""WITH {DAY_OBS}, {LINES}, centre AS (SELECT family, avg(x) AS at_x FROM obs GROUP BY family),
m AS (SELECT l.family, treatment, at_x, intercept + slope * at_x AS emmean, sigma * sqrt(1.0 / n + (at_x - x_mean) ** 2 / sxx) AS se, df
 FROM lines l JOIN pooled p ON l.family = p.family JOIN centre c ON c.family = l.family)
SELECT *, emmean - {t_crit_sql('df')} * se AS lower, emmean + {t_crit_sql('df')} * se AS upper FROM m""",
)
def emmeans_at_mean_query(spark, folder):
    return M.emmeans_at_mean(day_lines(spark, folder))


@register(
    "pairwise_contrasts",
    exact=["family", "x", "level_a", "level_b", "df"],
    sig=["difference", "se", "t"],
    prob=["p"],
    sql=f"WITH {OBS}, {PAIRS} SELECT * FROM tested",
)
def pairwise_contrasts_query(spark, folder):
    """Treatments compared inside every sampling, four responses in one job."""
    return M.pairwise_contrasts(four_means(spark, folder, None))


@register(
    "pairwise_contrasts_many_levels",
    exact=["family", "treatment", "level_a", "level_b", "df"],
    sig=["difference", "se", "t"],
    prob=["p"],
    sql=f"WITH {EFFECT_OBS}, {DAY_PAIRS} SELECT * FROM tested",
)
def pairwise_contrasts_many_levels_query(spark, folder):
    """Samplings compared inside every treatment: Tukey-adjusted for seven levels."""
    return M.pairwise_contrasts(effect_means(spark, folder), ("family", "treatment"), "x")


@register(
    "pairwise_matrix",
    exact=["family", "x", "row", "col", "kind"],
    sig=["value"],
    sql=f"""WITH {EFFECT_OBS}, {PAIRS}
SELECT family, x, treatment AS row, treatment AS col, 'mean' AS kind, emmean AS value FROM means
UNION ALL SELECT family, x, level_b, level_a, 'difference', difference FROM tested
UNION ALL SELECT family, x, level_a, level_b, 'p', round(p, 6) FROM tested""",
)
def pairwise_matrix_query(spark, folder):
    means = materialize(effect_means(spark, folder))
    matrix = M.pairwise_matrix(means, M.pairwise_contrasts(means))
    return matrix.withColumn(
        "value", F.when(F.col("kind") == "p", F.round("value", 6)).otherwise(F.col("value"))
    )


@register(
    "letter_groups",
    exact=["family", "treatment", "x", "letters"],
    sig=["emmean", "se"],
    sql=f"WITH {EFFECT_OBS}, {TWO_LETTERS} SELECT * FROM lettered",
)
def letter_groups_query(spark, folder):
    means = materialize(effect_means(spark, folder))
    return K.letter_groups(means, M.pairwise_contrasts(means))


# Letters of many levels, where levels that do not differ form runs in the order of the means.
RUN_LETTERS = f"""{DAY_PAIRS},
placed AS (SELECT *, row_number() OVER (PARTITION BY family, treatment ORDER BY emmean DESC) AS place FROM means),
alike AS (SELECT t.family, t.treatment, least(a.place, b.place) AS i, greatest(a.place, b.place) AS j FROM tested t
 JOIN placed a ON a.family = t.family AND a.treatment = t.treatment AND a.x = t.level_a
 JOIN placed b ON b.family = t.family AND b.treatment = t.treatment AND b.x = t.level_b WHERE p >= 0.05),
reach AS (SELECT p.family, p.treatment, place, greatest(place, coalesce(max(j), 0)) AS last FROM placed p
 LEFT JOIN alike a ON a.family = p.family AND a.treatment = p.treatment AND a.i = p.place GROUP BY p.family, p.treatment, place),
runs AS (SELECT *, coalesce(max(last) OVER (PARTITION BY family, treatment ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM reach),
named AS (SELECT *, chr(CAST(96 + row_number() OVER (PARTITION BY family, treatment ORDER BY place) AS INTEGER)) AS letter FROM runs WHERE last > before)
SELECT p.family, p.treatment, p.x, any_value(emmean) AS emmean, string_agg(letter, '' ORDER BY letter) AS letters
FROM placed p JOIN named r ON r.family = p.family AND r.treatment = p.treatment AND p.place BETWEEN r.place AND r.last GROUP BY p.family, p.treatment, p.x"""


@register(
    "letter_groups_many_levels",
    exact=["family", "treatment", "x", "letters"],
    sig=["emmean"],
    sql=f"WITH {EFFECT_OBS}, {RUN_LETTERS}",
)
def letter_groups_many_levels_query(spark, folder):
    by = ("family", "treatment")
    means = materialize(effect_means(spark, folder))
    return K.letter_groups(means, M.pairwise_contrasts(means, by, "x"), by, "x")


@register(
    "letters_share_rule",
    exact=["family", "treatment", "level_a", "level_b", "share"],
    sql=f"""WITH {EFFECT_OBS}, {DAY_PAIRS} SELECT family, treatment, level_a, level_b, p >= 0.05 AS share FROM tested""",
)
def letters_share_rule_query(spark, folder):
    """Whether two samplings share a letter, read back from the letters."""
    by = ["family", "treatment"]
    means = materialize(effect_means(spark, folder))
    contrasts = M.pairwise_contrasts(means, by, "x")
    shown = K.letter_groups(means, contrasts, by, "x").select(
        *by, "x", F.split("letters", "(?<=.)").alias("set")
    )
    a = shown.select(*by, F.col("x").alias("level_a"), F.col("set").alias("_a"))
    b = shown.select(*by, F.col("x").alias("level_b"), F.col("set").alias("_b"))
    letters = F.array_remove(F.array_intersect("_a", "_b"), "")
    return (
        contrasts.select(*by, "level_a", "level_b")
        .join(a, [*by, "level_a"])
        .join(b, [*by, "level_b"])
        .withColumn("share", F.size(letters) > 0)
    )


@register(
    "signif_code",
    exact=["family", "x", "code"],
    sql=f"""WITH {EFFECT_OBS}, {PAIRS} SELECT family, x, CASE WHEN p < 0.05 THEN '*' WHEN p > 0.05 AND p < 0.1 THEN '.' END AS code FROM tested""",
)
def signif_code_query(spark, folder):
    contrasts = M.pairwise_contrasts(effect_means(spark, folder))
    return contrasts.withColumn("code", signif_code("p"))


@register(
    "signif_by_letters",
    exact=["family", "treatment", "x", "signif", "letters"],
    sql=f"""WITH {EFFECT_OBS}, {TWO_LETTERS}
SELECT family, treatment, x, CASE WHEN p < 0.05 THEN '*' ELSE '' END AS signif, CASE WHEN p < 0.05 THEN letters ELSE '' END AS letters FROM lettered""",
)
def signif_by_letters_query(spark, folder):
    means = materialize(effect_means(spark, folder))
    lettered = K.letter_groups(means, M.pairwise_contrasts(means))
    return K.blank_letters(K.signif_by_letters(lettered))


@register(
    "label_position",
    exact=["family", "treatment", "x", "place"],
    sig=["label_y"],
    sql=f"""WITH {OBS}, {MEANS},
g AS (SELECT *, max(emmean) OVER (PARTITION BY family, x) AS top, min(emmean) OVER (PARTITION BY family, x) AS low,
 min(emmean - se) OVER (PARTITION BY family, x) AS bar FROM means)
SELECT family, treatment, x, 'above' AS place, top + se AS label_y FROM g
UNION ALL SELECT family, treatment, x, 'below', low - se FROM g
UNION ALL SELECT family, treatment, x, 'below_bar', bar FROM g
UNION ALL SELECT family, treatment, x, 'beside', CASE WHEN emmean = top THEN emmean + 1.5 * se ELSE emmean - 1.5 * se END FROM g""",
)
def label_position_query(spark, folder):
    means = materialize(four_means(spark, folder, None))
    out = None
    for place in ("above", "below", "below_bar", "beside"):
        part = W.label_position(means, place).withColumn("place", F.lit(place))
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "trend_slopes",
    exact=["family", "treatment", "df"],
    sig=["slope", "se", "lower", "upper"],
    sql=f"""WITH {DAY_OBS}, {LINES}, s AS (SELECT family, treatment, slope, sigma / sqrt(sxx) AS se, df FROM lines JOIN pooled USING (family))
SELECT *, slope - {t_crit_sql('df')} * se AS lower, slope + {t_crit_sql('df')} * se AS upper FROM s""",
)
def trend_slopes_query(spark, folder):
    return M.trend_slopes(day_lines(spark, folder))


@register(
    "trend_test",
    exact=["family", "treatment", "df"],
    sig=["slope", "se", "t"],
    prob=["p"],
    sql=f"""WITH {DAY_OBS}, {LINES}, s AS (SELECT family, treatment, slope, sigma / sqrt(sxx) AS se, df, slope / (sigma / sqrt(sxx)) AS t FROM lines JOIN pooled USING (family))
SELECT *, {t_p_sql('t', 'df')} AS p FROM s""",
)
def trend_test_query(spark, folder):
    return M.trend_test(M.trend_slopes(day_lines(spark, folder), None))


@register(
    "trend_contrasts",
    exact=["family", "level_a", "level_b", "df"],
    sig=["difference", "se", "t"],
    prob=["p"],
    sql=f"""WITH {DAY_OBS.replace('l_linestatus', 'l_returnflag')}, {LINES},
s AS (SELECT family, treatment, slope, sigma / sqrt(sxx) AS se, df FROM lines JOIN pooled USING (family)),
pairs AS (SELECT a.family, a.treatment AS level_a, b.treatment AS level_b, a.df, a.slope - b.slope AS difference, sqrt(a.se ** 2 + b.se ** 2) AS se
 FROM s a JOIN s b ON a.family = b.family AND a.treatment < b.treatment),
numbered AS (SELECT *, difference / se AS t, row_number() OVER () AS rid, abs(difference / se) * sqrt(2.0) AS q, 3 AS k FROM pairs),
{range_p_ctes('numbered')}
SELECT numbered.*, p FROM numbered JOIN ranged USING (rid)""",
)
def trend_contrasts_query(spark, folder):
    return M.trend_contrasts(M.trend_slopes(day_lines(spark, folder, "l_returnflag"), None))


@register(
    "trend_letters",
    exact=["family", "treatment", "letters"],
    sig=["slope"],
    sql=f"""WITH {DAY_OBS}, {LINES},
s AS (SELECT family, treatment, slope, sigma / sqrt(sxx) AS se, df FROM lines JOIN pooled USING (family)),
pairs AS (SELECT a.family, a.treatment AS level_a, a.df, a.slope - b.slope AS difference, (a.slope - b.slope) / sqrt(a.se ** 2 + b.se ** 2) AS t
 FROM s a JOIN s b ON a.family = b.family AND a.treatment < b.treatment),
tested AS (SELECT *, {t_p_sql('t', 'df')} AS p FROM pairs)
SELECT s.family, treatment, slope, CASE WHEN p >= 0.05 OR (treatment = level_a) = (difference > 0) THEN 'a' ELSE 'b' END AS letters
FROM s JOIN tested t ON s.family = t.family""",
)
def trend_letters_query(spark, folder):
    slopes = materialize(M.trend_slopes(day_lines(spark, folder), None))
    return K.letter_groups(slopes, M.trend_contrasts(slopes), by=["family"], value="slope")


@register(
    "errorbar_table",
    exact=["family", "treatment", "x"],
    sig=["se", "ymin", "ymax"],
    sql=f"""WITH {OBS}, {MEANS}, z AS (SELECT * REPLACE (CASE WHEN x = 3 THEN 0.0 ELSE se END AS se) FROM means)
SELECT *, emmean - se AS ymin, emmean + se AS ymax FROM z""",
)
def errorbar_table_query(spark, folder):
    return V.errorbar_table(four_means(spark, folder, None), zero_at=3)


@register(
    "paired_means",
    exact=["treatment", "x"],
    sig=["quantity", "quantity_se", "price", "price_se"],
    sql=f"""WITH {OBS}, {MEANS}
SELECT a.treatment, a.x, a.emmean AS quantity, a.se AS quantity_se, b.emmean AS price, b.se AS price_se
FROM means a LEFT JOIN means b ON a.treatment = b.treatment AND a.x = b.x AND b.family = 'l_extendedprice'
WHERE a.family = 'l_quantity'""",
)
def paired_means_query(spark, folder):
    means = materialize(four_means(spark, folder, None))
    pick = lambda f: means.where(F.col("family") == f)
    return V.paired_means(pick("l_quantity"), pick("l_extendedprice"), "quantity", "price")


@register(
    "component_check",
    exact=["treatment", "x"],
    sig=["discount", "tax", "total", "whole"],
    sql=f"""SELECT l_linestatus AS treatment, l_linenumber AS x, avg(l_discount) AS discount, avg(l_tax) AS tax,
 avg(l_discount) + avg(l_tax) AS total, avg(l_discount + l_tax) AS whole FROM lineitem GROUP BY 1, 2""",
)
def component_check_query(spark, folder):
    both = {"discount": "l_discount", "tax": "l_tax", "both": F.col("l_discount") + F.col("l_tax")}
    cells = cell_stats(lineitem(spark, folder), both, "l_linestatus", "l_linenumber")
    means = materialize(M.emmeans_cell(materialize(cells), None))
    pick = lambda f: means.where(F.col("family") == f)
    return R.component_check({"discount": pick("discount"), "tax": pick("tax")}, pick("both"))


@register(
    "response_ratio",
    exact=["treatment", "x"],
    sig=["price", "quantity", "tax", "price_per_unit", "tax_per_price"],
    sql="""SELECT l_linestatus AS treatment, l_linenumber AS x, avg(l_extendedprice) AS price, avg(l_quantity) AS quantity, avg(l_tax) AS tax,
 avg(l_extendedprice) / avg(l_quantity) AS price_per_unit, avg(l_tax) / avg(l_extendedprice) AS tax_per_price FROM lineitem GROUP BY 1, 2""",
)
def response_ratio_query(spark, folder):
    means = materialize(four_means(spark, folder, None))
    pick = lambda f: means.where(F.col("family") == f)
    return R.response_ratio(
        {"price": pick("l_extendedprice"), "quantity": pick("l_quantity"), "tax": pick("l_tax")},
        {"price_per_unit": ("price", "quantity"), "tax_per_price": ("tax", "price")},
    )


@register(
    "response_report",
    exact=["family", "treatment", "x", "n", "df", "signif"],
    sig=["emmean", "se", "ymin", "ymax", "label_y"],
    prob=["p"],
    sql=f"""WITH obs AS (SELECT treatment, x, family, y FROM (SELECT l_linestatus AS treatment, l_linenumber AS x, l_quantity, l_tax, {EFFECT_SQL} AS effect FROM lineitem)
 UNPIVOT (y FOR family IN (l_quantity, l_tax, effect))), {PAIRS}
SELECT m.family, m.treatment, m.x, n, m.df, emmean, m.se, emmean - m.se AS ymin, emmean + m.se AS ymax, p,
 CASE WHEN p < 0.05 THEN '*' WHEN p > 0.05 AND p < 0.1 THEN '.' END AS signif, max(emmean) OVER (PARTITION BY m.family, m.x) + m.se AS label_y
FROM means m JOIN tested t ON m.family = t.family AND m.x = t.x""",
)
def response_report_query(spark, folder):
    """The whole way from raw rows to the chart table, three responses in one job."""
    responses = {"l_quantity": "l_quantity", "l_tax": "l_tax", "effect": effect_response()}
    return response_report(lineitem(spark, folder), responses, "l_linestatus", "l_linenumber")


@register(
    "response_report_one_side",
    exact=["family", "treatment", "x", "signif"],
    sig=["emmean", "label_y"],
    prob=["p"],
    sql=f"""WITH {EFFECT_OBS}, {PAIRS}
SELECT m.family, m.treatment, m.x, emmean, CASE WHEN m.treatment = 'O' THEN p END AS p,
 CASE WHEN m.treatment = 'O' AND p < 0.05 THEN '*' WHEN m.treatment = 'O' AND p > 0.05 AND p < 0.1 THEN '.' END AS signif,
 max(emmean) OVER (PARTITION BY m.family, m.x) + m.se AS label_y
FROM means m JOIN tested t ON m.family = t.family AND m.x = t.x""",
)
def response_report_one_side_query(spark, folder):
    """The report with the test written on the rows of one treatment only."""
    responses = {"effect": effect_response()}
    return response_report(
        lineitem(spark, folder), responses, "l_linestatus", "l_linenumber", test_on="O"
    )
