"""Growth curve queries; their SQL runs the same number of Gauss-Newton steps as unrolled CTEs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from trialframe.catalog.base import register, table
from trialframe.catalog.linear import LINES
from trialframe.catalog.standins import (
    BREAKS,
    DAY_SQL,
    cells_sql,
    chi2_p_sql,
    det_sql,
    f_p_sql,
    lineitem,
    t_crit_sql,
    t_p_sql,
)
from trialframe.operators import curves as C
from trialframe.operators import linear as L
from trialframe.operators.cells import cell_stats, line_moments
from trialframe.operators.charts import smooth_curve
from trialframe.operators.means import emmeans_cell
from trialframe.plans.curve_comparison import compare_curves
from trialframe.plans.growth_rates import growth_rate_report
from trialframe.session import materialize
from trialframe.sources import factor_grid

# ---- planted growth data: a season of about 180 steps along the ship date ----

_GROWTH = {
    # family: (asym, xmid, scal) of F, of O, noise column, noise factor
    "shoot": ((20.0, 80.0, 20.0), (24.0, 90.0, 22.0), "l_discount", 20.0),
    "root": ((10.0, 60.0, 15.0), (12.0, 66.0, 16.0), "l_tax", 15.0),
}
SEASON_SQL = f"CAST(floor({DAY_SQL} / 14.0) AS INTEGER)"
START = {"asym": 18.0, "xmid": 80.0, "scal": 20.0}


def _planted(family: str):
    f, o, noise, factor = _GROWTH[family]
    is_f = F.col("l_linestatus") == "F"
    asym, xmid, scal = (F.when(is_f, a).otherwise(b) for a, b in zip(f, o))
    return asym / (F.lit(1.0) + F.exp((xmid - F.col("x")) / scal)) + F.col(noise) * factor


def _planted_sql(family: str) -> str:
    f, o, noise, factor = _GROWTH[family]
    asym, xmid, scal = (
        f"(CASE WHEN l_linestatus = 'F' THEN {a}::DOUBLE ELSE {b}::DOUBLE END)" for a, b in zip(f, o)
    )
    return f"({asym} / (1 + exp(({xmid} - {SEASON_SQL}) / {scal})) + {noise} * {factor}::DOUBLE)"


def season(spark, folder):
    return lineitem(spark, folder).withColumn("x", F.floor(F.col("day") / 14.0).cast("int"))


def growth_cells(spark, folder):
    return cell_stats(
        season(spark, folder), {f: _planted(f) for f in _GROWTH}, "l_linestatus", "x"
    )


GROWTH_OBS = "obs AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS family, l_linestatus AS treatment, {SEASON_SQL} AS x, {_planted_sql(f)} AS y FROM lineitem"
    for f in _GROWTH
) + ")"
GROWTH = f"{GROWTH_OBS}, {cells_sql()}"

# ---- Gauss-Newton as SQL ----

_CURVES = {
    "logistic": (
        ("asym", "xmid", "scal"),
        "asym / (1 + exp((xmid - x) / scal))",
        (
            "1 / (1 + exp((xmid - x) / scal))",
            "-asym * exp((xmid - x) / scal) / scal / (1 + exp((xmid - x) / scal)) ** 2",
            "asym * exp((xmid - x) / scal) * (xmid - x) / (scal * scal) / (1 + exp((xmid - x) / scal)) ** 2",
        ),
    ),
    "asymptotic": (
        ("asym", "lrc", "c0"),
        "asym * (1 - exp(-exp(lrc) * (x - c0)))",
        (
            "1 - exp(-exp(lrc) * (x - c0))",
            "asym * exp(-exp(lrc) * (x - c0)) * exp(lrc) * (x - c0)",
            "-asym * exp(-exp(lrc) * (x - c0)) * exp(lrc)",
        ),
    ),
    "broken_line": (
        ("start", "slope", "turn", "brk"),
        "start + slope * x + CASE WHEN x > brk THEN turn * (x - brk) ELSE 0 END",
        ("1", "x", "CASE WHEN x > brk THEN x - brk ELSE 0 END", "CASE WHEN x > brk THEN -turn ELSE 0 END"),
    ),
}
_logistic = _CURVES["logistic"]
_CURVES["logistic_offset"] = (
    (*_logistic[0], "shift"),
    _logistic[1] + " + shift",
    (*_logistic[2], "1"),
)
_own = "(CASE WHEN treatment = 'F' THEN asym_F ELSE asym_O END)"
_shared = [g.replace("asym", _own) for g in _logistic[2]]
_CURVES["shared_logistic"] = (
    ("asym_F", "asym_O", "xmid", "scal"),
    _logistic[1].replace("asym", _own),
    (
        f"CASE WHEN treatment = 'F' THEN {_logistic[2][0]} ELSE 0 END",
        f"CASE WHEN treatment = 'O' THEN {_logistic[2][0]} ELSE 0 END",
        _shared[1],
        _shared[2],
    ),
)


def newton_sql(
    curve: str, keys: Sequence[str], starts: str, rounds: int = 12, cells: str = "cells", tag: str = "fits"
) -> str:
    """CTEs that end in a table ``tag``: keys, parameters, rss, n, and c_i_j = inverse of J'J."""
    params, value, gradient = _CURVES[curve]
    size = len(params)
    on = " AND ".join(f"c.{k} = s.{k}" for k in keys) or "TRUE"
    k = ", ".join(keys)
    ck = ", ".join(f"c.{v}" for v in keys)
    gram = [[f"g{min(i, j)}{max(i, j)}" for j in range(size)] for i in range(size)]
    sums = [f"sum(n * j{i} * j{j}) AS g{i}{j}" for i in range(size) for j in range(i, size)]
    sums += [f"sum(n * j{i} * r) AS b{i}" for i in range(size)]
    sums += [f"any_value({p}) AS {p}" for p in params]
    sums += ["sum(n * r * r + ss) AS rss", "CAST(sum(n) AS BIGINT) AS n"]
    out = [f"{tag}_p0 AS ({starts})"]
    for step in range(rounds + 1):
        out.append(
            f"{tag}_r{step} AS (SELECT {ck}, n, ss, {', '.join(params)}, mean - ({value}) AS r, "
            + ", ".join(f"{g} AS j{i}" for i, g in enumerate(gradient))
            + f" FROM {cells} c JOIN {tag}_p{step} s ON {on})"
        )
        out.append(f"{tag}_s{step} AS (SELECT {k}, {', '.join(sums)} FROM {tag}_r{step} GROUP BY {k})")
        if step == rounds:
            break
        moves = []
        for i, p in enumerate(params):
            swapped = [row[:i] + [f"b{n}"] + row[i + 1 :] for n, row in enumerate(gram)]
            moves.append(f"{p} + ({det_sql(swapped)}) / ({det_sql(gram)}) AS {p}")
        out.append(f"{tag}_p{step + 1} AS (SELECT {k}, {', '.join(moves)} FROM {tag}_s{step})")
    inverse = []
    for i in range(size):
        for j in range(size):
            minor = [row[:i] + row[i + 1 :] for n, row in enumerate(gram) if n != j]
            sign = "-" if (i + j) % 2 else ""
            inverse.append(f"{sign}({det_sql(minor)}) / ({det_sql(gram)}) AS c{i}{j}")
    out.append(
        f"{tag} AS (SELECT {k}, {', '.join(params)}, rss, n, {', '.join(inverse)} FROM {tag}_s{rounds})"
    )
    return ",\n".join(out)


_START_SQL = ", ".join(f"{v}::DOUBLE AS {p}" for p, v in START.items())
NULL_FITS = newton_sql("logistic", ["family"], f"SELECT DISTINCT family, {_START_SQL} FROM cells", tag="nulls")
FULL_FITS = newton_sql(
    "logistic", ["family", "treatment"], f"SELECT DISTINCT family, treatment, {_START_SQL} FROM cells"
)
ERROR = """err AS (SELECT family, CAST(sum(n) AS BIGINT) AS n, sum(rss) AS rss, count(*) * 3 AS parameters,
 CAST(sum(n) - 3 * count(*) AS BIGINT) AS df, sqrt(sum(rss) / (sum(n) - 3 * count(*))) AS sigma FROM fits GROUP BY family)"""
SUMMARY = f"""{ERROR},
summary AS (SELECT f.family, f.treatment, param, estimate, sigma * sqrt(v) AS se, df, estimate / (sigma * sqrt(v)) AS t
 FROM fits f JOIN err e ON f.family = e.family
 CROSS JOIN LATERAL (VALUES ('asym', asym, c00), ('xmid', xmid, c11), ('scal', scal, c22)) AS u(param, estimate, v))"""


def _full(spark, folder):
    return materialize(C.fit_curve(growth_cells(spark, folder), C.LOGISTIC, START))


@register(
    "logistic_fit_null",
    exact=["family", "n", "converged"],
    sig=["asym", "xmid", "scal", "rss"],
    sql=f"WITH {GROWTH}, {NULL_FITS} SELECT *, true AS converged FROM nulls",
)
def logistic_fit_null_query(spark, folder):
    return C.fit_curve(growth_cells(spark, folder), C.LOGISTIC, START, keys=["family"])


@register(
    "logistic_fit_full",
    exact=["family", "treatment", "n", "converged"],
    sig=["asym", "xmid", "scal", "rss"],
    sql=f"WITH {GROWTH}, {FULL_FITS} SELECT *, true AS converged FROM fits",
)
def logistic_fit_full_query(spark, folder):
    return _full(spark, folder)


@register(
    "logistic_fit_shared",
    exact=["family", "n", "converged"],
    sig=["asym_F", "asym_O", "xmid", "scal", "rss"],
    sql=f"""WITH {GROWTH}, {newton_sql('shared_logistic', ['family'],
    'SELECT DISTINCT family, 18.0::DOUBLE AS asym_F, 18.0::DOUBLE AS asym_O, 80.0::DOUBLE AS xmid, 20.0::DOUBLE AS scal FROM cells')}
SELECT *, true AS converged FROM fits""",
)
def logistic_fit_shared_query(spark, folder):
    curve = C.shared_logistic(["F", "O"])
    starts = {"asym_F": 18.0, "asym_O": 18.0, "xmid": 80.0, "scal": 20.0}
    return C.fit_curve(growth_cells(spark, folder), curve, starts, keys=["family"])


@register(
    "logistic_starts",
    exact=["family", "treatment"],
    sig=["asym", "xmid", "scal"],
    sql=f"""WITH {GROWTH}, span AS (SELECT family, treatment, min(mean) AS lo, max(mean) - min(mean) AS w FROM cells GROUP BY family, treatment),
z AS (SELECT c.family, c.treatment, x, mean, n, (mean - lo + 0.05 * w) / (1.1 * w) AS u FROM cells c JOIN span s ON c.family = s.family AND c.treatment = s.treatment),
shape AS (SELECT family, treatment, regr_intercept(x, ln(u / (1 - u))) AS xmid, regr_slope(x, ln(u / (1 - u))) AS scal FROM z GROUP BY family, treatment)
SELECT z.family, z.treatment, any_value(xmid) AS xmid, any_value(scal) AS scal,
 sum(n * mean / (1 + exp((xmid - x) / scal))) / sum(n / (1 + exp((xmid - x) / scal)) ** 2) AS asym
FROM z JOIN shape s ON z.family = s.family AND z.treatment = s.treatment GROUP BY z.family, z.treatment""",
)
def logistic_starts_query(spark, folder):
    return C.logistic_starts(materialize(growth_cells(spark, folder)))


@register(
    "logistic_self_start",
    exact=["family", "treatment", "n", "converged"],
    sig=["asym", "xmid", "scal", "rss"],
    sql=f"WITH {GROWTH}, {FULL_FITS} SELECT *, true AS converged FROM fits",
)
def logistic_self_start_query(spark, folder):
    return C.logistic_self_start(growth_cells(spark, folder))


@register(
    "logistic_offset_fit",
    exact=["family", "treatment", "n", "converged"],
    sig=["asym", "xmid", "scal", "shift", "rss"],
    sql=f"""WITH {GROWTH}, {newton_sql('logistic_offset', ['family', 'treatment'],
    f'SELECT DISTINCT family, treatment, {_START_SQL}, 0.5::DOUBLE AS shift FROM cells', rounds=14)}
SELECT *, true AS converged FROM fits""",
)
def logistic_offset_fit_query(spark, folder):
    starts = {**START, "offset": 0.5}
    fits = C.fit_curve(growth_cells(spark, folder), C.LOGISTIC_OFFSET, starts)
    return fits.withColumnRenamed("offset", "shift")


# ---- asymptotic curve: the empirical distribution of event values ----

_WIDTH = 10.0


def distribution_cells(spark, folder):
    """Share of values at or below each grid point, per event type, as cells.

    One count per bin and a running sum over the bins: rows are never copied to
    the grid points.
    """
    from pyspark.sql import Window

    bins = (
        table(spark, folder, "events")
        .select(
            F.col("event_type").alias("treatment"),
            F.greatest(F.ceil(F.col("value") / _WIDTH), F.lit(1)).alias("bin"),
        )
        .groupBy("treatment", "bin")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    bins = materialize(bins)
    grid = factor_grid(bins.select("treatment").distinct(), 1, 20, "bin")
    total = bins.groupBy("treatment").agg(F.sum("c").alias("n"))
    upto = Window.partitionBy("treatment").orderBy("bin")
    share = F.try_divide(F.col("upto"), F.col("n"))
    return (
        grid.join(bins, ["treatment", "bin"], "left")
        .withColumn("upto", F.sum(F.coalesce("c", F.lit(0))).over(upto))
        .join(total, "treatment")
        .select(
            F.lit("distribution").alias("family"),
            "treatment",
            (F.col("bin") * _WIDTH).alias("x"),
            "n",
            share.alias("mean"),
            (F.col("n") * share * (F.lit(1.0) - share)).alias("ss"),
        )
    )


DISTRIBUTION = f"""obs AS (SELECT 'distribution' AS family, event_type AS treatment, g * {_WIDTH}::DOUBLE AS x,
 CASE WHEN value <= g * {_WIDTH} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM events CROSS JOIN range(1, 21) AS grid(g)), {cells_sql()}"""
_ASYM_START = {"asym": 1.0, "lrc": -4.0, "c0": 0.5}
_ASYM_SQL = ", ".join(f"{v}::DOUBLE AS {p}" for p, v in _ASYM_START.items())


@register(
    "asymptotic_fit",
    exact=["family", "treatment", "n", "converged"],
    sig=["asym", "lrc", "c0", "rss"],
    sql=f"""WITH {DISTRIBUTION}, {newton_sql('asymptotic', ['family', 'treatment'], f'SELECT DISTINCT family, treatment, {_ASYM_SQL} FROM cells')}
SELECT *, true AS converged FROM fits""",
)
def asymptotic_fit_query(spark, folder):
    return C.fit_curve(distribution_cells(spark, folder), C.ASYMPTOTIC, _ASYM_START)


@register(
    "asymptotic_lr_test",
    exact=["family", "model_df_null", "model_df_full", "lr_df"],
    sig=["loglik_null", "loglik_full", "lr"],
    prob=["p"],
    sql=f"""WITH {DISTRIBUTION}, {newton_sql('asymptotic', ['family'], f'SELECT DISTINCT family, {_ASYM_SQL} FROM cells', tag='nulls')},
{newton_sql('asymptotic', ['family', 'treatment'], f'SELECT DISTINCT family, treatment, {_ASYM_SQL} FROM cells')}, {ERROR},
ll AS (SELECT e.family, CAST(4 AS BIGINT) AS model_df_null, CAST(e.parameters + 1 AS BIGINT) AS model_df_full, CAST(e.parameters - 3 AS BIGINT) AS lr_df,
 -e.n / 2.0 * (ln(2 * pi() * z.rss / e.n) + 1) AS loglik_null, -e.n / 2.0 * (ln(2 * pi() * e.rss / e.n) + 1) AS loglik_full FROM err e JOIN nulls z ON e.family = z.family),
tested AS (SELECT *, 2 * (loglik_full - loglik_null) AS lr FROM ll)
SELECT *, {chi2_p_sql('lr', 'lr_df')} AS p FROM tested""",
)
def asymptotic_lr_test_query(spark, folder):
    cells = materialize(distribution_cells(spark, folder))
    return compare_curves(cells, C.ASYMPTOTIC, _ASYM_START).test


# ---- what follows from a fit ----


@register(
    "curve_summary",
    exact=["family", "treatment", "param", "df"],
    sig=["estimate", "se", "t"],
    prob=["p"],
    sql=f"WITH {GROWTH}, {FULL_FITS}, {SUMMARY} SELECT *, {t_p_sql('t', 'df')} AS p FROM summary",
)
def curve_summary_query(spark, folder):
    return C.curve_summary(_full(spark, folder), C.LOGISTIC)


@register(
    "curve_wald_f",
    exact=["family", "param", "term", "df1", "df2"],
    sig=["f"],
    prob=["p"],
    sql=f"""WITH {GROWTH}, {FULL_FITS}, {SUMMARY},
wide AS (SELECT a.family, a.param, a.df AS df2, a.t ** 2 AS f_int, (a.estimate - b.estimate) ** 2 / (a.se ** 2 + b.se ** 2) AS f_trt
 FROM summary a JOIN summary b ON a.family = b.family AND a.param = b.param AND a.treatment = 'F' AND b.treatment = 'O'),
long AS (SELECT family, param, term, CAST(1 AS BIGINT) AS df1, df2, f FROM wide CROSS JOIN LATERAL (VALUES ('(intercept)', f_int), ('treatment', f_trt)) AS v(term, f))
SELECT *, {f_p_sql('f', 'df1', 'df2')} AS p FROM long""",
)
def curve_wald_f_query(spark, folder):
    return C.curve_wald_f(C.curve_summary(_full(spark, folder), C.LOGISTIC))


@register(
    "curve_lr_test",
    exact=["family", "model_df_null", "model_df_full", "lr_df"],
    sig=["aic_null", "bic_null", "loglik_null", "aic_full", "bic_full", "loglik_full", "lr"],
    prob=["p"],
    sql=f"""WITH {GROWTH}, {NULL_FITS}, {FULL_FITS}, {ERROR},
ll AS (SELECT e.family, e.n, CAST(4 AS BIGINT) AS model_df_null, CAST(e.parameters + 1 AS BIGINT) AS model_df_full, CAST(e.parameters - 3 AS BIGINT) AS lr_df,
 -e.n / 2.0 * (ln(2 * pi() * z.rss / e.n) + 1) AS loglik_null, -e.n / 2.0 * (ln(2 * pi() * e.rss / e.n) + 1) AS loglik_full FROM err e JOIN nulls z ON e.family = z.family),
tested AS (SELECT *, 2 * (loglik_full - loglik_null) AS lr, 2 * model_df_null - 2 * loglik_null AS aic_null, 2 * model_df_full - 2 * loglik_full AS aic_full,
 ln(n) * model_df_null - 2 * loglik_null AS bic_null, ln(n) * model_df_full - 2 * loglik_full AS bic_full FROM ll)
SELECT *, {chi2_p_sql('lr', 'lr_df')} AS p FROM tested""",
)
def curve_lr_test_query(spark, folder):
    return compare_curves(growth_cells(spark, folder), C.LOGISTIC, START).test


@register(
    "curve_param_contrasts",
    exact=["family", "param", "level_a", "level_b", "df"],
    sig=["difference", "se", "t"],
    prob=["p"],
    sql=f"""WITH {GROWTH}, {FULL_FITS}, {SUMMARY},
pairs AS (SELECT a.family, a.param, a.treatment AS level_a, b.treatment AS level_b, a.df, a.estimate - b.estimate AS difference, sqrt(a.se ** 2 + b.se ** 2) AS se,
 (a.estimate - b.estimate) / sqrt(a.se ** 2 + b.se ** 2) AS t FROM summary a JOIN summary b ON a.family = b.family AND a.param = b.param AND a.treatment < b.treatment)
SELECT *, {t_p_sql('t', 'df')} AS p FROM pairs""",
)
def curve_param_contrasts_query(spark, folder):
    return C.curve_param_contrasts(C.curve_summary(_full(spark, folder), C.LOGISTIC))


def _grid(spark, folder):
    levels = lineitem(spark, folder).select(F.col("l_linestatus").alias("treatment")).distinct()
    return factor_grid(levels, 1, 180)


@register(
    "predict_curve",
    exact=["family", "treatment", "x"],
    sig=["fitted"],
    sql=f"""WITH {GROWTH}, {FULL_FITS} SELECT family, treatment, CAST(g.x AS INTEGER) AS x, asym / (1 + exp((xmid - g.x) / scal)) AS fitted
FROM fits CROSS JOIN range(1, 181) AS g(x)""",
)
def predict_curve_query(spark, folder):
    return C.predict_curve(_grid(spark, folder), _full(spark, folder), C.LOGISTIC)


@register(
    "curve_conf_band",
    exact=["family", "treatment", "x"],
    sig=["fitted", "se", "lower", "upper"],
    sql=f"""WITH {GROWTH}, {FULL_FITS}, {ERROR},
at_x AS (SELECT f.*, CAST(g.x AS INTEGER) AS x, df, sigma, 1 / (1 + exp((xmid - g.x) / scal)) AS s FROM fits f JOIN err e ON f.family = e.family CROSS JOIN range(1, 181) AS g(x)),
grad AS (SELECT *, s AS u, -asym * s * (1 - s) / scal AS v, -asym * s * (1 - s) * (x - xmid) / (scal * scal) AS w FROM at_x),
band AS (SELECT family, treatment, x, df, asym * s AS fitted,
 sigma * sqrt(u * u * c00 + v * v * c11 + w * w * c22 + 2 * (u * v * c01 + u * w * c02 + v * w * c12)) AS se FROM grad)
SELECT *, fitted - {t_crit_sql('df')} * se AS lower, fitted + {t_crit_sql('df')} * se AS upper FROM band""",
)
def curve_conf_band_query(spark, folder):
    return C.curve_conf_band(_grid(spark, folder), _full(spark, folder), C.LOGISTIC)


@register(
    "curve_residuals",
    exact=["family", "treatment", "x", "n"],
    sig=["fitted", "sum_residual", "sum_sq", "worst"],
    sql=f"""WITH {GROWTH}, {FULL_FITS}, {ERROR},
r AS (SELECT o.family, o.treatment, o.x, asym / (1 + exp((xmid - o.x) / scal)) AS fitted, y - asym / (1 + exp((xmid - o.x) / scal)) AS residual, sigma
 FROM obs o JOIN fits f ON o.family = f.family AND o.treatment = f.treatment JOIN err e ON e.family = o.family)
SELECT family, treatment, x, count(*) AS n, min(fitted) AS fitted, round(sum(residual), 6) AS sum_residual, sum(residual * residual) AS sum_sq, max(abs(residual / sigma)) AS worst
FROM r GROUP BY family, treatment, x""",
)
def curve_residuals_query(spark, folder):
    """Residuals of every raw row, summed up per cell for the comparison."""
    rows = season(spark, folder).select(
        F.col("l_linestatus").alias("treatment"),
        "x",
        F.inline(
            F.array(*(F.struct(F.lit(f).alias("family"), _planted(f).alias("y")) for f in _GROWTH))
        ),
    )
    out = C.curve_residuals(rows, _full(spark, folder), C.LOGISTIC)
    return out.groupBy("family", "treatment", "x").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("fitted").alias("fitted"),
        F.round(F.sum("residual"), 6).alias("sum_residual"),
        F.sum(F.col("residual") * F.col("residual")).alias("sum_sq"),
        F.max(F.abs("standardised")).alias("worst"),
    )


@register(
    "curve_against_line",
    exact=["family", "model", "model_df"],
    sig=["aic", "bic"],
    sql=f"""WITH {GROWTH}, {FULL_FITS}, {ERROR}, {LINES},
models AS (SELECT family, 'curve' AS model, n, rss, parameters FROM err UNION ALL SELECT family, 'line', n_total, rss, parameters FROM pooled),
ll AS (SELECT *, -n / 2.0 * (ln(2 * pi() * rss / n) + 1) AS loglik, CAST(parameters + 1 AS BIGINT) AS model_df FROM models)
SELECT *, 2 * model_df - 2 * loglik AS aic, ln(n) * model_df - 2 * loglik AS bic FROM ll""",
)
def curve_against_line_query(spark, folder):
    """AIC and BIC of the growth curve and of straight lines on the same rows."""
    moments = line_moments(
        season(spark, folder), {f: _planted(f) for f in _GROWTH}, "x", "l_linestatus"
    )
    line = L.pooled_line_error(moments).select(
        "family", F.col("n_total").alias("n"), "rss", "parameters"
    )
    curve = C.curve_error(_full(spark, folder)).select("family", "n", "rss", "parameters")
    both = curve.withColumn("model", F.lit("curve")).unionByName(
        line.withColumn("model", F.lit("line"))
    )
    return L.information_criteria(both)


@register(
    "smooth_curve",
    exact=["family", "treatment", "x"],
    sig=["fitted"],
    sql=f"""WITH {GROWTH}, points AS (SELECT family, treatment, x, 1 AS n, mean, 0.0 AS ss FROM cells),
{newton_sql('logistic', ['family', 'treatment'], f'SELECT DISTINCT family, treatment, {_START_SQL} FROM cells', cells='points')}
SELECT family, treatment, CAST(g.x AS INTEGER) AS x, asym / (1 + exp((xmid - g.x) / scal)) AS fitted FROM fits CROSS JOIN range(1, 181) AS g(x)""",
)
def smooth_curve_query(spark, folder):
    """Curve through the means: every mean counts once."""
    means = emmeans_cell(materialize(growth_cells(spark, folder)), None)
    return smooth_curve(means, C.LOGISTIC, START, _grid(spark, folder))


# ---- broken line on the day of the month ----

_BREAK_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v + 0.4}" for k, v in BREAKS.items()) + " END"
BROKEN = f"""obs AS (SELECT 'value' AS family, event_type AS treatment, CAST(day(ts) AS INTEGER) AS x,
 10 + 2.0 * day(ts) - 1.5 * greatest(day(ts) - ({_BREAK_SQL}), 0) + value * 0.01 AS y FROM events), {cells_sql()}"""


def broken_cells(spark, folder):
    events = table(spark, folder, "events").withColumn("x", F.dayofmonth("ts"))
    at = F.create_map(*(F.lit(v) for k, b in BREAKS.items() for v in (k, b + 0.4)))
    past = F.greatest(F.col("x") - at[F.col("event_type")], F.lit(0.0))
    y = F.lit(10.0) + F.col("x") * 2.0 - past * 1.5 + F.col("value") * 0.01
    return cell_stats(events, {"value": y}, "event_type", "x")


# first guesses of the breaks, off the planted ones by up to two days
GUESSES = {"click": 10.0, "error": 9.0, "purchase": 13.0, "signup": 13.0, "view": 18.0}
BROKEN_FITS = newton_sql(
    "broken_line",
    ["family", "treatment"],
    f"SELECT DISTINCT family, treatment, 10.0::DOUBLE AS start, 2.0::DOUBLE AS slope, -1.5::DOUBLE AS turn, "
    + "CASE treatment "
    + " ".join(f"WHEN '{k}' THEN {v + 0.4}" for k, v in BREAKS.items())
    + " END::DOUBLE AS brk FROM cells",
)


@register(
    "segmented_fit",
    exact=["family", "treatment", "n", "converged"],
    sig=["start", "slope", "turn", "brk", "rss"],
    sql=f"WITH {BROKEN}, {BROKEN_FITS} SELECT *, true AS converged FROM fits",
)
def segmented_fit_query(spark, folder):
    fits = C.segmented_fit(broken_cells(spark, folder), GUESSES)
    return fits.withColumnRenamed("break", "brk")


@register(
    "segment_table",
    exact=["family", "treatment", "term", "df"],
    sig=["estimate", "se", "lower", "upper"],
    sql=f"""WITH {BROKEN}, {BROKEN_FITS}, err AS (SELECT family, CAST(sum(n) - 4 * count(*) AS BIGINT) AS df, sqrt(sum(rss) / (sum(n) - 4 * count(*))) AS sigma FROM fits GROUP BY family),
long AS (SELECT f.family, f.treatment, df, term, estimate, sigma * sqrt(v) AS se FROM fits f JOIN err e ON f.family = e.family
 CROSS JOIN LATERAL (VALUES ('slope_before', slope, c11), ('slope_after', slope + turn, c11 + c22 + 2 * c12), ('break', brk, c33)) AS u(term, estimate, v))
SELECT *, estimate - {t_crit_sql('df')} * se AS lower, estimate + {t_crit_sql('df')} * se AS upper FROM long""",
)
def segment_table_query(spark, folder):
    return C.segment_table(C.segmented_fit(broken_cells(spark, folder), GUESSES))


@register(
    "segmented_fitted",
    exact=["family", "treatment", "x"],
    sig=["fitted"],
    sql=f"""WITH {BROKEN}, {BROKEN_FITS} SELECT c.family, c.treatment, x, start + slope * x + CASE WHEN x > brk THEN turn * (x - brk) ELSE 0 END AS fitted
FROM cells c JOIN fits f ON c.treatment = f.treatment""",
)
def segmented_fitted_query(spark, folder):
    cells = materialize(broken_cells(spark, folder))
    fits = C.segmented_fit(cells, GUESSES)
    return C.predict_curve(cells.select("treatment", "x"), fits, C.BROKEN_LINE)


# ---- growth rates ----

_RATE_SQL = f"""{GROWTH}, {FULL_FITS}, line_obs AS (SELECT 'leaf' AS family, l_linestatus AS treatment, {SEASON_SQL} AS x, {SEASON_SQL} * 0.05 + l_quantity AS y FROM lineitem),
leaf AS (SELECT family, treatment, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM line_obs GROUP BY family, treatment),
preds AS (SELECT family, treatment, CAST(g.x AS INTEGER) AS x, asym / (1 + exp((xmid - g.x) / scal)) AS value FROM fits CROSS JOIN range(1, 181) AS g(x)
 UNION ALL SELECT family, treatment, CAST(g.x AS INTEGER), a + b * g.x FROM leaf CROSS JOIN range(1, 181) AS g(x)),
top AS (SELECT *, max(value) OVER (PARTITION BY family, treatment) AS top, CASE WHEN x = 1 THEN 0.0 ELSE value - lag(value) OVER (PARTITION BY family, treatment ORDER BY x) END AS rate FROM preds),
stages AS (SELECT family, treatment, min(x) FILTER (value >= top * 0.15) AS start_x, max(x) FILTER (value <= top * 0.85) AS end_x FROM top GROUP BY family, treatment),
rates AS (SELECT family, treatment, x, value, rate, rate / max(rate) OVER (PARTITION BY family) AS relative_rate, rate / sum(rate) OVER (PARTITION BY x, treatment) AS relative_allocation,
 max(CASE WHEN treatment = 'O' THEN rate END) OVER (PARTITION BY family, x) AS o, max(CASE WHEN treatment = 'F' THEN rate END) OVER (PARTITION BY family, x) AS f FROM top WHERE rate > 0)"""


@register(
    "growth_rate_report",
    exact=["family", "treatment", "x", "start_x", "end_x"],
    sig=["value", "rate", "relative_rate", "relative_allocation", "ratio", "difference"],
    sql=f"WITH {_RATE_SQL} SELECT r.*, start_x, end_x, o / f AS ratio, o - f AS difference FROM rates r JOIN stages s ON r.family = s.family AND r.treatment = s.treatment",
)
def growth_rate_report_query(spark, folder):
    """Two fitted curves and a line, predicted daily, turned into rates and stages."""
    grid = _grid(spark, folder)
    fits = materialize(C.logistic_self_start(growth_cells(spark, folder)))
    curves = C.predict_curve(grid, fits, C.LOGISTIC)
    leaf = {"leaf": F.col("x") * 0.05 + F.col("l_quantity")}
    moments = materialize(line_moments(season(spark, folder), leaf, "x", "l_linestatus"))
    line = L.predict_linear(grid, L.ancova_fit(moments))
    predictions = curves.unionByName(line).withColumnRenamed("fitted", "value")
    return growth_rate_report(predictions, "F", "O")
