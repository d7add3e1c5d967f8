"""Queries of general hypotheses, self-starting curves, dependent or many terms, and many levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.catalog.base import register
from trialframe.catalog.curves import (
    _ASYM_SQL,
    BROKEN,
    BROKEN_FITS,
    DISTRIBUTION,
    GROWTH,
    GUESSES,
    broken_cells,
    distribution_cells,
    growth_cells,
    newton_sql,
)
from trialframe.catalog.standins import DAY_SQL, cells_sql, det_sql, f_p_sql, fit_sql, lineitem, range_p_ctes, t_p_sql
from trialframe.operators import charts as V
from trialframe.operators import curves as C
from trialframe.operators import hypotheses as H
from trialframe.operators import least_squares as G
from trialframe.operators import letters as K
from trialframe.operators import linear as L
from trialframe.operators import means as M
from trialframe.operators.cells import cell_stats
from trialframe.session import materialize, written

# ---- hypotheses about a curve whose treatments share parameters ----

_OWN = {"F": "asym_F", "O": "asym_O"}
_SHARED_START = {"asym_F": 18.0, "asym_O": 18.0, "xmid": 80.0, "scal": 20.0}
_SHARED_SQL = ", ".join(f"{v}::DOUBLE AS {p}" for p, v in _SHARED_START.items())
SHARED = f"""{GROWTH}, {newton_sql('shared_logistic', ['family'], f'SELECT DISTINCT family, {_SHARED_SQL} FROM cells')},
shared AS (SELECT *, CAST(n - 4 AS BIGINT) AS df, rss / (n - 4) AS s2 FROM fits),
pairs AS (SELECT family, 'asym' AS param, 'F' AS level_a, 'O' AS level_b, df, asym_F, asym_O, s2, c00, c11, asym_F - asym_O AS difference,
 sqrt(s2 * (c00 + c11 - 2 * c01)) AS se, (asym_F - asym_O) / sqrt(s2 * (c00 + c11 - 2 * c01)) AS t FROM shared),
tested AS (SELECT *, {t_p_sql('t', 'df')} AS p FROM pairs)"""


def _shared_fits(spark, folder):
    curve = C.shared_logistic(["F", "O"])
    return materialize(C.fit_curve(growth_cells(spark, folder), curve, _SHARED_START, keys=["family"])), curve


@register(
    "shared_curve_contrasts",
    exact=["family", "param", "level_a", "level_b", "df"],
    sig=["difference", "se", "t"],
    prob=["p"],
    sql=f"WITH {SHARED} SELECT * FROM tested",
)
def shared_curve_contrasts_query(spark, folder):
    """Asymptotes of two treatments that share midpoint and scale; their covariance is part of the error."""
    return H.shared_contrasts(*_shared_fits(spark, folder), _OWN, "asym")


@register(
    "shared_curve_letters",
    exact=["family", "param", "treatment", "letters"],
    sig=["estimate", "se"],
    sql=f"""WITH {SHARED} SELECT family, param, v.treatment, v.estimate, v.se, CASE WHEN p >= 0.05 OR v.estimate = greatest(asym_F, asym_O) THEN 'a' ELSE 'b' END AS letters
FROM tested CROSS JOIN LATERAL (VALUES ('F', asym_F, sqrt(s2 * c00)), ('O', asym_O, sqrt(s2 * c11))) AS v(treatment, estimate, se)""",
)
def shared_curve_letters_query(spark, folder):
    fits, curve = _shared_fits(spark, folder)
    by = ["family", "param"]
    estimates = H.own_estimates(fits, curve, _OWN, "asym")
    return K.letter_groups(estimates, H.shared_contrasts(fits, curve, _OWN, "asym"), by, value="estimate")


@register(
    "shared_curve_wald_f",
    exact=["family", "term", "df1", "df2"],
    sig=["f"],
    prob=["p"],
    sql=f"""WITH {SHARED},
long AS (SELECT family, term, CAST(df1 AS BIGINT) AS df1, df AS df2, q / df1 / s2 AS f FROM shared CROSS JOIN LATERAL (VALUES
 ('asym:(intercept)', 1, asym_F ** 2 / c00),
 ('asym:all', 2, (asym_F ** 2 * c11 - 2 * asym_F * asym_O * c01 + asym_O ** 2 * c00) / (c00 * c11 - c01 * c01)),
 ('asym:treatment', 1, (asym_O - asym_F) ** 2 / (c00 + c11 - 2 * c01)),
 ('xmid', 1, xmid ** 2 / c22), ('scal', 1, scal ** 2 / c33)) AS v(term, df1, q))
SELECT *, {f_p_sql('f', 'df1', 'df2')} AS p FROM long""",
)
def shared_curve_wald_f_query(spark, folder):
    return H.shared_wald_f(*_shared_fits(spark, folder), _OWN, "asym")


@register(
    "linear_hypotheses",
    exact=["family", "hypothesis", "df"],
    sig=["estimate", "se", "t"],
    prob=["p"],
    sql=f"""WITH {SHARED},
long AS (SELECT family, hypothesis, df, estimate, sqrt(s2 * v) AS se, estimate / sqrt(s2 * v) AS t FROM shared CROSS JOIN LATERAL (VALUES
 ('mean asymptote', (asym_F + asym_O) / 2, (c00 + c11 + 2 * c01) / 4),
 ('midpoint in scales', xmid - 4 * scal, c22 + 16 * c33 - 8 * c23),
 ('excess of O over midpoint', 3 * asym_O - xmid, 9 * c11 + c22 - 6 * c12)) AS u(hypothesis, estimate, v))
SELECT *, {t_p_sql('t', 'df')} AS p FROM long""",
)
def linear_hypotheses_query(spark, folder):
    """Combinations of parameters that depend on each other."""
    combinations = {
        "mean asymptote": {"asym_F": 0.5, "asym_O": 0.5},
        "midpoint in scales": {"xmid": 1.0, "scal": -4.0},
        "excess of O over midpoint": {"asym_O": 3.0, "xmid": -1.0},
    }
    return H.linear_hypotheses(*_shared_fits(spark, folder), combinations)


# ---- curves that find their own start ----

_ASYM_FITS = newton_sql("asymptotic", ["family", "treatment"], f"SELECT DISTINCT family, treatment, {_ASYM_SQL} FROM cells")


@register(
    "asymptotic_self_start",
    exact=["family", "treatment", "n", "converged"],
    sig=["asym", "lrc", "c0", "rss"],
    sql=f"WITH {DISTRIBUTION}, {_ASYM_FITS} SELECT *, true AS converged FROM fits",
)
def asymptotic_self_start_query(spark, folder):
    return C.asymptotic_self_start(distribution_cells(spark, folder))


def _asymptotic_starts_sql(steps: int = 32, rounds: int = 3) -> str:
    """The grid search for the rate, refined round by round."""
    low, high = "ln(0.02::DOUBLE)", "ln(500.0::DOUBLE)"
    out = [
        """points AS (SELECT family, treatment, x - x0 AS d, span, mean - m AS e, n, x0, m FROM cells JOIN (
 SELECT family, treatment, min(x) AS x0, max(x) - min(x) AS span, sum(n * mean) / sum(n) AS m FROM cells GROUP BY family, treatment) AS s USING (family, treatment))""",
        f"best0 AS (SELECT DISTINCT family, treatment, ({low} + {high}) / 2 AS u FROM points)",
    ]
    for k in range(rounds):
        step = f"(({high} - {low}) / 2 / {steps}.0 ** {k + 1})"
        out.append(
            f"grid{k} AS (SELECT p.*, b.u + g * {step} AS u, exp(b.u + g * {step}) / p.span AS r,"
            f" (1 - exp(-exp(b.u + g * {step}) / p.span * p.d)) / (1 - exp(-exp(b.u + g * {step}))) AS w"
            f" FROM points p JOIN best{k} b USING (family, treatment) CROSS JOIN range({-steps}, {steps + 1}) AS gs(g))"
        )
        out.append(
            f"fit{k} AS (SELECT family, treatment, u, any_value(r) AS r, any_value(x0) AS x0, any_value(m) AS m, any_value(span) AS span, sum(n * w) / sum(n) AS mw,"
            f" sum(n * w * e) / (sum(n * w * w) - sum(n * w) ** 2 / sum(n)) AS b, sum(n * e * e) - sum(n * w * e) ** 2 / (sum(n * w * w) - sum(n * w) ** 2 / sum(n)) AS rss"
            f" FROM grid{k} GROUP BY family, treatment, u)"
        )
        out.append(f"best{k + 1} AS (SELECT * FROM fit{k} QUALIFY row_number() OVER (PARTITION BY family, treatment ORDER BY rss) = 1)")
    last = f"best{rounds}"
    out.append(f"raised AS (SELECT *, m - b * mw AS a, m - b * mw + b / (1 - exp(-r * span)) AS asym FROM {last})")
    return ",\n".join(out)


@register(
    "asymptotic_starts",
    exact=["family", "treatment"],
    sig=["asym", "lrc", "c0"],
    sql=f"WITH {DISTRIBUTION}, {_asymptotic_starts_sql()} SELECT family, treatment, asym, ln(r) AS lrc, x0 + ln(1 - a / asym) / r AS c0 FROM raised",
)
def asymptotic_starts_query(spark, folder):
    """Separable least squares: the rate by a refined grid, height and offset from sums."""
    return C.asymptotic_starts(materialize(distribution_cells(spark, folder)))


@register(
    "smooth_asymptotic",
    exact=["family", "treatment", "x"],
    sig=["fitted"],
    sql=f"""WITH {DISTRIBUTION}, points AS (SELECT family, treatment, x, 1 AS n, mean, 0.0 AS ss FROM cells),
{newton_sql('asymptotic', ['family', 'treatment'], f'SELECT DISTINCT family, treatment, {_ASYM_SQL} FROM cells', cells='points')}
SELECT family, treatment, x, asym * (1 - exp(-exp(lrc) * (x - c0))) AS fitted FROM fits JOIN cells USING (family, treatment)""",
)
def smooth_asymptotic_query(spark, folder):
    """The asymptotic curve through the means, without start values."""
    means = materialize(distribution_cells(spark, folder).withColumnRenamed("mean", "emmean"))
    return V.smooth_curve(means, C.ASYMPTOTIC, None, means.select("treatment", "x"))


@register(
    "logistic_offset_self_start",
    exact=["family", "treatment", "n", "converged"],
    sig=["asym", "xmid", "scal", "shift", "rss"],
    sql=f"""WITH {GROWTH}, {newton_sql('logistic_offset', ['family', 'treatment'],
    'SELECT DISTINCT family, treatment, 18.0::DOUBLE AS asym, 80.0::DOUBLE AS xmid, 20.0::DOUBLE AS scal, 0.5::DOUBLE AS shift FROM cells', rounds=14)}
SELECT *, true AS converged FROM fits""",
)
def logistic_offset_self_start_query(spark, folder):
    fits = C.self_start_fit(growth_cells(spark, folder), C.LOGISTIC_OFFSET)
    return fits.withColumnRenamed("offset", "shift")


_BREAK_SEARCH = f"WITH {BROKEN}, {BROKEN_FITS} SELECT *, true AS converged FROM fits"


@register(
    "segmented_search",
    exact=["family", "treatment", "n", "converged"],
    sig=["start", "slope", "turn", "brk", "rss"],
    sql=_BREAK_SEARCH,
)
def segmented_search_query(spark, folder):
    """Breaks found without a first guess."""
    return C.segmented_fit(broken_cells(spark, folder)).withColumnRenamed("break", "brk")


@register(
    "segmented_far_start",
    exact=["family", "treatment", "n", "converged"],
    sig=["start", "slope", "turn", "brk", "rss"],
    sql=_BREAK_SEARCH,
)
def segmented_far_start_query(spark, folder):
    """First guesses on the wrong side of the season."""
    far = {k: 29.0 if v < 12 else 2.0 for k, v in GUESSES.items()}
    return C.segmented_fit(broken_cells(spark, folder), far).withColumnRenamed("break", "brk")


@register(
    "profile_starts",
    exact=["family", "treatment"],
    sig=["start", "slope", "turn", "brk"],
    sql=f"""WITH {BROKEN},
splits AS (SELECT family, treatment, x AS lo, lead(x) OVER w AS hi, row_number() OVER w AS k, count(*) OVER (PARTITION BY family, treatment) AS m FROM cells WINDOW w AS (PARTITION BY family, treatment ORDER BY x)),
sided AS (SELECT s.family, s.treatment, lo, hi, c.x, c.n, c.mean, c.x <= lo AS early FROM splits s JOIN cells c ON s.family = c.family AND s.treatment = c.treatment WHERE k >= 2 AND m - k >= 2),
centred AS (SELECT *, sum(n * x) OVER w / sum(n) OVER w AS mx, sum(n * mean) OVER w / sum(n) OVER w AS my FROM sided WINDOW w AS (PARTITION BY family, treatment, lo, early)),
lines AS (SELECT family, treatment, lo, hi, early, sum(n * (x - mx) * (mean - my)) / sum(n * (x - mx) ** 2) AS b, any_value(my) - any_value(mx) * sum(n * (x - mx) * (mean - my)) / sum(n * (x - mx) ** 2) AS a
 FROM centred GROUP BY family, treatment, lo, hi, early),
places AS (SELECT l.family, l.treatment, l.lo, greatest(least((l.a - r.a) / (r.b - l.b), l.hi), l.lo) AS p FROM lines l JOIN lines r ON l.family = r.family AND l.treatment = r.treatment AND l.lo = r.lo AND l.early AND NOT r.early),
v AS (SELECT p.family, p.treatment, p.p, c.n, c.x, CASE WHEN c.x > p.lo THEN c.x - p.p ELSE 0 END AS z, c.mean AS y FROM places p JOIN cells c ON p.family = c.family AND p.treatment = c.treatment),
mid AS (SELECT family, treatment, p, sum(n * x) / sum(n) AS mx, sum(n * z) / sum(n) AS mz, sum(n * y) / sum(n) AS my FROM v GROUP BY family, treatment, p),
g AS (SELECT v.family, v.treatment, v.p, any_value(mx) AS mx, any_value(mz) AS mz, any_value(my) AS my, sum(n * (x - mx) ** 2) AS xx, sum(n * (z - mz) ** 2) AS zz, sum(n * (x - mx) * (z - mz)) AS xz,
 sum(n * (x - mx) * (y - my)) AS xy, sum(n * (z - mz) * (y - my)) AS yz, sum(n * (y - my) ** 2) AS yy FROM v JOIN mid ON v.family = mid.family AND v.treatment = mid.treatment AND v.p = mid.p GROUP BY v.family, v.treatment, v.p),
solved AS (SELECT *, (xy * zz - yz * xz) / (xx * zz - xz * xz) AS slope, (yz * xx - xy * xz) / (xx * zz - xz * xz) AS turn FROM g),
best AS (SELECT * FROM solved QUALIFY row_number() OVER (PARTITION BY family, treatment ORDER BY yy - slope * xy - turn * yz) = 1)
SELECT family, treatment, my - slope * mx - turn * mz AS start, slope, turn, p AS brk FROM best""",
)
def profile_starts_query(spark, folder):
    """The break of least residual among all places where a line can break."""
    return C.profile_starts(materialize(broken_cells(spark, folder))).withColumnRenamed("break", "brk")


# ---- terms that depend on others, and many terms ----


def _dependent_terms():
    x = F.col("day") / 1000.0
    room = F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)
    return {"x": x, "twice": x * 2.0 + 1.0, "x2": x * x, "room": room, "cold": F.lit(1.0) - room}


def _dependent_sql() -> str:
    """CTEs: centred sums of x, x², room and y by return flag, and the solution of the reduced model."""
    gram = [[f"g{min(i, j)}{max(i, j)}" for j in range(4)] for i in range(4)]
    a = [row[:3] for row in gram[:3]]
    det = det_sql(a)
    away = ("x - m0", "x2 - m1", "room - m2", "y - m3")
    sums = ", ".join(f"sum(({away[i]}) * ({away[j]})) AS g{i}{j}" for i in range(4) for j in range(i, 4))
    parts = []
    for i in range(3):
        swapped = [row[:i] + [f"g{min(n, 3)}3"] + row[i + 1 :] for n, row in enumerate(a)]
        parts.append(f"({det_sql(swapped)}) / ({det}) AS s{i}")
        for j in range(3):
            minor = [row[:i] + row[i + 1 :] for n, row in enumerate(a) if n != j]
            parts.append(f"{'-' if (i + j) % 2 else ''}({det_sql(minor)}) / ({det}) AS v{i}{j}")
    two = [[gram[i][j] for j in (0, 1)] for i in (0, 1)]
    two_y = [[gram[i][j] for j in (0, 1, 3)] for i in (0, 1, 3)]
    spread = " + ".join(f"m{i} * m{j} * v{i}{j}" for i in range(3) for j in range(3))
    return f"""v AS (SELECT l_returnflag AS family, {DAY_SQL} / 1000.0::DOUBLE AS x, ({DAY_SQL} / 1000.0::DOUBLE) ** 2 AS x2, CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS room, l_quantity AS y FROM lineitem),
m AS (SELECT family, count(*) AS n, avg(x) AS m0, avg(x2) AS m1, avg(room) AS m2, avg(y) AS m3 FROM v GROUP BY family),
g AS (SELECT v.family, any_value(n) AS n, any_value(m0) AS m0, any_value(m1) AS m1, any_value(m2) AS m2, any_value(m3) AS m3, {sums} FROM v JOIN m ON v.family = m.family GROUP BY v.family),
solved AS (SELECT *, {', '.join(parts)}, g33 - ({det_sql(two_y)}) / ({det_sql(two)}) AS taken2, ({det_sql(two_y)}) / ({det_sql(two)}) - ({det_sql(gram)}) / ({det}) AS taken3,
 ({det_sql(gram)}) / ({det}) AS rss FROM g),
fit AS (SELECT *, m3 - m0 * s0 - m1 * s1 - m2 * s2 AS c, 1.0 / n + {spread} AS vc, CAST(n - 4 AS BIGINT) AS df, sqrt(rss / (n - 4)) AS sigma FROM solved)"""


@register(
    "gram_ols_aliased",
    exact=["family", "term", "parameters", "df", "aliased"],
    sig=["estimate", "se", "t"],
    prob=["p"],
    sql=f"""WITH {_dependent_sql()},
long AS (SELECT family, term, CAST(4 AS BIGINT) AS parameters, df, estimate IS NULL AS aliased, estimate, sigma * sqrt(u) AS se, estimate / (sigma * sqrt(u)) AS t FROM fit CROSS JOIN LATERAL (VALUES
 ('(intercept)', c, vc), ('x', s0, v00), ('twice', NULL, NULL), ('x2', s1, v11), ('room', s2, v22), ('cold', NULL, NULL)) AS w(term, estimate, u))
SELECT *, CASE WHEN t IS NOT NULL THEN {t_p_sql('t', 'df')} END AS p FROM long""",
)
def gram_ols_aliased_query(spark, folder):
    """Two of five terms depend on others: they are set aside, the rest is fitted."""
    return G.gram_ols(lineitem(spark, folder), "l_quantity", _dependent_terms(), "l_returnflag")


@register(
    "sequential_ols_anova",
    exact=["family", "term_order", "term", "df"],
    sig=["ss", "ms", "f"],
    prob=["p"],
    sql=f"""WITH {_dependent_sql()},
long AS (SELECT family, term_order, term, CAST(d AS BIGINT) AS df, ss, CASE WHEN d > 0 THEN ss / d END AS ms, fit.df AS rdf, sigma ** 2 AS ems FROM fit CROSS JOIN LATERAL (VALUES
 (1, 'season', 2, taken2), (2, 'place', 1, taken3), (3, 'residual', fit.df, rss)) AS w(term_order, term, d, ss)),
tested AS (SELECT *, CASE WHEN term_order < 3 THEN ms / ems END AS f FROM long)
SELECT *, CASE WHEN f IS NOT NULL THEN {f_p_sql('f', 'df', 'rdf')} END AS p FROM tested""",
)
def sequential_ols_anova_query(spark, folder):
    """What groups of terms take from the residual, in their order."""
    terms = _dependent_terms()
    gram = G.gram_table(lineitem(spark, folder), "l_quantity", terms, "l_returnflag")
    return G.sequential_anova(gram, list(terms), {"season": ["x", "twice", "x2"], "place": ["room", "cold"]})


_WAVES = 20


def _waves():
    turn = F.col("day") * (2 * 3.141592653589793 / 365.0)
    pairs = [(f"{f.__name__}{k}", f(turn * k)) for k in range(1, _WAVES + 1) for f in (F.cos, F.sin)]
    return dict(pairs)


def _waves_sql() -> str:
    turn = f"({DAY_SQL} * (2 * 3.141592653589793::DOUBLE / 365.0::DOUBLE))"
    names = [f"{f}({turn} * {k})" for k in range(1, _WAVES + 1) for f in ("cos", "sin")] + ["l_quantity"]
    size = len(names)
    values = ", ".join(f"{e} AS v{i}" for i, e in enumerate(names))
    means = ", ".join(f"avg(v{i}) AS m{i}" for i in range(size))
    sums = ", ".join(f"sum((v{i} - m{i}) * (v{j} - m{j}))" for i in range(size) for j in range(i, size))
    return f"""WITH v AS (SELECT l_returnflag AS family, {values} FROM lineitem),
m AS (SELECT family, count(*) AS n, {means} FROM v GROUP BY family),
g AS (SELECT v.family, any_value(n) AS n, [{sums}] AS gram FROM v JOIN m ON v.family = m.family GROUP BY v.family)
SELECT family, n, CAST(i AS INTEGER) AS i, round(gram[i + 1], 4) AS value FROM g CROSS JOIN range({size * (size + 1) // 2}) AS r(i)"""


@register("gram_table_many_terms", exact=["family", "n", "i"], sig=["value"], sql=_waves_sql())
def gram_table_many_terms_query(spark, folder):
    """Forty harmonics of the season: dense blocks, one pass over the rows."""
    gram = G.gram_table(lineitem(spark, folder), "l_quantity", _waves(), "l_returnflag")
    long = gram.select("family", "n", F.posexplode("gram").alias("i", "value"))
    return long.withColumn("value", F.round("value", 4))  # sums near zero have no digits of their own


# ---- many levels ----

_PART_OBS = "obs AS (" + " UNION ALL ".join(
    f"SELECT '{y}' AS family, l_partkey AS treatment, l_returnflag AS x, {y} AS y FROM lineitem" for y in ("l_quantity", "l_discount")
) + ")"


@register(
    "anova_factorial_many_levels",
    exact=["family", "term_order", "term", "df"],
    sig=["ss", "f"],
    sql=f"""WITH {_PART_OBS}, {cells_sql()},
m AS (SELECT family, avg(y) AS my, count(*) AS n FROM obs GROUP BY family),
t AS (SELECT family, treatment, avg(y) AS ty, count(*) AS n FROM obs GROUP BY family, treatment),
d AS (SELECT family, x, avg(y) AS dy, count(*) AS n FROM obs GROUP BY family, x),
wide AS (SELECT t.family, t.treatment, t.n, coalesce(max(CASE WHEN x = 'A' THEN c.n END), 0) AS na, coalesce(max(CASE WHEN x = 'N' THEN c.n END), 0) AS nn,
 coalesce(max(CASE WHEN x = 'A' THEN c.n * (mean - ty) END), 0) AS ba, coalesce(max(CASE WHEN x = 'N' THEN c.n * (mean - ty) END), 0) AS bn
 FROM cells c JOIN t ON c.family = t.family AND c.treatment = t.treatment GROUP BY t.family, t.treatment, t.n),
eq AS (SELECT family, sum(na - na * na * 1.0 / n) AS aa, sum(nn - nn * nn * 1.0 / n) AS bb, -sum(na * nn * 1.0 / n) AS ab, sum(ba) AS u, sum(bn) AS v, count(*) AS levels FROM wide GROUP BY family),
given AS (SELECT family, levels, (bb * u * u - 2 * ab * u * v + aa * v * v) / (aa * bb - ab * ab) AS ss_dt FROM eq),
parts AS (SELECT m.family, n, levels, ss_dt, (SELECT sum(t.n * (ty - my) ** 2) FROM t WHERE t.family = m.family) AS ss_t, (SELECT sum(d.n * (dy - my) ** 2) FROM d WHERE d.family = m.family) AS ss_d,
 (SELECT sum(c.n * (mean - my) ** 2) FROM cells c WHERE c.family = m.family) AS ss_c, (SELECT sum(ss) FROM cells c WHERE c.family = m.family) AS rss,
 (SELECT count(*) FROM cells c WHERE c.family = m.family) AS k FROM m JOIN given USING (family)),
long AS (SELECT family, term_order, term, CAST(df AS BIGINT) AS df, ss, ss / df AS ms, rss / (n - k) AS ems FROM parts CROSS JOIN LATERAL (VALUES
 (1, 'x', 2, ss_d), (2, 'treatment', levels - 1, ss_t + ss_dt - ss_d), (3, 'treatment:x', k - levels - 2, ss_c - ss_t - ss_dt), (4, 'residual', n - k, rss)) AS w(term_order, term, df, ss))
SELECT family, term_order, term, df, ss, CASE WHEN term_order < 4 THEN ms / ems END AS f FROM long""",
)
def anova_factorial_many_levels_query(spark, folder):
    """Parts as the treatment: thousands of levels, solved without their pairs."""
    cells = cell_stats(lineitem(spark, folder), ["l_quantity", "l_discount"], "l_partkey", "l_returnflag")
    return L.anova_factorial(materialize(cells), first="x")


_TWO_LARGE = "obs AS (SELECT 'l_quantity' AS family, l_partkey AS treatment, l_suppkey AS x, l_quantity AS y FROM lineitem)"


def _alternating_sql(rounds: int = 14) -> str:
    """The additive model by turns: means by supplier of what the parts leave, then by part of what the suppliers leave."""
    out = ["a0 AS (SELECT treatment, sum(n * mean) / sum(n) AS a FROM cells GROUP BY treatment)"]
    for k in range(rounds):
        out.append(f"b{k} AS (SELECT x, sum(n * (mean - a)) / sum(n) AS b FROM cells JOIN a{k} USING (treatment) GROUP BY x)")
        out.append(f"a{k + 1} AS (SELECT treatment, sum(n * (mean - b)) / sum(n) AS a FROM cells JOIN b{k} USING (x) GROUP BY treatment)")
    last = f"FROM cells JOIN a{rounds} USING (treatment) JOIN b{rounds - 1} USING (x)"
    out.append(f"additive AS (SELECT sum(n * (mean - a - b) ** 2) AS left_over, (SELECT count(*) FROM a0) AS k, (SELECT count(*) FROM b0) AS m {last})")
    return ",\n".join(out)


@register(
    "anova_factorial_two_large",
    exact=["family", "term_order", "term", "df"],
    sig=["ss", "f"],
    sql=f"""WITH {_TWO_LARGE}, {cells_sql()}, {_alternating_sql()},
whole AS (SELECT 'l_quantity' AS family, count(*) AS n, avg(y) AS my, var_pop(y) * count(*) AS tss FROM obs),
parts AS (SELECT family, n, tss, left_over, k, m, (SELECT sum(ss) FROM cells) AS rss, (SELECT count(*) FROM cells) AS cells,
 (SELECT sum(c * (v - my) ** 2) FROM (SELECT avg(y) AS v, count(*) AS c FROM obs GROUP BY treatment)) AS ss_t FROM whole CROSS JOIN additive),
long AS (SELECT family, term_order, term, CAST(df AS BIGINT) AS df, ss, ss / df AS ms, rss / (n - cells) AS ems FROM parts CROSS JOIN LATERAL (VALUES
 (1, 'treatment', k - 1, ss_t), (2, 'x', m - 1, tss - rss - left_over - ss_t), (3, 'treatment:x', cells - k - m + 1, left_over), (4, 'residual', n - cells, rss)) AS w(term_order, term, df, ss))
SELECT family, term_order, term, df, ss, CASE WHEN term_order < 4 THEN ms / ems END AS f FROM long""",
)
def anova_factorial_two_large_query(spark, folder):
    """Parts and suppliers: both factors have too many levels for a matrix."""
    return L.anova_factorial(written(cell_stats(lineitem(spark, folder), ["l_quantity"], "l_partkey", "l_suppkey")))


_MANY_OBS = """obs AS (SELECT 'effect' AS family, l_suppkey % 40 AS treatment, 'all' AS x, l_quantity + (l_suppkey % 40) * 0.4 AS y FROM lineitem)"""


def _many_means(spark, folder):
    y = F.col("l_quantity") + (F.col("l_suppkey") % 40) * 0.4
    rows = lineitem(spark, folder)
    cells = cell_stats(rows, {"effect": y}, (F.col("l_suppkey") % 40).alias("treatment"), F.lit("all"))
    return materialize(M.emmeans_one_way(materialize(cells), None))


@register(
    "letters_forty_levels",
    exact=["family", "treatment", "level", "share"],
    sql=f"""WITH {_MANY_OBS}, {cells_sql()}, {fit_sql()},
means AS (SELECT c.family, c.treatment, c.mean AS emmean, sigma / sqrt(c.n) AS se, df FROM cells c JOIN fit f ON c.family = f.family),
pairs AS (SELECT a.family, a.treatment AS level_a, b.treatment AS level_b, a.df, abs(a.emmean - b.emmean) / sqrt(a.se ** 2 + b.se ** 2) AS t FROM means a JOIN means b ON a.treatment < b.treatment),
numbered AS (SELECT *, row_number() OVER () AS rid, t * sqrt(2.0) AS q, (SELECT count(*) FROM means) AS k FROM pairs),
{range_p_ctes('numbered')}
SELECT family, level_a AS treatment, level_b AS level, p >= 0.05 AS share FROM numbered JOIN ranged USING (rid)""",
)
def letters_forty_levels_query(spark, folder):
    """Whether two of forty levels share a letter group, read back from the groups."""
    means = _many_means(spark, folder)
    shown = K.letter_groups(means, M.pairwise_contrasts(means, ["family"], block_levels=8), ["family"])
    a = shown.select("family", "treatment", F.col("letter_groups").alias("_a"))
    b = shown.select("family", F.col("treatment").alias("level"), F.col("letter_groups").alias("_b"))
    both = a.join(b, "family").where(F.col("treatment") < F.col("level"))
    return both.withColumn("share", F.arrays_overlap("_a", "_b"))


@register(
    "pairwise_contrasts_blocks",
    exact=["family", "x", "level_a", "level_b", "df"],
    sig=["difference", "se", "t"],
    sql=f"""WITH obs AS (SELECT 'l_quantity' AS family, l_suppkey AS treatment, l_linestatus AS x, l_quantity AS y FROM lineitem), {cells_sql()}, {fit_sql()},
means AS (SELECT c.family, c.treatment, c.x, c.mean AS emmean, sigma / sqrt(c.n) AS se, df FROM cells c JOIN fit f ON c.family = f.family)
SELECT a.family, a.x, a.treatment AS level_a, b.treatment AS level_b, a.df, a.emmean - b.emmean AS difference, sqrt(a.se ** 2 + b.se ** 2) AS se,
 (a.emmean - b.emmean) / sqrt(a.se ** 2 + b.se ** 2) AS t FROM means a JOIN means b ON a.family = b.family AND a.x = b.x AND a.treatment < b.treatment""",
)
def pairwise_contrasts_blocks_query(spark, folder):
    """All pairs of suppliers, dealt in pairs of blocks of sixteen levels."""
    cells = materialize(cell_stats(lineitem(spark, folder), ["l_quantity"], "l_suppkey", "l_linestatus"))
    means = materialize(M.emmeans_cell(cells, None))
    return M.pairwise_contrasts(means, p_values=False, block_levels=16)
