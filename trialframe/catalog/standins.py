"""Stand-ins for the trial tables, on the test tables, and the same in SQL.

No trial data comes with the tests, so line items play the observations:
line status is the treatment, line number the sampling as a factor, and the
ship date the sampling day. Curves and breaks, which no table holds, are planted
as expressions whose scatter comes from the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trialframe.catalog.base import table
from trialframe.functions.scalar import days_since

RESPONSES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
ORIGIN = "1995-01-01"
LEVELS = ("F", "O")
BREAKS = {"click": 8.0, "error": 10.0, "purchase": 12.0, "signup": 14.0, "view": 16.0}


def lineitem(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "lineitem")
    return df.withColumn("day", days_since("l_shipdate", ORIGIN))


def growth_response(scale: float = 1.0) -> Column:
    """Logistic in the line number, with an effect of the line status on its height."""
    top = F.when(F.col("l_linestatus") == "F", 20.0).otherwise(24.0)
    rise = F.lit(1.0) + F.exp((F.lit(4.0) - F.col("l_linenumber")) / 1.2)
    return (top / rise + (F.col("l_discount") - 0.05)) * scale


GROWTH_SQL = (
    "((CASE WHEN l_linestatus = 'F' THEN 20.0 ELSE 24.0 END)"
    " / (1 + exp((4.0 - l_linenumber) / 1.2)) + (l_discount - 0.05))"
)


def effect_response() -> Column:
    """Quantity with planted effects: some line numbers differ between statuses."""
    shift = F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") >= 4), 1.0).otherwise(0.0)
    return F.col("l_quantity") + F.col("l_linenumber") * 0.8 + shift


EFFECT_SQL = (
    "(l_quantity + l_linenumber * 0.8 +"
    " CASE WHEN l_linestatus = 'O' AND l_linenumber >= 4 THEN 1.0 ELSE 0.0 END)"
)


def observations_sql(treatment: str = "l_linestatus", x: str = "l_linenumber") -> str:
    """Long rows (treatment, x, family, y) of the four responses."""
    return f"""
SELECT treatment, x, family, y FROM (
  SELECT {treatment} AS treatment, {x} AS x, l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem) AS wide
UNPIVOT (y FOR family IN (l_quantity, l_extendedprice, l_discount, l_tax))"""


DAY_SQL = f"CAST(date_diff('day', DATE '{ORIGIN}', CAST(l_shipdate AS DATE)) AS INTEGER)"


def cells_sql(obs: str = "obs", name: str = "cells") -> str:
    return f"""{name} AS (
SELECT family, treatment, x, count(y) AS n, avg(y) AS mean,
       sum((y - m) * (y - m)) AS ss
FROM (SELECT *, avg(y) OVER (PARTITION BY family, treatment, x) AS m FROM {obs}) AS centred
GROUP BY family, treatment, x)"""


def fit_sql(name: str = "fit") -> str:
    return f"""{name} AS (
SELECT family, CAST(sum(n) AS BIGINT) AS n, count(*) AS parameters, sum(ss) AS rss,
       CAST(sum(n) - count(*) AS BIGINT) AS df,
       sqrt(sum(ss) / (sum(n) - count(*))) AS sigma
FROM cells GROUP BY family)"""


def t_p_sql(t: str, df: str, nodes: int = 1000) -> str:
    """Two-sided p of t by Simpson's rule over the density."""
    end = f"least(abs({t}), 40.0)"
    return f"""(1 - 2 * (SELECT sum((CASE WHEN i = 0 OR i = {nodes} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0) - 0.5 * ln({df} * pi())
   - ({df} + 1) / 2.0 * ln(1 + ({end} * i / {nodes}.0) * ({end} * i / {nodes}.0) / {df})))
 * {end} / {nodes}.0 / 3 FROM range({nodes + 1}) AS nodes(i)))"""


def f_p_sql(f: str, d1: str, d2: str, nodes: int = 2000) -> str:
    """Upper tail of F by Simpson's rule in the square root of F."""
    end = f"least(sqrt(greatest({f}, 0)), 12.0)"
    v = f"({end} * i / {nodes}.0)"
    return f"""(1 - (SELECT sum((CASE WHEN i = 0 OR i = {nodes} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
 * 2 * exp(lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0)
   + {d1} / 2.0 * ln({d1} / ({d2} * 1.0)) - ({d1} + {d2}) / 2.0 * ln(1 + {d1} * {v} * {v} / {d2}))
 * (CASE WHEN {d1} = 1 THEN 1.0 ELSE pow({v}, {d1} - 1) END))
 * {end} / {nodes}.0 / 3 FROM range({nodes + 1}) AS nodes(i)))"""


def chi2_p_sql(x: str, df: str, nodes: int = 2000) -> str:
    end = f"least(sqrt(greatest({x}, 0)), 14.0)"
    v = f"({end} * i / {nodes}.0)"
    return f"""(1 - (SELECT sum((CASE WHEN i = 0 OR i = {nodes} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
 * 2 * exp(-{df} / 2.0 * ln(2.0) - lgamma({df} / 2.0) - {v} * {v} / 2)
 * (CASE WHEN {df} = 1 THEN 1.0 ELSE pow({v}, {df} - 1) END))
 * {end} / {nodes}.0 / 3 FROM range({nodes + 1}) AS nodes(i)))"""


# Fixed value: the 97.5 % point of the normal law.
_Z = 1.959963984540054


def t_crit_sql(df: str) -> str:
    """95 % two-sided critical value by the large-df expansion (df is in the thousands)."""
    z = _Z
    return (
        f"({z} + {(z**3 + z) / 4!r} / {df} + {(5 * z**5 + 16 * z**3 + 3 * z) / 96!r} / ({df} * 1.0 * {df})"
        f" + {(3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384!r} / ({df} * 1.0 * {df} * {df}))"
    )


def range_p_ctes(source: str, name: str = "ranged") -> str:
    """CTEs giving the studentized range tail p for every (rid, q, k, df) of a source.

    Trapezoid sums on both integrals; the normal integral is a table made by
    Simpson's rule, read with a Taylor step.
    """
    return f"""phi AS (
SELECT g.i, 0.5 + sum((CASE WHEN j = 0 OR j = 200 THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END)
  * exp(-0.5 * (g.i / 10.0 * j / 200.0) ** 2)) / sqrt(2 * pi()) * (g.i / 10.0 / 200.0) / 3 AS v
FROM range(-121, 122) AS g(i) CROSS JOIN range(201) AS s(j) GROUP BY g.i),
scales AS (
SELECT rid, q, k, 1 + u / 4.0 / sqrt(2.0 * df) AS s,
  exp((df - 1) * ln(1 + u / 4.0 / sqrt(2.0 * df)) - df / 2.0 * ((1 + u / 4.0 / sqrt(2.0 * df)) ** 2 - 1)) AS weight
FROM {source} CROSS JOIN range(-32, 33) AS us(u)),
points AS (
SELECT rid, k, s, weight, z.i, exp(-0.5 * (z.i / 10.0) ** 2) / sqrt(2 * pi()) * 0.1 AS dz, z.v AS top,
  z.i / 10.0 - q * s AS low, CAST(round(greatest(z.i - 10 * q * s, -121)) AS BIGINT) AS low_i
FROM scales CROSS JOIN phi AS z WHERE z.i BETWEEN -85 AND 85),
steps AS (
SELECT p.*, phi.v AS base, low_i / 10.0 AS z0, greatest(low, -12.1) - low_i / 10.0 AS d
FROM points AS p JOIN phi ON phi.i = p.low_i),
gaps AS (
SELECT rid, k, s, weight, dz, top - base - exp(-0.5 * z0 * z0) / sqrt(2 * pi()) * d * (1 - d / 2 * z0 + d ** 2 / 6 * (z0 ** 2 - 1)
  - d ** 3 / 24 * z0 * (z0 ** 2 - 3) + d ** 4 / 120 * (z0 ** 4 - 6 * z0 ** 2 + 3)) AS gap FROM steps),
{name} AS (
SELECT rid, 1 - sum(weight * k * dz * pow(greatest(gap, 0), k - 1)) / any_value(total) AS p
FROM gaps JOIN (SELECT rid, sum(weight) AS total FROM scales GROUP BY rid) AS t USING (rid) GROUP BY rid)"""


def det_sql(m: list[list[str]]) -> str:
    """Determinant of a small matrix of SQL expressions, by expansion along the first row."""
    if len(m) == 1:
        return m[0][0]
    parts = []
    for j, head in enumerate(m[0]):
        minor = [row[:j] + row[j + 1 :] for row in m[1:]]
        parts.append(f"{'-' if j % 2 else '+'} {head} * ({det_sql(minor)})")
    return " ".join(parts).lstrip("+ ")
