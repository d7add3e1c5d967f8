"""General linear hypotheses about the parameters of a fit: combinations L·θ over the whole covariance.

A fit holds its parameters and their unscaled covariance. Where treatments share
parameters, their own parameters depend on each other through the shared ones, so
variances must not be added: the error of L·θ is the root of σ² L V L', off-diagonal
terms included. Everything here is a function of one row for each fit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from trialframe.functions.probability import f_upper, range_upper, t_two_sided
from trialframe.operators.curves import Curve, curve_error

Combination = Mapping[str, float]


def _weights(curve: Curve, combination: Combination) -> list[float]:
    unknown = set(combination) - set(curve.params)
    if unknown:
        raise ValueError(f"{curve.name} has no parameter {sorted(unknown)}")
    return [float(combination.get(p, 0.0)) for p in curve.params]


def _with_error(fits: DataFrame, pool: Sequence[str]) -> DataFrame:
    return fits.join(curve_error(fits, pool).select(*pool, "df", "sigma"), list(pool))


def linear_hypotheses(
    fits: DataFrame,
    curve: Curve,
    combinations: Mapping[str, Combination],
    keys: Sequence[str] = ("family",),
    pool: Sequence[str] = ("family",),
) -> DataFrame:
    """keys, hypothesis -> estimate, se, df, t, p of every named combination, tested against zero.

    A fit that failed has NULL estimates.
    """
    size, rows = len(curve.params), []
    for name, combination in combinations.items():
        weight = _weights(curve, combination)
        used = [i for i, w in enumerate(weight) if w]
        if not used:
            raise ValueError(f"{name} has no parameter")
        add = lambda parts: reduce(Column.__add__, parts)
        estimate = add([F.lit(weight[i]) * F.col(curve.params[i]) for i in used])
        variance = add([F.lit(weight[i] * weight[j]) * F.col("unit_cov").getItem(i * size + j) for i in used for j in used])
        se = F.col("sigma") * F.sqrt(F.greatest(variance, F.lit(0.0)))
        rows.append(F.struct(F.lit(name).alias("hypothesis"), estimate.alias("estimate"), se.alias("se")))
    long = _with_error(fits, pool).select(*keys, "df", F.inline(F.array(*rows)))
    return long.withColumn("t", F.try_divide(F.col("estimate"), F.col("se"))).withColumn("p", t_two_sided("t", "df"))


def joint_tests(
    fits: DataFrame,
    curve: Curve,
    tests: Mapping[str, Sequence[Combination]],
    keys: Sequence[str] = ("family",),
    pool: Sequence[str] = ("family",),
) -> DataFrame:
    """keys, term -> df1, df2, f, p: all combinations of a term are zero at once (Wald F).

    f = (Lθ)' (L V L')⁻ (Lθ) / (rank · σ²); combinations that depend on others lower the rank.
    """
    matrices = [np.array([_weights(curve, c) for c in group]) for group in tests.values()]

    @F.pandas_udf(ArrayType(StructType().add("df1", IntegerType()).add("q", DoubleType())))
    def run(theta: pd.Series, cov: pd.Series) -> pd.Series:
        out = []
        for t, v in zip(theta, cov):
            if v is None or any(x is None or x != x for x in t):
                out.append([(int(np.linalg.matrix_rank(m)), None) for m in matrices])
                continue
            t, v = np.asarray(t, float), np.asarray(v, float).reshape(len(t), -1)
            out.append([_quadratic(m @ t, m @ v @ m.T) for m in matrices])
        return pd.Series(out)

    names = F.array(*map(F.lit, tests))
    found = _with_error(fits, pool).withColumn("_q", run(F.array(*(F.col(p) for p in curve.params)), F.col("unit_cov")))
    long = found.select(*keys, F.col("df").alias("df2"), "sigma", F.posexplode("_q").alias("_k", "_w"))
    f = F.try_divide(F.col("_w.q"), F.col("_w.df1") * F.col("sigma") * F.col("sigma"))
    rows = long.select(*keys, F.element_at(names, F.col("_k") + 1).alias("term"), F.col("_w.df1").cast("long").alias("df1"), "df2", f.alias("f"))
    return rows.withColumn("p", f_upper("f", "df1", "df2"))


def _quadratic(value: np.ndarray, cov: np.ndarray) -> tuple[int, float | None]:
    """Rank of ``cov`` and value' cov⁻ value, on a unit diagonal."""
    scale = np.sqrt(np.diag(cov))
    if not np.isfinite(cov).all() or not (scale > 0).all():
        return len(value), None
    root, vector = np.linalg.eigh(cov / np.outer(scale, scale))
    keep = root > 1e-11
    part = vector.T @ (value / scale)
    return int(keep.sum()), float(np.sum(part[keep] ** 2 / root[keep]))


def own_estimates(
    fits: DataFrame, curve: Curve, own: Mapping[str, str], param: str, pool: Sequence[str] = ("family",)
) -> DataFrame:
    """pool, param, treatment -> estimate, se, df of the parameter that each treatment has of its own in a shared fit.

    ``own`` names that parameter for each treatment.
    """
    combinations = {level: {name: 1.0} for level, name in own.items()}
    found = linear_hypotheses(fits, curve, combinations, pool, pool)
    return found.select(*pool, F.lit(param).alias("param"), F.col("hypothesis").alias("treatment"), "estimate", "se", "df")


def shared_contrasts(
    fits: DataFrame, curve: Curve, own: Mapping[str, str], param: str, pool: Sequence[str] = ("family",)
) -> DataFrame:
    """Every pair of treatments compared in the parameter they have of their own, first minus second in level order.

    The columns are those of ``pairwise_contrasts``, p is Tukey-adjusted for the number of
    treatments; the errors take in the covariance through the shared parameters. Pairs come
    from the places of a fit's parameter array, so a plan does not grow with their number.
    """
    levels = sorted(own)
    places = [curve.params.index(own[level]) for level in levels]
    size, k = len(curve.params), len(levels)
    rows = _with_error(fits, pool).select(
        *pool,
        "df",
        "sigma",
        "unit_cov",
        F.array(*(F.col(own[level]) for level in levels)).alias("_theta"),
        F.array(*map(F.lit, levels)).alias("_levels"),
        F.array(*map(F.lit, places)).alias("_at"),
        F.explode(F.sequence(F.lit(0), F.lit(max(k - 2, 0)))).alias("_a"),
    )
    rows = rows.withColumn("_b", F.explode(F.sequence(F.col("_a") + 1, F.lit(max(k - 1, 1))))).where(F.col("_b") < k)
    at = lambda c, i: F.get(c, F.col(i))
    cov = lambda i, j: F.get("unit_cov", at("_at", i) * size + at("_at", j))
    variance = cov("_a", "_a") + cov("_b", "_b") - F.lit(2.0) * cov("_a", "_b")
    pairs = rows.select(
        *pool,
        F.lit(param).alias("param"),
        at("_levels", "_a").alias("level_a"),
        at("_levels", "_b").alias("level_b"),
        (at("_theta", "_a") - at("_theta", "_b")).alias("difference"),
        (F.col("sigma") * F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("se"),
        "df",
        F.lit(k).cast("long").alias("levels"),
    )
    tested = pairs.withColumn("t", F.try_divide(F.col("difference"), F.col("se")))
    return tested.withColumn("p", range_upper(F.abs("t") * F.sqrt(F.lit(2.0)), "levels", "df"))


def shared_wald_f(fits: DataFrame, curve: Curve, own: Mapping[str, str], param: str, pool: Sequence[str] = ("family",)) -> DataFrame:
    """Wald F of a shared fit: the baseline treatment's own parameter, equality over treatments, all own ones, and each shared one."""
    levels = sorted(own)
    first = own[levels[0]]
    tests = {f"{param}:(intercept)": [{first: 1.0}], f"{param}:all": [{own[level]: 1.0} for level in levels]}
    if len(levels) > 1:
        tests[f"{param}:treatment"] = [{own[level]: 1.0, first: -1.0} for level in levels[1:]]
    tests |= {p: [{p: 1.0}] for p in curve.params if p not in own.values()}
    return joint_tests(fits, curve, tests, pool, pool)
