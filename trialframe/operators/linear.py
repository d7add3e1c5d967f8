"""Linear models whose fit is a closed form of cell statistics or line moments.

Inputs are the small tables of ``cells.py``; outputs are coefficient, variance
and ANOVA tables keyed by ``family``. Nothing here reads raw rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from trialframe.functions.probability import f_upper, t_two_sided
from trialframe.session import broadcast_if_small, fits_broadcast, materialize, written

DENSE_LEVELS = 64  # treatments whose pairs are solved as one matrix
FAMILY_ROW = 128  # bytes of a row that stands for one family
LEVEL_ROW, VECTOR_ROW = 128, 16  # of one that stands for a level, and of a level's numbers in a vector
LEAST_CELLS, BLOCK_CELLS = 1 << 17, 1 << 20  # of a task: fewer are not dealt on, more are


def _square(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c * c


def cell_means_fit(cells: DataFrame) -> DataFrame:
    """Residual variance of the model with one mean per cell."""
    return (
        cells.groupBy("family")
        .agg(
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("parameters"),
            F.sum("ss").alias("rss"),
        )
        .withColumn("df", F.col("n") - F.col("parameters"))
        .withColumn("sigma", F.sqrt(_mean_square("rss", "df")))
    )


def _mean_square(ss, df) -> Column:
    ss, df = (F.col(c) if isinstance(c, str) else c for c in (ss, df))
    return F.when(df > 0, F.try_divide(ss, df))


def one_way_fit(treatment_cells: DataFrame) -> DataFrame:
    """Residual variance of the one-factor model; cells keyed by treatment alone."""
    return cell_means_fit(treatment_cells)


def _lines(moments: DataFrame) -> DataFrame:
    """Line of each row; with one distinct x there is no slope, and the residual is about the mean."""
    slope = F.when(F.col("sxx") > 0, F.try_divide(F.col("sxy"), F.col("sxx")))
    explained = F.coalesce(F.col("slope") * F.col("sxy"), F.lit(0.0))
    return (
        moments.withColumn("slope", slope)
        .withColumn("intercept", F.col("y_mean") - F.col("slope") * F.col("x_mean"))
        .withColumn("line_rss", F.greatest(F.col("syy") - explained, F.lit(0.0)))
        .withColumn("line_rank", F.when(F.col("slope").isNotNull(), 2).otherwise(1).cast("long"))
    )


def pooled_line_error(moments: DataFrame) -> DataFrame:
    """Residual variance of the model with a separate line per treatment.

    A treatment with one distinct x takes one parameter, its mean.
    """
    return (
        _lines(moments)
        .groupBy("family")
        .agg(
            F.sum("n").alias("n_total"),
            F.sum("line_rss").alias("rss"),
            F.sum("line_rank").alias("parameters"),
        )
        .withColumn("df", F.col("n_total") - F.col("parameters"))
        .withColumn("sigma", F.sqrt(_mean_square("rss", "df")))
    )


def ancova_fit(moments: DataFrame) -> DataFrame:
    """Separate straight lines per treatment with one pooled error variance."""
    return _lines(moments).drop("line_rss", "line_rank").join(pooled_line_error(moments), "family")


def simple_regression(moments: DataFrame) -> DataFrame:
    """One straight line per family, with errors, R squared and tests of both terms."""
    fit = (
        _lines(moments)
        .withColumnRenamed("line_rss", "rss")
        .withColumn("df", F.col("n") - F.col("line_rank"))
        .drop("line_rank")
        .withColumn("sigma", F.sqrt(_mean_square("rss", "df")))
        .withColumn("r2", F.lit(1.0) - F.try_divide(F.col("rss"), F.col("syy")))
        .withColumn("slope_se", F.try_divide(F.col("sigma"), F.sqrt("sxx")))
        .withColumn(
            "intercept_se",
            F.col("sigma") * F.sqrt(F.lit(1.0) / F.col("n") + F.try_divide(_square("x_mean"), F.col("sxx"))),
        )
        .withColumn("slope_t", F.try_divide(F.col("slope"), F.col("slope_se")))
        .withColumn("intercept_t", F.try_divide(F.col("intercept"), F.col("intercept_se")))
    )
    return fit.withColumn("slope_p", t_two_sided("slope_t", "df")).withColumn(
        "intercept_p", t_two_sided("intercept_t", "df")
    )


def _line_terms(fit: DataFrame, with_intercept: bool) -> DataFrame:
    """Coefficient rows of the separate-lines fit in the usual baseline coding."""
    base = fit.groupBy("family").agg(
        F.min_by(
            F.struct("treatment", "intercept", "slope", "n", "x_mean", "sxx"), "treatment"
        ).alias("b")
    )
    var_int = lambda p: F.lit(1.0) / F.col(p + "n") + F.try_divide(
        _square(p + "x_mean"), F.col(p + "sxx")
    )
    var_slope = lambda p: F.try_divide(F.lit(1.0), F.col(p + "sxx"))
    is_base = F.col("treatment") == F.col("b.treatment")

    def term(name, estimate, variance):
        return F.struct(name.alias("term"), estimate.alias("estimate"), variance.alias("_v"))

    treatment = F.concat(F.lit("treatment"), F.col("treatment"))
    own = [
        term(F.when(is_base, F.lit("x")).otherwise(F.concat(F.lit("x:"), treatment)),
             F.when(is_base, F.col("slope")).otherwise(F.col("slope") - F.col("b.slope")),
             F.when(is_base, var_slope("")).otherwise(var_slope("") + var_slope("b."))),
    ]
    if with_intercept:
        own.append(
            term(F.when(is_base, F.lit("(intercept)")).otherwise(treatment),
                 F.when(is_base, F.col("intercept")).otherwise(F.col("intercept") - F.col("b.intercept")),
                 F.when(is_base, var_int("")).otherwise(var_int("") + var_int("b.")))
        )
    else:
        own.append(term(treatment, F.col("intercept"), var_int("")))
    return (
        fit.join(base, "family")
        .select("family", "sigma", "df", F.inline(F.array(*own)))
        .withColumn("se", F.col("sigma") * F.sqrt("_v"))
        .withColumn("t", F.try_divide(F.col("estimate"), F.col("se")))
        .select("family", "term", "estimate", "se", "df", "t")
    )


def coef_summary(moments: DataFrame, with_intercept: bool = True) -> DataFrame:
    """Coefficient table of the separate-lines model: estimate, se, t, p."""
    terms = _line_terms(ancova_fit(moments), with_intercept)
    return terms.withColumn("p", t_two_sided("t", "df"))


def model_summary(moments: DataFrame, with_intercept: bool = True) -> DataFrame:
    """sigma, R squared and overall F of the separate-lines model.

    Without an intercept both are measured about zero instead of the mean.
    """
    fit = ancova_fit(moments)
    grand = fit.groupBy("family").agg(
        (F.sum(F.col("n") * F.col("y_mean")) / F.sum("n")).alias("_m")
    )
    centre = F.col("_m") if with_intercept else F.lit(0.0)
    out = (
        fit.join(grand, "family")
        .groupBy("family")
        .agg(
            F.first("n_total").alias("n"),
            F.first("parameters").alias("parameters"),
            F.first("df").alias("df"),
            F.first("rss").alias("rss"),
            F.first("sigma").alias("sigma"),
            F.sum(F.col("syy") + F.col("n") * _square(F.col("y_mean") - centre)).alias("tss"),
        )
        .withColumn("df_model", F.col("parameters") - (1 if with_intercept else 0))
        .withColumn("r2", F.lit(1.0) - F.try_divide(F.col("rss"), F.col("tss")))
        .withColumn(
            "f",
            F.try_divide(
                F.try_divide(F.col("tss") - F.col("rss"), F.col("df_model")), _square("sigma")
            ),
        )
    )
    return out.withColumn("p", f_upper("f", "df_model", "df"))


def ancova_no_intercept(moments: DataFrame) -> DataFrame:
    """Separate lines, one intercept per treatment and no common one."""
    return coef_summary(moments, with_intercept=False)


def _anova_rows(df: DataFrame, terms: list[tuple[str, Column, Column]]) -> DataFrame:
    """Long ANOVA table from one row per family; the last term is the residual."""
    rows = F.array(
        *(
            F.struct(
                F.lit(i + 1).alias("term_order"),
                F.lit(name).alias("term"),
                d.cast("long").alias("df"),
                ss.alias("ss"),
            )
            for i, (name, d, ss) in enumerate(terms)
        )
    )
    _, res_df, res_ss = terms[-1]
    long = df.select(
        "family", res_df.alias("_rdf"), res_ss.alias("_rss"), F.inline(rows)
    ).withColumn("ms", F.when(F.col("df") > 0, F.try_divide(F.col("ss"), F.col("df"))))
    is_term = F.col("term_order") < len(terms)
    long = long.withColumn(
        "f",
        F.when(is_term, F.try_divide(F.col("ms"), _mean_square("_rss", "_rdf"))),
    )
    return long.withColumn("p", f_upper("f", "df", "_rdf")).drop("_rdf", "_rss")


def _separate_slopes() -> list[Column]:
    """What separate lines explain, and how many treatments have more than one x."""
    has = F.col("sxx") > 0
    return [
        F.sum(F.when(has, F.try_divide(_square("sxy"), F.col("sxx"))).otherwise(0.0)).alias("sep"),
        F.count_if(has).alias("slopes"),
    ]


def _nested_residuals(parts: DataFrame) -> DataFrame:
    """Residuals and ranks of the nested fits; a slope without spread in x explains nothing."""

    def explained(xy: str, xx: str) -> Column:
        return F.when(F.col(xx) > 0, F.try_divide(_square(xy), F.col(xx))).otherwise(0.0)

    return (
        parts.withColumn("ss_x", explained("txy", "txx"))
        .withColumn("one_x", (F.col("txx") > 0).cast("long"))
        .withColumn("common_x", (F.col("wxx") > 0).cast("long"))
        .withColumn("rss1", F.col("tss") - F.col("ss_x"))
        .withColumn("rss2", F.col("wyy") - explained("wxy", "wxx"))
        .withColumn("rss3", F.greatest(F.col("wyy") - F.col("sep"), F.lit(0.0)))
    )


def anova_ancova(moments: DataFrame) -> DataFrame:
    """Sequential ANOVA of x, treatment and their interaction (straight lines).

    Sums of squares are differences between four nested fits: the overall mean,
    one line, parallel lines, separate lines. Degrees of freedom are differences
    of their ranks, so a treatment with one distinct x adds no slope.
    """
    grand = moments.groupBy("family").agg(
        (F.sum(F.col("n") * F.col("x_mean")) / F.sum("n")).alias("_mx"),
        (F.sum(F.col("n") * F.col("y_mean")) / F.sum("n")).alias("_my"),
    )
    dx, dy = F.col("x_mean") - F.col("_mx"), F.col("y_mean") - F.col("_my")
    parts = (
        moments.join(grand, "family")
        .groupBy("family")
        .agg(
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("k"),
            F.sum(F.col("syy") + F.col("n") * dy * dy).alias("tss"),
            F.sum(F.col("sxx") + F.col("n") * dx * dx).alias("txx"),
            F.sum(F.col("sxy") + F.col("n") * dx * dy).alias("txy"),
            F.sum("sxx").alias("wxx"),
            F.sum("sxy").alias("wxy"),
            F.sum("syy").alias("wyy"),
            *_separate_slopes(),
        )
        .transform(_nested_residuals)
    )
    k, n, slopes = F.col("k"), F.col("n"), F.col("slopes")
    return _anova_rows(
        parts,
        [
            ("x", F.col("one_x"), F.col("ss_x")),
            ("treatment", k - 1 + F.col("common_x") - F.col("one_x"), F.col("rss1") - F.col("rss2")),
            ("x:treatment", slopes - F.col("common_x"), F.col("rss2") - F.col("rss3")),
            ("residual", n - k - slopes, F.col("rss3")),
        ],
    )


def anova_no_intercept(moments: DataFrame) -> DataFrame:
    """Sequential ANOVA of x, treatment and interaction in the model without intercept.

    The first fit is one line through the origin, so the sums are about zero;
    treatment then brings one intercept per level.
    """
    n = F.col("n")
    parts = (
        moments.groupBy("family")
        .agg(
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("k"),
            F.sum(F.col("syy") + n * _square("y_mean")).alias("tss"),
            F.sum(F.col("sxx") + n * _square("x_mean")).alias("txx"),
            F.sum(F.col("sxy") + n * F.col("x_mean") * F.col("y_mean")).alias("txy"),
            F.sum("sxx").alias("wxx"),
            F.sum("sxy").alias("wxy"),
            F.sum("syy").alias("wyy"),
            *_separate_slopes(),
        )
        .transform(_nested_residuals)
    )
    k, slopes = F.col("k"), F.col("slopes")
    return _anova_rows(
        parts,
        [
            ("x", F.col("one_x"), F.col("ss_x")),
            ("treatment", k + F.col("common_x") - F.col("one_x"), F.col("rss1") - F.col("rss2")),
            ("x:treatment", slopes - F.col("common_x"), F.col("rss2") - F.col("rss3")),
            ("residual", n - k - slopes, F.col("rss3")),
        ],
    )


@F.pandas_udf(StructType().add("ss", DoubleType()).add("rank", IntegerType()))
def _quadratic_form(entries: pd.Series) -> pd.DataFrame:
    """b' A⁻ b for one small matrix per family (A is levels x levels, rank deficient); b stands with the diagonal."""
    out = []
    for cells in entries:
        at = {level: k for k, level in enumerate(sorted(e["i"] for e in cells if e["i"] == e["j"]))}
        a, b = np.zeros((len(at), len(at))), np.zeros(len(at))
        for e in cells:
            a[at[e["i"]], at[e["j"]]] = e["a"]
            if e["i"] == e["j"]:
                b[at[e["i"]]] = e["b"]
        # scaled to a unit diagonal, so that a rare level beside large ones keeps its dimension
        diagonal = np.diag(a)
        scale = np.where(diagonal > 0, 1 / np.sqrt(np.where(diagonal > 0, diagonal, 1.0)), 0.0)
        value, vector = np.linalg.eigh(a * np.outer(scale, scale))
        keep = value > 1e-9
        part = vector.T @ (scale * b)
        out.append((float(np.sum(part[keep] ** 2 / value[keep])), int(keep.sum())))
    return pd.DataFrame(out, columns=["ss", "rank"])


def treatment_given_x(cells: DataFrame, dense_levels: int = DENSE_LEVELS) -> DataFrame:
    """SS of treatment after x in the additive two-factor model, any number of levels."""
    return _main_effects(cells, dense_levels).select("family", "ss_t_given_x", "t_rank")


def _main_effects(cells: DataFrame, dense_levels: int = DENSE_LEVELS) -> DataFrame:
    """family -> SS and levels of both factors alone (ss_t, a, ss_x, b), SS and rank of treatment after x.

    Normal equations with one factor eliminated are solved as one matrix for each family
    whose treatments, or else x, have up to about ``dense_levels`` levels, and by conjugate
    gradients on the factor of fewer levels where both have more. The levels are estimated
    for that, in one pass that ships none of them: every way gives the same sums.
    """
    levels = cells.groupBy("family").agg(F.approx_count_distinct("treatment").alias("_k"), F.approx_count_distinct("x").alias("_m"))
    few_k, few_m, fewer = F.col("_k") <= dense_levels, F.col("_m") <= dense_levels, F.col("_k") <= F.col("_m")
    ways = [
        (few_k, _dense_effects),
        (~few_k & few_m, lambda own: _turned_back(_dense_effects(_turned(own)))),
        (~few_k & ~few_m & fewer, _gradient_effects),
        (~few_k & ~few_m & ~fewer, lambda own: _turned_back(_gradient_effects(_turned(own)))),
    ]
    met = levels.agg(*(F.count_if(wanted) for wanted, _ in ways)).first()
    taken = [way for way, families in zip(ways, met, strict=True) if families] or ways[:1]
    if len(taken) == 1:
        return taken[0][1](cells)
    levels = materialize(levels)
    own = lambda wanted: broadcast_if_small(levels.where(wanted).select("family"), FAMILY_ROW)
    return reduce(DataFrame.unionByName, [solve(cells.join(own(wanted), "family", "left_semi")) for wanted, solve in taken])


def _dense_effects(cells: DataFrame) -> DataFrame:
    centred = _centred(cells)
    both = _between(centred, "treatment", "ss_t", "a").join(_between(centred, "x", "ss_x", "b"), "family")
    return both.join(_dense_given_x(cells), "family")


def _turned(cells: DataFrame) -> DataFrame:
    other = {"treatment": "x", "x": "treatment"}
    return cells.select(*(F.col(c).alias(other.get(c, c)) for c in cells.columns))


def _turned_back(effects: DataFrame) -> DataFrame:
    """Effects of treatment and x from those with the two exchanged: both orders add up to one sum."""
    return effects.select(
        "family",
        F.col("ss_x").alias("ss_t"),
        F.col("b").alias("a"),
        F.col("ss_t").alias("ss_x"),
        F.col("a").alias("b"),
        (F.col("ss_t_given_x") + F.col("ss_x") - F.col("ss_t")).alias("ss_t_given_x"),
        (F.col("t_rank") + F.col("b") - F.col("a")).cast("int").alias("t_rank"),
    )


def _from_x_given_treatment(cells: DataFrame) -> DataFrame:
    """``treatment_given_x`` from the equations of x, for many treatments at few x."""
    return _turned_back(_dense_effects(_turned(cells))).select("family", "ss_t_given_x", "t_rank")


def gradient_given_x(cells: DataFrame, tolerance: float = 1e-9, max_rounds: int = 400) -> DataFrame:
    """``treatment_given_x`` by conjugate gradients, all families at once, for any number of levels of both factors."""
    return _gradient_effects(cells, tolerance, max_rounds).select("family", "ss_t_given_x", "t_rank")


def _gradient_effects(cells: DataFrame, tolerance: float = 1e-9, max_rounds: int = 400) -> DataFrame:
    """Effects by conjugate gradients on the equations of treatment.

    No pair of treatments is ever formed. A round multiplies the equations' matrix by a vector
    (one number for each treatment): means of the cells by x, taken from them, and sums by treatment.
    The cells of an x stand in one block (``_blocks``), to which the vector is sent, size-checked; a
    round ships sums by treatment only. Beyond that size the cells are joined with it.
    The unknowns are scaled to a unit diagonal. A family is done when its residual is below
    ``tolerance`` of the first; the SS, a quadratic form, is then right to about the square of
    that. The rank is the treatments less the groups of treatments that share no x with each other:
    in the same rounds each treatment takes the least number among those it shares an x with, until none changes.
    """
    keys = ["family", "id"]
    centred = _centred(cells).select("family", "treatment", "x", F.col("n").cast("double").alias("n"), (F.col("mean") - F.col("_m")).alias("y"))
    by_level = centred.groupBy("family", "treatment").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("y"), F.count(F.lit(1)).alias("cells"))
    place = F.row_number().over(Window.partitionBy("family").orderBy("treatment")) - 1
    levels = materialize(by_level.where(F.col("family").isNotNull()).withColumn("id", place))
    count, size = levels.agg(F.count(F.lit(1)), F.coalesce(F.sum("cells"), F.lit(0))).first()
    names = levels.select("family", "treatment", "id")
    numbered = centred.join(F.broadcast(names) if fits_broadcast(count, LEVEL_ROW) else names, ["family", "treatment"]).select("family", "x", "id", "n", "y")
    product = _product_of_blocks(numbered, size) if fits_broadcast(count, VECTOR_ROW) else _product_of_rows(numbered)

    start = levels.select(*keys, F.lit(0.0).alias("v"), F.col("id").alias("least"))
    sums, by_x = product(start, True)
    alone = levels.groupBy("family").agg(F.sum(F.col("n") * _square("y")).alias("ss_t"), F.count(F.lit(1)).alias("a"))
    alone = materialize(alone.join(by_x, "family"))
    state = levels.select(*keys, F.sqrt("n").alias("s")).join(sums.select(*keys, "q"), keys)
    state = materialize(state.select(*keys, "s", (F.col("q") / F.col("s")).alias("b")))
    first = materialize(state.groupBy("family").agg(F.sum(_square("b")).alias("rr0")))
    # a family's treatments never meet in one task for a number they share
    beside = F.broadcast if fits_broadcast(first.count(), FAMILY_ROW) else lambda per_family: per_family
    state = state.join(beside(first), "family").select(
        *keys, "s", "b", F.lit(0.0).alias("t"), F.col("b").alias("r"), F.col("b").alias("p"), F.col("rr0").alias("rr"), "rr0", F.col("id").alias("least"), F.lit(True).alias("new")
    )
    going = F.col("rr") > F.lit(tolerance**2) * F.col("rr0")

    def one_round(state: DataFrame) -> DataFrame:
        sums = product(state.select(*keys, (F.col("p") / F.col("s")).alias("v"), "least"), False)[0]
        moved = state.drop("new").join(sums.withColumnRenamed("least", "_least"), keys).withColumn("q", F.col("q") / F.col("s"))
        moved = materialize(moved.withColumn("new", F.col("_least") < F.col("least")).withColumn("least", F.col("_least")).drop("_least"))
        product_of = lambda a, b: F.sum(F.col(a) * F.col(b))
        sums = moved.groupBy("family").agg(
            F.first("rr").alias("rr"),
            F.first("rr0").alias("rr0"),
            product_of("r", "r").alias("_rr"),
            product_of("p", "q").alias("_pq"),
            product_of("r", "q").alias("_rq"),
            product_of("q", "q").alias("_qq"),
        )
        step = F.coalesce(F.when(going & (F.col("_pq") > 0), F.col("_rr") / F.col("_pq")), F.lit(0.0))
        after = F.greatest(F.col("_rr") - F.lit(2.0) * F.col("_step") * F.col("_rq") + F.col("_step") * F.col("_step") * F.col("_qq"), F.lit(0.0))
        sums = sums.withColumn("_step", step).select("family", "_step", F.when(F.col("_step") > 0, after).otherwise(F.lit(0.0)).alias("_new"), "_rr")
        rows = moved.join(beside(sums), "family").withColumn("r", F.col("r") - F.col("_step") * F.col("q"))
        turn = F.coalesce(F.try_divide(F.col("_new"), F.col("_rr")), F.lit(0.0))
        return materialize(rows.select(
            *keys, "s", "b", (F.col("t") + F.col("_step") * F.col("p")).alias("t"), "r", (F.col("r") + turn * F.col("p")).alias("p"), F.col("_new").alias("rr"), "rr0", "least", "new"
        ))

    rounds, moving, renamed = 0, 1, 1
    while renamed or (moving and rounds < max_rounds):
        state = one_round(state)
        rounds += 1
        moving, renamed = state.agg(F.count_if(going), F.count_if("new")).first()
    given = state.groupBy("family").agg(
        F.sum(F.col("t") * F.col("b")).alias("ss_t_given_x"), (F.count(F.lit(1)) - F.count_distinct("least")).cast("int").alias("t_rank")
    )
    return alone.join(given, "family")


Product = Callable[[DataFrame, bool], tuple[DataFrame, DataFrame | None]]


def _product_of_rows(numbered: DataFrame) -> Product:
    """``_product_of_blocks`` for vectors of any size: the cells are joined with them."""
    cells, keys = written(numbered), ["family", "x"]

    def product(vector: DataFrame, own: bool) -> tuple[DataFrame, DataFrame | None]:
        rows = cells.join(vector, ["family", "id"]).withColumn("y", F.col("y") if own else F.col("v"))
        by_x = rows.groupBy(*keys).agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("u"), F.min("least").alias("_least"))
        rest = F.sum(F.col("n") * (F.col("y") - F.col("u"))).alias("q")
        sums = rows.join(by_x, keys).groupBy("family", "id").agg(rest, F.min("_least").alias("least"))
        return sums, by_x.groupBy("family").agg(F.sum(F.col("_n") * _square("u")).alias("ss_x"), F.count(F.lit(1)).alias("b")) if own else None

    return product


def _product_of_blocks(numbered: DataFrame, size: int) -> Product:
    """(family, id, v, least), own -> family, id, q: sum of n (y - mean of y in the cell's x), and the least of all cells that share an x.

    y is the cell's ``own`` value, and SS and levels of x come too, or else v.
    """
    blocks = _blocks(numbered, size)

    def product(vector: DataFrame, own: bool) -> tuple[DataFrame, DataFrame | None]:
        ordered = F.sort_array(F.collect_list(F.struct("id", "v", "least")))
        sent = vector.groupBy("family").agg(ordered.alias("_l")).select("family", F.col("_l.v").alias("v"), F.col("_l.least").alias("least"))
        columns = ["family", "starts", "ids", "n", *(["y"] if own else [])]
        # the vectors' counted size is within bounds
        parts = blocks.select(*columns).join(F.broadcast(sent), "family").mapInArrow(_sums_of_blocks, _SUMS)
        parts = materialize(parts) if own else parts
        sums = parts.select("family", F.inline(F.arrays_zip("id", "q", "least"))).groupBy("family", "id").agg(F.sum("q").alias("q"), F.min("least").alias("least"))
        return sums, parts.groupBy("family").agg(F.sum("ss_x").alias("ss_x"), F.sum("b").alias("b")) if own else None

    return product


def _blocks(numbered: DataFrame, size: int) -> DataFrame:
    """Rows of about ``BLOCK_CELLS`` cells of a family: where each x starts, then id, n and y of the cells, as bytes.

    The cells of an x stay together, so they meet in one task: one for each treatment at most.
    """
    shuffled = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(shuffled, math.ceil(size / LEAST_CELLS)), math.ceil(size / BLOCK_CELLS))
    dealt = numbered.where(F.col("x").isNotNull()).repartition(tasks, "family", "x")
    return written(dealt.mapInArrow(_made_blocks, "family string, starts binary, ids binary, n binary, y binary"))


def _made_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    family, x = (table[name].combine_chunks().dictionary_encode() for name in ("family", "x"))
    key = family.indices.to_numpy().astype(np.int64) * len(x.dictionary) + x.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key, ids, n, y = key[order], *(table[name].to_numpy()[order] for name in ("id", "n", "y"))
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    owner = key[starts] // len(x.dictionary)
    block = np.cumsum(np.append(True, (owner[1:] != owner[:-1]) | (starts[1:] // BLOCK_CELLS != starts[:-1] // BLOCK_CELLS)))
    cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    rows = []
    for at, to in zip(cuts, np.append(cuts[1:], len(starts)), strict=True):
        cells = slice(starts[at], starts[to] if to < len(starts) else len(key))
        own = (starts[at:to] - starts[at]).astype(np.int32), ids[cells], n[cells], y[cells]
        rows.append([family.dictionary[owner[at]].as_py(), *(v.tobytes() for v in own)])
        if to == len(starts) or sum(len(r[2]) for r in rows) >= 4 * BLOCK_CELLS:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), *[pa.binary()] * 4), strict=True)], ["family", "starts", "ids", "n", "y"])
            rows = []


_SUMS = "family string, id array<int>, q array<double>, least array<int>, ss_x double, b long"


def _sums_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The product over the blocks of a task: one row for each family."""
    held: dict[str, list] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            at = {name: batch.column(name)[row] for name in batch.schema.names}
            starts, ids = (np.frombuffer(at[name].as_buffer(), np.int32) for name in ("starts", "ids"))
            v, least = (at[name].values.to_numpy() for name in ("v", "least"))
            n = np.frombuffer(at["n"].as_buffer())
            y = np.frombuffer(at["y"].as_buffer()) if "y" in at else v[ids]
            sums = held.setdefault(at["family"].as_py(), [np.zeros(len(v)), np.full(len(v), len(v), np.int32), 0.0, 0])
            weight, cells = np.add.reduceat(n, starts), np.diff(starts, append=len(ids))
            mean = np.add.reduceat(n * y, starts) / weight
            sums[0] += np.bincount(ids, n * (y - np.repeat(mean, cells)), len(v))
            np.minimum.at(sums[1], ids, np.repeat(np.minimum.reduceat(least[ids], starts), cells))
            sums[2] += float(weight @ mean**2)
            sums[3] += len(starts)
    for family, (q, low, ss, levels) in held.items():
        met = np.flatnonzero(low < len(low)).astype(np.int32)
        own = [[family], [met], [q[met]], [low[met]], [ss], [levels]]
        kinds = pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.float64(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(own, kinds, strict=True)], ["family", "id", "q", "least", "ss_x", "b"])


def _dense_given_x(cells: DataFrame) -> DataFrame:
    """The same from one entry for each pair of treatment levels; only that matrix reaches Python."""
    by_x = cells.groupBy("family", "x").agg(
        F.collect_list(F.struct("treatment", "n", "mean")).alias("_row"),
        F.sum("n").alias("_nx"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mx"),
    )
    rows = by_x.select("family", "_nx", "_mx", "_row", F.explode("_row").alias("_i"))
    pairs = rows.select("family", "_nx", "_mx", "_i", F.explode("_row").alias("_j"))
    n, same = F.col("_i.n"), F.col("_i.treatment") == F.col("_j.treatment")
    # the counts' product could overflow
    entry = F.when(same, n.cast("double")).otherwise(0.0) - n * (F.col("_j.n") / F.col("_nx"))
    matrix = (
        pairs.groupBy("family", F.col("_i.treatment").alias("i"), F.col("_j.treatment").alias("j"))
        .agg(F.sum(entry).alias("a"), F.sum(F.when(same, n * (F.col("_i.mean") - F.col("_mx")))).alias("b"))
        .groupBy("family")
        .agg(F.collect_list(F.struct("i", "j", "a", "b")).alias("entries"))
    )
    return matrix.withColumn("q", _quadratic_form("entries")).select(
        "family", F.col("q.ss").alias("ss_t_given_x"), F.col("q.rank").alias("t_rank")
    )


def _centred(cells: DataFrame) -> DataFrame:
    """The cells with the mean of their family, ``_m``; a family's cells stay where they are."""
    if "_m" in cells.columns:
        return cells
    grand = materialize(cells.groupBy("family").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_m")))
    return cells.join(broadcast_if_small(grand, FAMILY_ROW), "family")


def _between(centred: DataFrame, key: str, out: str, count: str) -> DataFrame:
    """SS of one factor alone, from cells that carry the family mean ``_m``."""
    by_level = centred.groupBy("family", key).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        F.first("_m").alias("_m"),
    )
    return by_level.groupBy("family").agg(
        F.sum(F.col("n") * _square(F.col("mean") - F.col("_m"))).alias(out),
        F.count(F.lit(1)).alias(count),
    )


def anova_factorial(cells: DataFrame, first: str = "treatment") -> DataFrame:
    """Sequential ANOVA of treatment, x as a factor, and their interaction.

    ``first`` states which main effect enters first; with unequal cell sizes
    the two orders differ. Give materialized cells: several sums read them.
    """
    centred = _centred(cells)
    whole = centred.groupBy("family").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("cells"),
        F.sum("ss").alias("rss"),
        F.sum(F.col("n") * _square(F.col("mean") - F.col("_m"))).alias("ss_cells"),
    )
    parts = (
        whole.join(_main_effects(centred), "family")
        .withColumn("ss_x_given_t", F.col("ss_x") + F.col("ss_t_given_x") - F.col("ss_t"))
        .withColumn("additive_df", F.col("b") - 1 + F.col("t_rank"))
    )
    a, b = F.col("a") - 1, F.col("b") - 1
    if first == "treatment":
        mains = [
            ("treatment", a, F.col("ss_t")),
            ("x", F.col("additive_df") - a, F.col("ss_x_given_t")),
        ]
    else:
        mains = [
            ("x", b, F.col("ss_x")),
            ("treatment", F.col("additive_df") - b, F.col("ss_t_given_x")),
        ]
    interaction = F.col("ss_cells") - F.col("ss_x") - F.col("ss_t_given_x")
    return _anova_rows(
        parts,
        [
            *mains,
            ("treatment:x", F.col("cells") - 1 - F.col("additive_df"), interaction),
            ("residual", F.col("n") - F.col("cells"), F.col("rss")),
        ],
    )


def nested_f_test(small: DataFrame, large: DataFrame) -> DataFrame:
    """F test of a model against a larger one; both tables give family, rss, df."""
    a = small.select("family", F.col("rss").alias("rss_small"), F.col("df").alias("df_small"))
    b = large.select("family", F.col("rss").alias("rss_large"), F.col("df").alias("df_large"))
    out = (
        a.join(b, "family")
        .withColumn("df_diff", F.col("df_small") - F.col("df_large"))
        .withColumn("ss_diff", F.col("rss_small") - F.col("rss_large"))
        .withColumn(
            "f",
            F.try_divide(
                _mean_square("ss_diff", "df_diff"), _mean_square("rss_large", "df_large")
            ),
        )
    )
    return out.withColumn("p", f_upper("f", "df_diff", "df_large"))


def predict_linear(grid: DataFrame, lines: DataFrame, keys=("treatment",), x: str = "x") -> DataFrame:
    """Fitted value of every line at every grid point of its treatment."""
    coef = lines.select("family", *keys, "intercept", "slope")
    return grid.join(coef, list(keys)).select(
        "family", *keys, x, (F.col("intercept") + F.col("slope") * F.col(x)).alias("fitted")
    )


def information_criteria(fits: DataFrame) -> DataFrame:
    """Log-likelihood, AIC and BIC from n, rss and parameters (sigma counts as one more)."""
    n, k = F.col("n").cast("double"), F.col("parameters") + 1
    loglik = -n / 2 * (F.ln(F.lit(2 * np.pi)) + F.ln(F.try_divide(F.col("rss"), n)) + 1)
    return (
        fits.withColumn("model_df", k)
        .withColumn("loglik", F.when(F.col("rss") > 0, loglik))
        .withColumn("aic", -2 * F.col("loglik") + 2 * F.col("model_df"))
        .withColumn("bic", -2 * F.col("loglik") + F.ln(n) * F.col("model_df"))
    )
