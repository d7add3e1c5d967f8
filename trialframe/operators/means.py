"""Marginal means, slopes, pairwise comparisons."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from trialframe.functions.probability import range_upper, t_quantile, t_two_sided
from trialframe.operators.linear import ancova_fit, cell_means_fit, pooled_line_error
from trialframe.session import materialize

BLOCK_LEVELS = 512  # levels that meet as many others as one pair of rows
TILES = 32  # parts of a by-group: no level is shipped more often than there are parts, plus one
LEAST_PAIRS, MOST_PAIRS = 1 << 14, 1 << 21  # of a task: fewer are not dealt on, more are


def _critical(per_family: DataFrame, level: float | None) -> DataFrame:
    """Critical value of t, found on the table with one row per family."""
    value = F.lit(None).cast("double") if level is None else t_quantile(F.lit(level), "df")
    return per_family.withColumn("_crit", value)


def _with_limits(df: DataFrame, value: str, level: float | None) -> DataFrame:
    if level is None:
        return df.drop("_crit")
    reach = F.col("_crit") * F.col("se")
    return (
        df.withColumn("lower", F.col(value) - reach)
        .withColumn("upper", F.col(value) + reach)
        .drop("_crit")
    )


def emmeans_cell(cells: DataFrame, level: float | None = 0.95) -> DataFrame:
    """family, treatment, x -> emmean, se, df (, lower, upper) from the pooled error."""
    fit = _critical(cell_means_fit(cells).select("family", "df", "sigma"), level)
    means = cells.join(fit, "family").select(
        "family",
        "treatment",
        "x",
        F.col("n"),
        F.col("mean").alias("emmean"),
        (F.col("sigma") / F.sqrt(F.col("n").cast("double"))).alias("se"),
        "df",
        "_crit",
    )
    return _with_limits(means, "emmean", level)


def emmeans_one_way(treatment_cells: DataFrame, level: float | None = 0.95) -> DataFrame:
    return emmeans_cell(treatment_cells, level).drop("x")


def emmeans_at_mean(moments: DataFrame, level: float | None = 0.95) -> DataFrame:
    """Height of each treatment's line at the overall mean of x."""
    fit = ancova_fit(moments)
    centre = fit.groupBy("family").agg(
        (F.sum(F.col("n") * F.col("x_mean")) / F.sum("n")).alias("at_x"),
        F.first("df").alias("df"),
    )
    centre = _critical(centre, level).drop("df")
    gap = F.col("at_x") - F.col("x_mean")
    means = fit.join(centre, "family").select(
        "family",
        "treatment",
        "at_x",
        (F.col("intercept") + F.col("slope") * F.col("at_x")).alias("emmean"),
        (
            F.col("sigma")
            * F.sqrt(F.lit(1.0) / F.col("n") + F.try_divide(gap * gap, F.col("sxx")))
        ).alias("se"),
        "df",
        "_crit",
    )
    return _with_limits(means, "emmean", level)


def trend_slopes(moments: DataFrame, level: float | None = 0.95) -> DataFrame:
    """Slope of each treatment's line, with the pooled error."""
    pooled = _critical(pooled_line_error(moments).select("family", "df", "sigma"), level)
    slopes = moments.join(pooled, "family").select(
        "family",
        "treatment",
        F.try_divide(F.col("sxy"), F.col("sxx")).alias("slope"),
        F.try_divide(F.col("sigma"), F.sqrt("sxx")).alias("se"),
        "df",
        "_crit",
    )
    return _with_limits(slopes, "slope", level)


def trend_test(slopes: DataFrame) -> DataFrame:
    """Each slope against zero."""
    out = slopes.withColumn("t", F.try_divide(F.col("slope"), F.col("se")))
    return out.withColumn("p", t_two_sided("t", "df"))


def pairwise_contrasts(
    estimates: DataFrame,
    by: Sequence[str] = ("family", "x"),
    level: str = "treatment",
    value: str = "emmean",
    p_values: bool = True,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """Every pair of levels inside a by-group: first minus second in level order.

    Estimates of one by-group are independent (separate cells or lines), so
    variances add. p is Tukey-adjusted for the number of levels; for two levels
    that is the t test. A level that cannot be estimated is left out. The pairs
    are pairs of factor levels in the means table, never of observations.
    """
    by = list(by)
    a, b, keys = _dealt(estimates, by, level, value, block_levels)
    met = a.join(b, keys).where((F.col("_lo") != F.col("_hi")) | (F.col("_ba") <= F.col("_bb")))
    rows = met.withColumn("_u", F.explode("_ra")).withColumn("_v", F.explode("_rb"))
    ordered, turned = F.col("_u.level") < F.col("_v.level"), F.col("_v.level") < F.col("_u.level")
    pick = lambda u, v: F.when(ordered, u).otherwise(v)
    gap = pick(F.col("_u.value") - F.col("_v.value"), F.col("_v.value") - F.col("_u.value"))
    pairs = (
        rows.where(ordered | (turned & (F.col("_ba") != F.col("_bb"))))
        .select(
            *by,
            pick(F.col("_u.level"), F.col("_v.level")).alias("level_a"),
            pick(F.col("_v.level"), F.col("_u.level")).alias("level_b"),
            gap.alias("difference"),
            F.sqrt(F.col("_u.se") * F.col("_u.se") + F.col("_v.se") * F.col("_v.se")).alias("se"),
            pick(F.col("_u.df"), F.col("_v.df")).alias("df"),
            "levels",
        )
        .withColumn("t", F.try_divide(F.col("difference"), F.col("se")))
    )
    if not p_values:
        return pairs.drop("levels")
    return pairs.withColumn("p", range_upper(F.abs("t") * F.sqrt(F.lit(2.0)), "levels", "df"))


def _dealt(estimates: DataFrame, by: list[str], level: str, value: str, block_levels: int):
    """The two sides of the pairs and their keys: rows are blocks of levels.

    A by-group's blocks are dealt into up to ``TILES`` tiles, and each pair of tiles is a join
    key of its own. Shuffled rows grow with the levels, not with their square, however small
    the blocks; a task holds one tile of one side and streams the other, never the pairs.
    The number of tasks follows the pairs, which are counted: their bytes before the join say nothing.
    """
    known = estimates.where(F.col(value).isNotNull())
    sizes = known.groupBy(*by).agg(F.count(F.lit(1)).alias("levels"))
    blocks = F.ceil(F.col("levels") / F.lit(block_levels)).cast("int")
    row = F.struct(F.col(level).alias("level"), F.col(value).alias("value"), "se", "df")
    held = materialize(
        known.join(sizes, by)
        .groupBy(*by, "levels", F.pmod(F.xxhash64(F.col(level)), blocks).cast("int").alias("_block"))
        .agg(F.collect_list(row).alias("_rows"))
    )
    tiles = F.least(blocks, F.lit(TILES))
    own = F.col("_block") % tiles
    keys = [*by, "_lo", "_hi"]
    met = F.sum(F.size("_rows") * (F.col("levels") - 1.0) / 2)
    pairs, deals = held.agg(F.coalesce(met, F.lit(0.0)), F.coalesce(F.sum((tiles + 1) / 2 / blocks * tiles), F.lit(0.0))).first()
    shuffled = int(estimates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(math.ceil(deals), max(min(shuffled, math.ceil(pairs / LEAST_PAIRS)), math.ceil(pairs / MOST_PAIRS))))
    first = held.select(*by, "levels", own.alias("_lo"), F.explode(F.sequence(own, tiles - 1)).alias("_hi"), F.col("_block").alias("_ba"), F.col("_rows").alias("_ra"))
    second = held.select(*by, F.explode(F.sequence(F.lit(0), own)).alias("_lo"), own.alias("_hi"), F.col("_block").alias("_bb"), F.col("_rows").alias("_rb"))
    return first.repartition(tasks, *keys), second.repartition(tasks, *keys), keys


def trend_contrasts(slopes: DataFrame) -> DataFrame:
    return pairwise_contrasts(slopes, by=("family",), value="slope")


def pairwise_matrix(
    estimates: DataFrame,
    contrasts: DataFrame,
    by: Sequence[str] = ("family", "x"),
    level: str = "treatment",
    value: str = "emmean",
) -> DataFrame:
    """Long matrix: means on the diagonal, p above it, differences below."""
    by = list(by)
    text = lambda c: F.col(c).cast("string")
    diagonal = estimates.where(F.col(value).isNotNull()).select(
        *by,
        text(level).alias("row"),
        text(level).alias("col"),
        F.lit("mean").alias("kind"),
        F.col(value).alias("value"),
    )
    pairs = contrasts.select(
        *by,
        F.inline(
            F.array(
                F.struct(text("level_a").alias("row"), text("level_b").alias("col"),
                         F.lit("p").alias("kind"), F.col("p").alias("value")),
                F.struct(text("level_b").alias("row"), text("level_a").alias("col"),
                         F.lit("difference").alias("kind"), F.col("difference").alias("value")),
            )
        ),
    )
    return diagonal.unionByName(pairs)
