"""The tables behind chart layers: bounds, smooths, bars and stacks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialframe.functions.scalar import either
from trialframe.operators.curves import Curve, fit_curve, predict_curve, self_start_fit
from trialframe.operators.least_squares import gram_ols
from trialframe.operators.windows import stage_window


def range_clip(
    df: DataFrame, x: str, y: str | None = None, x_limits: tuple | None = None, y_limits: tuple | None = None
) -> DataFrame:
    """Rows inside the axis limits; the others take no part in a smooth."""
    if x_limits:
        df = df.where(F.col(x).between(*x_limits))
    if y and y_limits:
        df = df.where(F.col(y).between(*y_limits))
    return df


def errorbar_table(means: DataFrame, zero_at=None, value: str = "emmean", se: str = "se", x: str = "x") -> DataFrame:
    """mean ± se, with the bar collapsed at a stated x."""
    if zero_at is not None:
        means = means.withColumn(se, either(F.col(x) == F.lit(zero_at), F.lit(0.0), F.col(se)))
    return means.withColumn("ymin", F.col(value) - F.col(se)).withColumn(
        "ymax", F.col(value) + F.col(se)
    )


def smooth_line(
    df: DataFrame,
    x: str = "x",
    y: str = "y",
    group: str = "treatment",
    points: int = 80,
    full_range: tuple[float, float] | None = None,
) -> DataFrame:
    """Straight-line smooth per group at evenly spaced x over the data (or axis) range."""
    rows = df.select(group, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    lines = rows.groupBy(group).agg(
        F.regr_slope("_y", "_x").alias("_b"),
        F.regr_intercept("_y", "_x").alias("_a"),
        F.min("_x").alias("_from"),
        F.max("_x").alias("_to"),
    )
    if full_range:
        lines = lines.withColumn("_from", F.lit(float(full_range[0]))).withColumn(
            "_to", F.lit(float(full_range[1]))
        )
    at = F.col("_from") + (F.col("_to") - F.col("_from")) * F.col("point") / (points - 1)
    return (
        lines.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", at)
        .select(group, "point", "x", (F.col("_a") + F.col("_b") * F.col("x")).alias("fitted"))
    )


def smooth_quadratic(
    df: DataFrame, grid: DataFrame, x: str = "x", y: str = "y", group: str = "treatment"
) -> DataFrame:
    """Quadratic smooth per group, evaluated on a grid of x."""
    at = F.col(x).cast("double")
    fit = gram_ols(df, y, {"x": at, "x2": at * at}, family=group)
    pick = lambda term: F.max(F.when(F.col("term") == term, F.col("estimate")))
    wide = fit.groupBy(F.col("family").alias(group)).agg(
        pick("(intercept)").alias("_a"), pick("x").alias("_b"), pick("x2").alias("_c")
    )
    g = F.col("x").cast("double")
    return grid.join(wide, group).select(
        group, "x", (F.col("_a") + F.col("_b") * g + F.col("_c") * g * g).alias("fitted")
    )


def smooth_curve(
    means: DataFrame, curve: Curve, starts, grid: DataFrame, keys: Sequence[str] = ("family", "treatment")
) -> DataFrame:
    """Curve drawn through the means, each mean counting once. Without ``starts`` (None) the curve finds its own."""
    points = means.select(
        *keys, "x", F.lit(1).cast("long").alias("n"), F.col("emmean").alias("mean"), F.lit(0.0).alias("ss")
    )
    on = [k for k in keys if k in grid.columns]
    fits = self_start_fit(points, curve, keys) if starts is None else fit_curve(points, curve, starts, keys)
    return predict_curve(grid, fits, curve, on)


def _level_order(column: str, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*(F.lit(v) for v in order)), F.col(column))


def stack_bounds(
    df: DataFrame,
    order: Sequence[str],
    value: str = "rate",
    level: str = "family",
    by: Sequence[str] = ("treatment", "x"),
) -> DataFrame:
    """Lower and upper edge of each level in a stack, in the stated level order.

    Levels that the order leaves out come last, by name.
    """
    place = _level_order(level, order)
    window = (
        Window.partitionBy(*by)
        .orderBy(F.when(place > 0, place).otherwise(len(order) + 1), level)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        df.withColumn("upper", F.sum(value).over(window))
        .withColumn("lower", F.col("upper") - F.col(value))
    )


def stage_bars(
    predictions: DataFrame,
    offsets: Mapping[str, float],
    thickness: float = 0.05,
    value: str = "value",
    x: str = "x",
    keys: Sequence[str] = ("family", "treatment"),
) -> DataFrame:
    """Start-to-end bar of each stage with its vertical place per treatment."""
    place = F.lit(None).cast("double")
    for name, offset in offsets.items():
        place = F.when(F.col("treatment") == name, F.lit(offset)).otherwise(place)
    return (
        stage_window(predictions, value, x, keys)
        .withColumn("y", place)
        .withColumn("ymin", F.col("y") - thickness)
        .withColumn("ymax", F.col("y") + thickness)
    )


def paired_means(
    a: DataFrame, b: DataFrame, name_a: str, name_b: str, keys: Sequence[str] = ("treatment", "x")
) -> DataFrame:
    """Two responses' means and errors side by side, one row per treatment and x."""
    keys = list(keys)
    left = a.select(*keys, F.col("emmean").alias(name_a), F.col("se").alias(f"{name_a}_se"))
    right = b.select(*keys, F.col("emmean").alias(name_b), F.col("se").alias(f"{name_b}_se"))
    return left.join(right, keys, "left")
