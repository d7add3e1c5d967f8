"""Ordered and group-relative calculations.

Group maxima and totals are taken by aggregation and joined back, so a hot
group is combined map-side and never sorted in one task. True ordered windows
(lag, running sums) run over tables with one row per group and x: their
partitions hold a sampling calendar, not raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialframe.session import materialize


def group_share(
    df: DataFrame, value: str, keys: Sequence[str], of: str, out: str, positive_only: bool = True
) -> DataFrame:
    """value / (max or sum of value in its group), over rows with value > 0."""
    rows = df.where(F.col(value) > 0) if positive_only else df
    whole = rows.groupBy(*keys).agg({"max": F.max, "sum": F.sum}[of](value).alias("_whole"))
    return (
        rows.join(whole, list(keys))
        .withColumn(out, F.try_divide(F.col(value), F.col("_whole")))
        .drop("_whole")
    )


def global_rank(
    df: DataFrame, order: str, out: str = "rank", total: str | None = None
) -> DataFrame:
    """Place (from 0) of every row in the order of a unique column, without a one-task window.

    Rows are range-partitioned and ranked inside their partition; only the
    partition sizes, one row each, meet to give the offsets (and the number of
    rows, as column ``total``).
    """
    part = F.spark_partition_id().alias("_part")
    ranged = materialize(df.repartitionByRange(order).select("*", part))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
            *([F.sum("_rows").over(Window.partitionBy()).alias(total)] if total else []),
        )
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return (
        ranged.withColumn("_inside", inside)
        .join(offsets, "_part")
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_part", "_inside", "_offset")
    )


def relative_rate(rates: DataFrame, value: str = "rate", keys: Sequence[str] = ("family",)) -> DataFrame:
    return group_share(rates, value, keys, "max", "relative_rate")


def relative_allocation(
    rates: DataFrame, value: str = "rate", keys: Sequence[str] = ("x", "treatment")
) -> DataFrame:
    return group_share(rates, value, keys, "sum", "relative_allocation")


def stage_window(
    df: DataFrame,
    value: str = "value",
    x: str = "x",
    keys: Sequence[str] = ("family", "treatment"),
    start_share: float = 0.15,
    end_share: float = 0.85,
) -> DataFrame:
    """First x at or above a share of the group maximum, last x at or below another."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    return (
        df.join(top, list(keys))
        .groupBy(*keys)
        .agg(
            F.min(F.when(F.col(value) >= F.col("_top") * start_share, F.col(x))).alias("start_x"),
            F.max(F.when(F.col(value) <= F.col("_top") * end_share, F.col(x))).alias("end_x"),
        )
    )


def contingency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of the combinations that occur; rows with a missing key are left out."""
    return df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def rank_by_frequency(df: DataFrame, unit: str, columns: Sequence[str]) -> DataFrame:
    """Contingency rows ordered by how often their unit occurs, then by unit.

    The order key (freq, unit) is kept as columns: a range-partitioned sort can
    use it directly, where a running rank over all units would need one task. The
    counts are written once; their totals are taken from them, not from the rows.
    """
    counts = materialize(
        df.where(F.col(unit).isNotNull())
        .groupBy(unit, *columns)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    freq = counts.groupBy(unit).agg(F.sum("n").alias("freq"))
    return counts.join(freq, unit).dropna(subset=list(columns)).orderBy("freq", unit, *columns)


def _ordered(keys: Sequence[str], x: str):
    return Window.partitionBy(*keys).orderBy(x)


def daily_rate(
    df: DataFrame, value: str = "value", x: str = "x", keys: Sequence[str] = ("family", "treatment")
) -> DataFrame:
    """Change since the previous x, zero on the first."""
    before = F.lag(value).over(_ordered(keys, x))
    first = F.row_number().over(_ordered(keys, x)) == 1
    return df.withColumn("rate", F.when(first, F.lit(0.0)).otherwise(F.col(value) - before))


def interval_loss(
    df: DataFrame, value: str = "value", x: str = "x", keys: Sequence[str] = ("family", "treatment")
) -> DataFrame:
    """Drop since the previous x, NULL on the first."""
    return df.withColumn("loss", F.lag(value).over(_ordered(keys, x)) - F.col(value))


def running_interval(
    df: DataFrame, x: str = "x", keys: Sequence[str] = ("family", "treatment")
) -> DataFrame:
    """Gap to the next x and its running total; NULL from the last x on."""
    window = _ordered(keys, x)
    gap = F.lead(x).over(window) - F.col(x)
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("gap", gap)
    return df.withColumn(
        "elapsed", F.when(F.col("gap").isNotNull(), F.sum("gap").over(running))
    )


def accumulated_area(
    means: DataFrame,
    factor: float,
    value: str = "emmean",
    x: str = "x",
    keys: Sequence[str] = ("family", "treatment"),
) -> DataFrame:
    """Running sum of value x factor, times running interval, halved.

    Not a trapezoid rule: both running totals are multiplied, as the analysis does.
    """
    running = _ordered(keys, x).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = running_interval(means, x, keys)
    return df.withColumn("running_value", F.sum(F.col(value) * factor).over(running)).withColumn(
        "accumulated", F.col("running_value") * F.col("elapsed") / 2
    )


def label_position(
    means: DataFrame, how: str, by: Sequence[str] = ("family", "x"), value: str = "emmean", se: str = "se"
) -> DataFrame:
    """Height of a chart label beside its group of means.

    how: ``above`` max(mean) + own se; ``below`` min(mean) − own se;
    ``below_bar`` min(mean − se); ``beside`` 1.5 se above the largest mean of
    the group and 1.5 se below every other.
    """
    group = Window.partitionBy(*by)
    m, s = F.col(value), F.col(se)
    places: dict[str, Column] = {
        "above": F.max(m).over(group) + s,
        "below": F.min(m).over(group) - s,
        "below_bar": F.min(m - s).over(group),
        "beside": F.when(m == F.max(m).over(group), m + s + s * 0.5).otherwise(m - s - s * 0.5),
    }
    return means.withColumn("label_y", places[how])
