"""Domain calculations on means, slopes and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from trialframe.functions.scalar import CARBON_SHARE_CO2, CARBON_SHARE_GLUCAN, CO2_MOLAR_MASS
from trialframe.operators.windows import interval_loss
from trialframe.sources.tables import expand_levels


def cumulative_emission(rates: DataFrame, durations: Sequence[int], rate: str = "emmean") -> DataFrame:
    """Amount released over each duration, from a rate per minute in micromoles.

    Whole micromoles (rounded half to even), then mg of gas and mg of carbon.
    """
    days = expand_levels(rates, days=durations)
    return (
        days.withColumn("co2_umol", F.bround(F.col(rate) * 60 * 24 * F.col("days"), 0))
        .withColumn("co2_mg", F.col("co2_umol") / 1000000 * CO2_MOLAR_MASS * 1000)
        .withColumn("co2_mg_c", F.col("co2_mg") * CARBON_SHARE_CO2)
    )


def interval_loss_report(
    means: DataFrame, day_shift: int, value: str = "emmean", keys: Sequence[str] = ("family", "treatment")
) -> DataFrame:
    """Loss between consecutive means given in percent: mg per g, and as carbon."""
    amount = means.withColumn("days", F.abs(F.col("x") + day_shift)).withColumn(
        "amount_mg", F.col(value) * 10
    )
    return (
        interval_loss(amount, "amount_mg", "x", keys)
        .withColumnRenamed("loss", "loss_mg")
        .withColumn("loss_mg_c", F.col("loss_mg") * CARBON_SHARE_GLUCAN)
    )


def trend_loss(slopes: DataFrame, durations: Sequence[int], slope: str = "slope") -> DataFrame:
    """Loss over each duration from a fitted slope in percent per day."""
    days = expand_levels(slopes, days=durations)
    return (
        days.withColumn("loss_rate_mg", -F.col(slope) * 10)
        .withColumn("loss_mg", F.bround(F.col("loss_rate_mg") * F.col("days"), 2))
        .withColumn("loss_mg_c", F.col("loss_mg") * CARBON_SHARE_GLUCAN)
    )


def percent_explained(
    emission: DataFrame, loss: DataFrame, keys: Sequence[str] = ("treatment", "days")
) -> DataFrame:
    """Emitted carbon as a percentage of lost carbon; a missing loss gives NULL."""
    keys = list(keys)
    return (
        emission.select(*keys, "co2_mg_c")
        .join(loss.select(*keys, "loss_mg_c"), keys, "left")
        .withColumn("percent", F.try_divide(F.lit(100.0) * F.col("co2_mg_c"), F.col("loss_mg_c")))
    )


def join_means(
    tables: dict[str, DataFrame], keys: Sequence[str] = ("treatment", "x"), value: str = "emmean"
) -> DataFrame:
    """Means of several responses side by side; the first table decides the rows."""
    out = None
    for name, table in tables.items():
        part = table.select(*keys, F.col(value).alias(name))
        out = part if out is None else out.join(part, list(keys), "left")
    return out


def component_check(
    parts: dict[str, DataFrame], whole: DataFrame, keys: Sequence[str] = ("treatment", "x")
) -> DataFrame:
    """Means of the parts, their sum, and the separately measured whole beside it."""
    joined = join_means({**parts, "whole": whole}, keys)
    total = sum((F.col(p) for p in list(parts)[1:]), F.col(list(parts)[0]))
    return joined.withColumn("total", total)


def response_ratio(
    tables: dict[str, DataFrame],
    ratios: dict[str, tuple[str, str]],
    keys: Sequence[str] = ("treatment", "x"),
) -> DataFrame:
    joined = join_means(tables, keys)
    for name, (top, bottom) in ratios.items():
        joined = joined.withColumn(name, F.try_divide(F.col(top), F.col(bottom)))
    return joined
