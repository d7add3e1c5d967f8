"""Wide to long and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def predictions_long(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "family", value: str = "value"
) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def treatment_contrast_wide(
    df: DataFrame,
    baseline: str,
    other: str,
    value: str = "rate",
    keys: Sequence[str] = ("family", "x"),
    treatment: str = "treatment",
) -> DataFrame:
    """One row per key, one column per level, with ratio and difference.

    Levels are stated, so no pass over the data is needed to find them.
    """
    wide = df.groupBy(*keys).pivot(treatment, [baseline, other]).agg(F.first(value))
    base, new = F.col(f"`{baseline}`"), F.col(f"`{other}`")
    return wide.withColumn("ratio", F.try_divide(new, base)).withColumn("difference", new - base)
