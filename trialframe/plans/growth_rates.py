"""From predicted curves to daily rates, stages, shares and treatment ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from trialframe.operators.reshape import treatment_contrast_wide
from trialframe.operators.windows import (
    daily_rate,
    relative_allocation,
    relative_rate,
    stage_window,
)
from trialframe.session import materialize


def growth_rate_report(
    predictions: DataFrame, baseline: str, other: str, leave_out: Sequence[str] = ()
) -> DataFrame:
    """One row per family, treatment and x with a positive rate.

    predictions: family, treatment, x, value on a daily grid. Adds the rate, its
    share of the family's peak and of the day's total, the stage limits of the
    family, and ratio and difference of the two stated treatments.
    """
    predictions = materialize(predictions.where(~F.col("family").isin(list(leave_out))))
    rates = materialize(daily_rate(predictions).where(F.col("rate") > 0))
    stages = stage_window(predictions)
    contrast = treatment_contrast_wide(rates, baseline, other).select(
        "family", "x", "ratio", "difference"
    )
    cell = ["family", "treatment", "x"]
    return (
        relative_rate(rates)
        .join(relative_allocation(rates).select(*cell, "relative_allocation"), cell)
        .join(stages, ["family", "treatment"])
        .join(contrast, ["family", "x"], "left")
    )
