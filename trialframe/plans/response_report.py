"""From raw rows to the table behind a chart of means, for many responses at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trialframe.functions.scalar import signif_code
from trialframe.operators.cells import cell_stats
from trialframe.operators.charts import errorbar_table
from trialframe.operators.letters import letter_groups
from trialframe.operators.means import emmeans_cell, pairwise_contrasts
from trialframe.operators.windows import label_position
from trialframe.session import materialize


def response_report(
    df: DataFrame,
    responses: Mapping[str, str | Column] | Sequence[str],
    treatment: str | Column,
    x: str | Column,
    zero_bar_at=None,
    test_on: str | None = None,
    letters: bool = True,
) -> DataFrame:
    """Means with error bars, treatment test, letters over x, and label heights.

    Letters compare every pair of samplings of a treatment; ``letters=False``
    leaves them, and those pairs, out.

    The p of a sampling stands on all its rows, or, with ``test_on``, on the
    rows of that treatment only.

    The raw rows are read once, into the checkpointed cell table; every branch
    below (error, means, two sets of contrasts, letters) reads that table.
    """
    means = materialize(emmeans_cell(materialize(cell_stats(df, responses, treatment, x)), None))
    tests = _treatment_test(means)
    over_x = ("family", "treatment")
    lettered = means
    if letters:
        lettered = letter_groups(means, pairwise_contrasts(means, over_x, "x"), over_x, "x")
    out = lettered.join(tests, ["family", "x"], "left")
    if test_on is not None:
        out = out.withColumn("p", F.when(F.col("treatment") == test_on, F.col("p")))
    out = out.withColumn("signif", signif_code("p"))
    return errorbar_table(label_position(out, "above"), zero_bar_at)


def _treatment_test(means: DataFrame) -> DataFrame:
    """Smallest p of the treatment comparisons per sampling (the only one for two levels)."""
    return pairwise_contrasts(means).groupBy("family", "x").agg(F.min("p").alias("p"))
