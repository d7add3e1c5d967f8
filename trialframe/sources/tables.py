"""Small generated tables: literals, grids and evenly spaced positions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialframe.operators.windows import global_rank


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def expand_levels(df: DataFrame, **levels: Sequence) -> DataFrame:
    """Every row once per combination of the stated literal values.

    The product of two tables that share no column, with one side literal: an
    ``explode`` inside the scan stage, so no join and no shuffle.
    """
    for name, values in levels.items():
        df = df.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    return df


def factor_grid(
    levels: DataFrame, first: int, last: int, x: str = "x", fixed: Mapping[str, Sequence] | None = None
) -> DataFrame:
    """Full grid: every level row with every whole x from ``first`` to ``last``."""
    grid = levels.withColumn(x, F.explode(F.sequence(F.lit(first), F.lit(last))))
    return expand_levels(grid, **(fixed or {}))


def spaced_offsets(
    df: DataFrame,
    x: str,
    spans: Mapping[str, tuple[float, float]],
    treatment: str = "treatment",
    out: str = "offset",
) -> DataFrame:
    """Evenly spaced positions over the distinct x of the table, one span per level.

    The number of positions is taken from the data.
    """
    days = df.select(x).where(F.col(x).isNotNull()).distinct()
    ranked = global_rank(days, x, "_i", total="_n")
    parts = F.array(
        *(
            F.struct(
                F.lit(name).alias(treatment),
                F.lit(float(start)).alias("_from"),
                F.lit(float(stop)).alias("_to"),
            )
            for name, (start, stop) in spans.items()
        )
    )
    step = F.try_divide((F.col("_to") - F.col("_from")) * F.col("_i"), F.col("_n") - 1)
    return ranked.select(x, "_i", "_n", F.inline(parts)).select(
        x, treatment, (F.col("_from") + F.coalesce(step, F.lit(0.0))).alias(out)
    )
