"""Cleaning of observation tables: masks, flags, duplicate and outlier removal."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trialframe.session import broadcast_if_small, materialize


def outlier_mask(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Null one cell per matching rule, keep the row.

    Rules run in order, each seeing the values the earlier ones left; an
    unknown predicate does not match. Narrow: no shuffle.
    """
    for target, predicate in rules:
        hit = F.coalesce(predicate, F.lit(False))
        df = df.withColumn(target, F.when(~hit, F.col(target)))
    return df


def duplicate_mask(
    df: DataFrame, columns: Sequence[str], row_id: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Null every repeat of a value after its first row, per column.

    The first row of each value is a map-side combined ``min(row_id)``, and the
    result is joined back on the unique row id. A value (or NULL) held by a
    third of all rows therefore never meets in one task, as it would in a
    window partitioned by value; the number of shuffles does not grow with the
    number of columns. Values keep their type where all columns share one and
    are compared as text otherwise, so large integers stay exact; NaN is missing.

    ``row_id`` is unique and states the order of rows. A row without one has no place in
    that order: it counts as a repeat and its values are nulled.
    """
    types = dict(df.dtypes)
    common = len({types[c] for c in columns}) == 1

    def value(c: str) -> Column:
        v = F.col(c)
        if types[c] in ("double", "float"):
            v = F.nanvl(v, F.lit(None)) + F.lit(0).cast(types[c])  # one zero for both signs
        return v if common else v.cast("string")

    values = F.array(
        *(F.struct(F.lit(i).alias("_c"), value(c).alias("_v")) for i, c in enumerate(columns))
    )
    first = (
        df.select(row_id, *keys, F.inline(values))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_c", "_v")
        .agg(F.min(row_id).alias(row_id))
        .groupBy(row_id)
        .agg(*(F.max(F.col("_c") == i).alias(f"_keep{i}") for i in range(len(columns))))
    )
    joined = df.join(first, row_id, "left")
    for i, c in enumerate(columns):
        joined = joined.withColumn(c, F.when(F.col(f"_keep{i}"), F.col(c)))
    return joined.drop(*(f"_keep{i}" for i in range(len(columns))))


def membership_flag(
    df: DataFrame,
    members: DataFrame,
    key: str,
    out: str = "status",
    inside: str = "dead",
    outside: str = "alive",
) -> DataFrame:
    """Label rows by whether their key is in a list; a NULL key is outside.

    The distinct list is written once and counted: a list within the broadcast
    bound spares the observations a shuffle, a longer one is joined by key.
    """
    listed = members.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    listed = broadcast_if_small(materialize(listed.withColumn("_listed", F.lit(True))), 100)
    return (
        df.join(listed, key, "left")
        .withColumn(out, F.when(F.col("_listed"), inside).otherwise(outside))
        .drop("_listed")
    )


def replace_columns(df: DataFrame, **steps: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """Derived columns in order; a later step sees what an earlier one replaced."""
    for name, step in steps.items():
        df = df.withColumn(name, step(df) if callable(step) and not isinstance(step, Column) else step)
    return df
