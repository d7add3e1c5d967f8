"""Registry of the checked queries, and rounding shared by queries and SQL.

Spark and DuckDB add in different orders, so computed doubles are compared to
six significant digits and probabilities to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialframe.sources import read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Moves exact decimal ties off the rounding boundary, alike on both sides.
_NUDGE = 3e-11
_ZERO = 1e-10


def register(
    name: str,
    exact: Sequence[str] = (),
    sig: Sequence[str] = (),
    prob: Sequence[str] = (),
    sql: str | None = None,
):
    """Register a query; ``sql`` is the inner statement whose columns are picked and rounded."""

    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(build(spark, folder), exact, sig, prob)

        run.__name__ = build.__name__
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = rounded_sql(sql, exact, sig, prob)
        return build

    return wrap


def rounded(df: DataFrame, exact, sig, prob) -> DataFrame:
    def digits(c: str):
        v = F.col(c).cast("double")
        text = F.format_string("%.5e", v * (1 + _NUDGE))
        return F.when(F.abs(v) < _ZERO, 0.0).when(v.isNotNull(), text.cast("double")).alias(c)

    def places(c: str):
        return (F.round(F.col(c) * 1e6 + _NUDGE) / 1e6).alias(c)

    return df.select(*exact, *(digits(c) for c in sig), *(places(c) for c in prob))


def rounded_sql(inner: str, exact, sig, prob) -> str:
    parts = [*exact]
    for c in sig:
        parts.append(
            f"CASE WHEN abs({c}) < {_ZERO} THEN 0.0::DOUBLE WHEN {c} IS NOT NULL THEN "
            f"CAST(printf('%.5e', CAST({c} AS DOUBLE) * {1 + _NUDGE!r}) AS DOUBLE) END AS {c}"
        )
    for c in prob:
        parts.append(f"round({c} * 1e6 + {_NUDGE}) / 1e6 AS {c}")
    return f"SELECT {', '.join(parts)} FROM ({inner}) AS result"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, folder, name)
