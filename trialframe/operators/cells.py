"""The one pass over raw rows: mergeable moments per family, treatment and x.

Every aggregate here is algebraic (count, mean, centred sums), so Spark combines
them map-side and a hot treatment or response ships one row per task. Responses
are aggregated side by side and unfolded into ``family`` rows only afterwards:
the hash table has one entry per cell, and raw rows are never multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _pairs(responses: Mapping[str, str | Column] | Sequence[str]):
    if not isinstance(responses, Mapping):
        responses = {name: name for name in responses}
    return [
        (name, _number(F.col(e) if isinstance(e, str) else e)) for name, e in responses.items()
    ]


def _number(e: Column) -> Column:
    """As double; NaN is a missing value."""
    return F.nanvl(e.cast("double"), F.lit(None).cast("double"))


# Responses side by side in one aggregate: more buffers would leave whole-stage codegen.
_CELL_BLOCK = 8
_LINE_BLOCK = 5


def _column(e: str | Column) -> Column:
    return F.col(e) if isinstance(e, str) else e


def _aggregated(
    df: DataFrame,
    pairs: list[tuple[str, Column]],
    keys: dict[str, Column],
    segment: str | Column | None,
    inputs: dict[str, Column],
    statistics: Callable[[str], Column],
    block: int,
) -> DataFrame:
    """family, keys and statistics of every response, from one scan.

    Up to ``block`` responses are aggregated side by side and unfolded
    afterwards; more are unfolded into rows before the aggregation, in the same
    scan. A segment is one more grouping column.
    """
    groups = dict(keys)
    if segment is not None:
        groups["_segment"] = _column(segment).cast("string")
    rows = df.select(
        *(c.alias(name) for name, c in groups.items()),
        *(c.alias(name) for name, c in inputs.items()),
        *(e.alias(f"_y{i}") for i, (_, e) in enumerate(pairs)),
    ).where(reduce(Column.__and__, [F.col(c).isNotNull() for c in (*groups, *inputs)], F.lit(True)))
    names = [name for name, _ in pairs]
    if len(pairs) <= block:
        wide = rows.groupBy(*groups).agg(*(statistics(f"_y{i}").alias(f"_s{i}") for i in range(len(pairs))))
        parts = F.array(*(F.struct(F.lit(n).alias("family"), F.col(f"_s{i}").alias("s")) for i, n in enumerate(names)))
        long = wide.select(*groups, F.inline(parts))
    else:
        parts = F.array(*(F.struct(F.lit(n).alias("family"), F.col(f"_y{i}").alias("_y")) for i, n in enumerate(names)))
        tall = rows.select(*groups, *inputs, F.inline(parts)).where(F.col("_y").isNotNull())
        long = tall.groupBy("family", *groups).agg(statistics("_y").alias("s"))
    if segment is not None:
        joined = F.concat_ws(":", F.col("family"), F.col("_segment"))
        long = long.withColumn("family", F.when(F.col("family") == "", F.col("_segment")).otherwise(joined))
    return long.select("family", *keys, "s.*").where(F.col("n") > 0)


def cell_stats(
    df: DataFrame,
    responses: Mapping[str, str | Column] | Sequence[str],
    treatment: str | Column = "treatment",
    x: str | Column = "x",
    segment: str | Column | None = None,
) -> DataFrame:
    """family, treatment, x -> n, mean, ss (sum of squares about the cell mean).

    Rows with a missing treatment, x, segment or response take no part, as in a
    model fit; NaN is missing. With a ``segment`` there is one family for each
    response and value of the segment, ``response:segment``, or the segment alone
    where the response is named ``""``.
    """
    x = _column(x)
    if df.select(x).dtypes[0][1] in ("double", "float"):
        x = F.nanvl(x, F.lit(None))
    keys = {"treatment": _column(treatment), "x": x}

    def statistics(y: str) -> Column:
        return F.struct(
            F.count(y).alias("n"), F.avg(y).alias("mean"), (F.var_pop(y) * F.count(y)).alias("ss")
        )

    return _aggregated(df, _pairs(responses), keys, segment, {}, statistics, _CELL_BLOCK)


def line_moments(
    df: DataFrame,
    responses: Mapping[str, str | Column] | Sequence[str],
    x: str | Column = "x",
    treatment: str | Column | None = "treatment",
    segment: str | Column | None = None,
) -> DataFrame:
    """family[, treatment] -> n, x_mean, y_mean, sxx, sxy, syy: all a line needs.

    Missing values and segments as in ``cell_stats``.
    """
    keys = {} if treatment is None else {"treatment": _column(treatment)}

    def statistics(y: str) -> Column:
        return F.struct(
            F.regr_count(y, "_x").alias("n"),
            F.regr_avgx(y, "_x").alias("x_mean"),
            F.regr_avgy(y, "_x").alias("y_mean"),
            F.regr_sxx(y, "_x").alias("sxx"),
            F.regr_sxy(y, "_x").alias("sxy"),
            F.regr_syy(y, "_x").alias("syy"),
        )

    return _aggregated(df, _pairs(responses), keys, segment, {"_x": _number(_column(x))}, statistics, _LINE_BLOCK)


def merge_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cell statistics of coarser groups, merged from finer cells.

    Exact and without cancellation: deviations are taken about the merged mean.
    """
    means = cells.groupBy(*keys).agg(
        F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_m")
    )
    return (
        cells.join(means, list(keys))
        .groupBy(*keys)
        .agg(
            F.first("_n").alias("n"),
            F.first("_m").alias("mean"),
            F.sum(F.col("ss") + F.col("n") * F.pow(F.col("mean") - F.col("_m"), F.lit(2))).alias("ss"),
        )
    )
