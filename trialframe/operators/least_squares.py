"""General least squares from named term expressions.

One pass over the rows builds the centred Gram matrix of every family: from
mergeable covariances for a few terms, from dense blocks made batch by batch for
many. Only that p x p matrix, one row per family, is solved in numpy, by the sweep
operator in the order of the terms. Centring happens before the products, so no
squares of raw values are ever summed.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructType

from trialframe.functions.probability import f_upper, t_two_sided
from trialframe.session import materialize

FEW_TERMS = 5  # covariances of as many stay within whole-stage codegen
HELD_BYTES = 64 << 20  # of the blocks that a task holds before it hands them on
ALIASED = 1e-11  # share of a term's sum of squares that others must leave unexplained


def gram_table(
    df: DataFrame, response: str | Column, terms: Mapping[str, Column], family: str | Column = "family"
) -> DataFrame:
    """family -> n, means (terms, response), upper triangle of the centred Gram matrix.

    Rows with a missing term or response are left out. Up to ``FEW_TERMS`` terms stay
    within whole-stage codegen; more are summed in dense blocks. Wherever the terms
    depend on treatment and x alone, ``gram_table_from_cells`` is the cheaper way.
    """
    if len(terms) > FEW_TERMS:
        return gram_table_dense(df, response, terms, family)
    rows, size = _design(df, response, terms, family)
    rows = rows.dropna()
    sums = [
        (F.covar_pop(f"_v{i}", f"_v{j}") * F.count(F.lit(1))).alias(f"_g{i}_{j}")
        for i in range(size)
        for j in range(i, size)
    ]
    means = [F.avg(f"_v{i}").alias(f"_m{i}") for i in range(size)]
    gram = F.array(*(F.col(f"_g{i}_{j}") for i in range(size) for j in range(i, size)))
    return rows.groupBy("family").agg(F.count(F.lit(1)).alias("n"), *means, *sums).select(
        "family", "n", F.array(*(F.col(f"_m{i}") for i in range(size))).alias("means"), gram.alias("gram")
    )


def _design(df: DataFrame, response: str | Column, terms: Mapping[str, Column], family: str | Column) -> tuple[DataFrame, int]:
    """(family, _v0, _v1, ...): terms, then the response; and the number of columns."""
    response = F.col(response) if isinstance(response, str) else response
    family = F.col(family) if isinstance(family, str) else family
    columns = [c.cast("double") for c in terms.values()] + [response.cast("double")]
    rows = df.select(family.alias("family"), *(c.alias(f"_v{i}") for i, c in enumerate(columns)))
    return rows, len(columns)


class _Blocks:
    """Count, means and centred products of the rows of each family that a task has seen."""

    def __init__(self, size: int):
        self.size, self.found = size, {}

    def add(self, family: object, rows: np.ndarray) -> None:
        n, mean = len(rows), rows.mean(axis=0)
        away = rows - mean
        gram = away.T @ away
        if family in self.found:
            n0, mean0, gram0 = self.found[family]
            gap = mean - mean0
            gram = gram0 + gram + np.outer(gap, gap) * (n0 * n / (n0 + n))
            n, mean = n0 + n, mean0 + gap * (n / (n0 + n))
        self.found[family] = (n, mean, gram)

    def taken(self) -> pa.RecordBatch:
        upper = np.triu_indices(self.size)
        families, values = list(self.found), list(self.found.values())
        self.found = {}
        return pa.RecordBatch.from_arrays(
            [
                pa.array(families, pa.string()),
                pa.array([n for n, _, _ in values], pa.int64()),
                pa.array([m for _, m, _ in values], pa.list_(pa.float64())),
                pa.array([g[upper] for _, _, g in values], pa.list_(pa.float64())),
            ],
            names=["family", "n", "means", "gram"],
        )


def gram_table_dense(
    df: DataFrame, response: str | Column, terms: Mapping[str, Column], family: str | Column = "family"
) -> DataFrame:
    """The Gram table of any number of terms, from one pass over the rows.

    Every Arrow batch gives one matrix product for each family in it, at a cost of p² for a
    row. A task merges its batches' blocks about their common means, and hands them on as one
    row for each family, earlier if they would exceed ``HELD_BYTES``. Blocks of all tasks are
    shifted to the family's mean and added entry by entry, so no task gathers a family's blocks.
    """
    rows, size = _design(df, response, terms, family)
    kind = rows.schema["family"].dataType
    rows = rows.withColumn("family", F.col("family").cast("string"))
    most = max(1, HELD_BYTES // (8 * size * size + 200))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(size)
        for batch in batches:
            if not len(batch):
                continue
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            # incomplete rows leave here: as a filter, their tests multiply in Catalyst with the terms
            whole = ~np.isnan(values).any(axis=1) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            if not whole.any():
                continue
            values = values[whole]
            names = batch.column(0).dictionary_encode()
            group, spelled = names.indices.to_numpy(zero_copy_only=False)[whole].astype(np.int64), names.dictionary.to_pylist()
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
            for lo, hi in zip(first, np.append(first[1:], len(order))):
                blocks.add(spelled[group[order[lo]]], values[order[lo:hi]])
                if len(blocks.found) >= most:
                    yield blocks.taken()
        if blocks.found:
            yield blocks.taken()

    schema = "family string, n bigint, means array<double>, gram array<double>"
    parts = materialize(rows.mapInArrow(run, schema))
    share = parts.select("family", "n", F.posexplode("means").alias("_i", "_m"))
    means = share.groupBy("family", "_i").agg((F.sum(F.col("n") * F.col("_m")) / F.sum("n")).alias("_m"), F.sum("n").alias("_n"))
    centre = materialize(
        means.groupBy("family").agg(
            F.first("_n").alias("_n"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("_centre")
        )
    )  # one row for each family
    row, column = (F.array(*map(F.lit, at.tolist())) for at in np.triu_indices(size))
    shifted = parts.join(centre, parts["family"] == centre["family"]).select(
        parts["family"].alias("family"), "n", "means", "_centre", F.posexplode("gram").alias("_k", "_g")
    )

    def away(at: Column) -> Column:
        return F.get("means", F.get(at, F.col("_k"))) - F.get("_centre", F.get(at, F.col("_k")))

    entries = (
        shifted.select("family", "_k", (F.col("_g") + F.col("n") * away(row) * away(column)).alias("_g"))
        .groupBy("family", "_k")
        .agg(F.sum("_g").alias("_g"))
    )
    gram = entries.groupBy("family").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_g"))), lambda s: s["_g"]).alias("gram"))
    out = gram.join(centre, gram["family"] == centre["family"])
    return out.select(gram["family"].cast(kind).alias("family"), F.col("_n").alias("n"), F.col("_centre").alias("means"), "gram")


_SOLUTION = (
    StructType()
    .add("estimate", ArrayType(DoubleType()))
    .add("unit_variance", ArrayType(DoubleType()))
    .add("ss", ArrayType(DoubleType()))
    .add("aliased", ArrayType(BooleanType()))
    .add("parameters", LongType())
    .add("rss", DoubleType())
    .add("tss", DoubleType())
)


def sweep(matrix: np.ndarray, tolerance: float = ALIASED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sweeps all rows but the last of a symmetric matrix, in order.

    Returns the swept matrix, which rows were swept, and by how much each of them lowered the
    last diagonal entry. A row whose diagonal falls below ``tolerance`` of its own first value
    depends on rows before it and is left out.
    """
    m = matrix.copy()
    size = len(m) - 1
    used, drop = np.zeros(size, bool), np.zeros(size)
    for k in range(size):
        pivot = m[k, k]
        if not pivot > tolerance * matrix[k, k]:
            continue
        before = m[-1, -1]
        row = m[k] / pivot
        m -= np.outer(m[:, k], row)
        m[k], m[:, k] = row, row
        m[k, k] = -1 / pivot
        used[k], drop[k] = True, before - m[-1, -1]
    return m, used, drop


@F.pandas_udf(_SOLUTION)
def _solve_centred(n: pd.Series, means: pd.Series, gram: pd.Series) -> pd.DataFrame:
    out = []
    for rows, mean, flat in zip(n, means, gram):
        mean, size = np.asarray(mean, float), len(mean)
        full = np.zeros((size, size))
        full[np.triu_indices(size)] = np.asarray(flat, float)
        full = full + np.triu(full, 1).T
        scale = np.sqrt(np.diag(full))
        # a term that is constant up to the rounding of its mean has no scatter of its own
        flat_term = scale <= 1e-13 * np.abs(mean) * np.sqrt(max(rows, 1))
        flat_term[-1] = False
        unit = np.where(scale > 0, scale, 1.0)
        work = full / np.outer(unit, unit)
        work[flat_term], work[:, flat_term] = 0.0, 0.0
        swept, used, drop = sweep(work)
        slope = np.where(used, swept[-1, :-1], 0.0) * unit[-1] / unit[:-1]
        covariance = -np.where(np.outer(used, used), swept[:-1, :-1], 0.0) / np.outer(unit[:-1], unit[:-1])
        centre = mean[:-1]
        estimate = np.append(mean[-1] - centre @ slope, np.where(used, slope, np.nan))
        variance = np.append(1 / rows + centre @ covariance @ centre, np.where(used, np.diag(covariance), np.nan))
        known = lambda v: [None if np.isnan(x) else float(x) for x in v]
        total = float(full[-1, -1])
        rss = max(float(swept[-1, -1]) * unit[-1] ** 2, 0.0)
        out.append((known(estimate), known(variance), (drop * unit[-1] ** 2).tolist(), [False, *(~used).tolist()], 1 + int(used.sum()), rss, total))
    return pd.DataFrame(out, columns=["estimate", "unit_variance", "ss", "aliased", "parameters", "rss", "tss"])


def gram_table_from_cells(cells: DataFrame, terms: Mapping[str, Column]) -> DataFrame:
    """The same Gram table from cell statistics, for terms of treatment and x only.

    Raw rows are reduced by three aggregates per response instead of one per
    pair of terms; the pairs are summed over the cell table. Give materialized
    cells: they are read twice, for the means and for the deviations from them.
    """
    columns = [c.cast("double") for c in terms.values()] + [F.col("mean")]
    size = len(columns)
    rows = cells.select(
        "family", "n", "ss", *(c.alias(f"_v{i}") for i, c in enumerate(columns))
    ).dropna()
    n = F.col("n")
    centre = rows.groupBy("family").agg(
        F.sum("n").alias("_n"),
        F.sum("ss").alias("_ss"),
        *((F.sum(n * F.col(f"_v{i}")) / F.sum("n")).alias(f"_m{i}") for i in range(size)),
    )
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    away = lambda i: F.col(f"_v{i}") - F.col(f"_m{i}")
    sums = rows.join(centre, "family").groupBy("family").agg(
        *(F.sum(n * away(i) * away(j)).alias(f"_g{i}_{j}") for i, j in upper)
    )
    last = (size - 1, size - 1)
    entry = lambda ij: F.col(f"_g{ij[0]}_{ij[1]}") + (F.col("_ss") if ij == last else F.lit(0.0))
    return sums.join(centre, "family").select(
        "family",
        F.col("_n").alias("n"),
        F.array(*(F.col(f"_m{i}") for i in range(size))).alias("means"),
        F.array(*(entry(ij) for ij in upper)).alias("gram"),
    )


def gram_ols(
    df: DataFrame, response: str | Column, terms: Mapping[str, Column], family: str | Column = "family"
) -> DataFrame:
    """Coefficient table (long) of an intercept plus the stated terms, per family.

    A term that depends on terms before it is ``aliased``: its estimate is NULL, and the
    others are those of the model without it.
    """
    return solve_gram(gram_table(df, response, terms, family), list(terms))


def gram_ols_cells(cells: DataFrame, terms: Mapping[str, Column]) -> DataFrame:
    """``gram_ols`` on cell statistics: terms are expressions of treatment and x."""
    return solve_gram(gram_table_from_cells(cells, terms), list(terms))


def solve_gram(gram: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Coefficients, errors and tests from one Gram matrix per family."""
    names = ["(intercept)", *terms]
    fit = _swept(gram)
    rows = F.array(
        *(
            F.struct(
                F.lit(name).alias("term"),
                F.col("s.estimate").getItem(i).alias("estimate"),
                (F.col("sigma") * F.sqrt(F.col("s.unit_variance").getItem(i))).alias("se"),
                F.col("s.aliased").getItem(i).alias("aliased"),
            )
            for i, name in enumerate(names)
        )
    )
    keep = ["family", "n", "parameters", "df", "rss", "tss", "sigma"]
    long = fit.select(*keep, F.inline(rows)).withColumn(
        "t", F.try_divide(F.col("estimate"), F.col("se"))
    )
    return long.withColumn("p", t_two_sided("t", "df"))


def _swept(gram: DataFrame) -> DataFrame:
    """Gram table with the solution ``s`` and the model's error; aliased terms take no parameter."""
    found = gram.withColumn("s", _solve_centred("n", "means", "gram"))
    return (
        found.withColumn("parameters", F.col("s.parameters"))
        .withColumn("df", F.col("n") - F.col("parameters"))
        .withColumn("rss", F.col("s.rss"))
        .withColumn("tss", F.col("s.tss"))
        .withColumn("sigma", F.sqrt(F.when(F.col("df") > 0, F.try_divide(F.col("rss"), F.col("df")))))
    )


def sequential_anova(gram: DataFrame, terms: Sequence[str], groups: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """family, term_order, term -> df, ss, ms, f, p: sums of squares of the terms in their order, and the residual.

    They are what each term takes from the residual when it is swept in. ``groups`` names runs
    of terms that are tested as one (``{"poly": ["x", "x2"]}``), in order; each term stands for
    itself without it. An aliased term has no degree of freedom and no F.
    """
    groups = groups or {t: [t] for t in terms}
    if [t for group in groups.values() for t in group] != list(terms):
        raise ValueError("groups hold all terms in their order")
    at = {t: i for i, t in enumerate(terms)}
    rows = []
    for k, (name, group) in enumerate(groups.items(), 1):
        ss = sum((F.col("s.ss").getItem(at[t]) for t in group), F.lit(0.0))
        df = sum((F.when(F.col("s.aliased").getItem(at[t] + 1), 0).otherwise(1) for t in group), F.lit(0))
        rows.append(F.struct(F.lit(k).alias("term_order"), F.lit(name).alias("term"), df.cast("long").alias("df"), ss.alias("ss")))
    rows.append(F.struct(F.lit(len(groups) + 1).alias("term_order"), F.lit("residual").alias("term"), F.col("df"), F.col("rss").alias("ss")))
    error = [F.col("df").alias("_rdf"), (F.col("sigma") * F.col("sigma")).alias("_ems")]
    long = _swept(gram).select("family", *error, F.inline(F.array(*rows)))
    ms = F.when(F.col("df") > 0, F.try_divide(F.col("ss"), F.col("df")))
    long = long.withColumn("ms", ms).withColumn("f", F.when(F.col("term") != "residual", F.try_divide(F.col("ms"), F.col("_ems"))))
    return long.withColumn("p", f_upper("f", "df", "_rdf")).drop("_rdf", "_ems")


def fit_summary(coefficients: DataFrame) -> DataFrame:
    """One row per family from a ``gram_ols`` table: what the model tests need."""
    return coefficients.groupBy("family").agg(
        *(F.first(c).alias(c) for c in ("n", "parameters", "df", "rss", "tss", "sigma"))
    )
