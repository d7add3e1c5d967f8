"""What the trained operators share: the rows to learn from, and bounded samples of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trialframe.session import broadcast_if_small, materialize


def held_out(doc_id: str | Column) -> Column:
    """True where crc32 of the id as text leaves no rest by 5; also without an id. Such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(True))


def bounded_sample(rows: DataFrame, key: str, group: str, most: int) -> DataFrame:
    """At most ``most`` rows of every non-null value of ``group``: those with the least hash of ``key``.

    A bound on the hash, from the value's count and with a margin, comes first, so
    that only some two times ``most`` rows of a value meet to be ranked. The counts go
    to every task if their size allows, so that no row moves before that bound.
    """
    counts = materialize(rows.groupBy(group).agg(F.count("*").alias("n")))  # one row for each value
    counts = broadcast_if_small(counts, 128)
    share = F.least(F.lit(1.0), (2.0 * most + 200) / F.col("n"))
    near = (
        rows.join(counts, group)
        .withColumn("place", F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(key)), 1))
        .where(F.col("place") <= share * float((1 << 63) - 1))
    )
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("place", key)))
    return ranked.where(F.col("rank") <= most).drop("n", "place", "rank")


def list_rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as arrays."""
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        values, at = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(at[:-1], at[1:])]
    return out
