"""Compact letter display.

Where the levels that do not differ from a level are a stretch of the ordered means, and
stretches move on from level to level, one run over the order gives the groups. Else they are
split by insert and absorb (Piepho 2004); where that would make more groups than there are
pairs, the pairs that do not differ are covered by cliques instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from trialframe.session import materialize


FEW_LEVELS = 256  # of a by-group whose differing pairs reach Python as they are
SPLIT_GROUPS = 64  # groups of a split, or two for each level, beyond which cliques cover the pairs


def _letter_name(index: int) -> str:
    """a..z, then a1..z1, a2.. for displays that need more than 26 letters."""
    turn, place = divmod(index, 26)
    return ascii_lowercase[place] + (str(turn) if turn else "")


def assign_groups(size: int, differing: Sequence[tuple[int, int]]) -> list[list[int]]:
    """Group numbers of levels 0..size-1 (in display order) given the pairs that differ.

    Two levels share a group exactly when they do not differ. There are at most size² groups.
    """
    ends = [size - 1] * size
    counts = [0] * size
    for i, j in differing:
        ends[i] = min(ends[i], j - 1)
        counts[i] += 1
    if all(counts[i] == size - 1 - ends[i] for i in range(size)) and ends == sorted(ends):
        return groups_of_ends(ends)
    split = _split_groups(size, differing)
    return _numbers(_cover_groups(size, differing) if split is None else split, size)


def groups_of_ends(ends: Sequence[int]) -> list[list[int]]:
    """Group numbers where level i does not differ from the levels behind it up to ``ends[i]``, which never falls."""
    starts = [i for i, end in enumerate(ends) if i == 0 or end > ends[i - 1]]
    out: list[list[int]] = [[] for _ in ends]
    for number, i in enumerate(starts):
        for level in range(i, ends[i] + 1):
            out[level].append(number)
    return out


def _split_groups(size: int, differing: Sequence[tuple[int, int]]) -> np.ndarray | None:
    """Insert and absorb: a pair splits the groups that hold both levels; a part inside another group is absorbed.

    None where the groups become more than twice the levels, as their number can double with every pair.
    """
    groups = np.ones((1, size), dtype=bool)
    for i, j in sorted(differing):
        both = groups[:, i] & groups[:, j]
        if not both.any():
            continue
        kept, parts = groups[~both], np.repeat(groups[both], 2, axis=0)
        parts[::2, i] = False
        parts[1::2, j] = False
        every = np.concatenate([kept, parts])
        inside = parts.astype(np.float32) @ every.T.astype(np.float32) == parts.sum(axis=1)[:, None]
        larger = every.sum(axis=1)[None, :] > parts.sum(axis=1)[:, None]
        earlier = np.arange(len(every))[None, :] < (len(kept) + np.arange(len(parts)))[:, None]
        groups = np.concatenate([kept, parts[~(inside & (larger | earlier)).any(axis=1)]])
        if len(groups) > max(SPLIT_GROUPS, 2 * size):
            return None
    return groups


def _cover_groups(size: int, differing: Sequence[tuple[int, int]]) -> np.ndarray:
    """Cliques that hold every pair that does not differ: each takes the first pair left, and the levels that fit, in order."""
    like = [((1 << size) - 1) & ~(1 << i) for i in range(size)]  # bit sets
    for i, j in differing:
        like[i] &= ~(1 << j)
        like[j] &= ~(1 << i)
    left = [own >> (i + 1) << (i + 1) for i, own in enumerate(like)]  # pairs i < j that no clique holds yet
    cliques = []
    for i in range(size):
        while left[i]:
            j = (left[i] & -left[i]).bit_length() - 1
            clique, fits = 1 << i | 1 << j, like[i] & like[j]
            # first those with a pair that is still left, then any that fits
            for wanted in (lambda k: left[i] >> k & 1, lambda k: True):
                some = fits
                while some:
                    k = (some & -some).bit_length() - 1
                    some &= some - 1
                    if fits >> k & 1 and wanted(k):
                        clique |= 1 << k
                        fits &= like[k]
            members = [k for k in range(size) if clique >> k & 1]
            for k in members:
                left[k] &= ~clique
            cliques.append(members)
    alone = set(range(size)).difference(*cliques) if cliques else set(range(size))
    out = np.zeros((len(cliques) + len(alone), size), bool)
    for row, members in enumerate([*cliques, *([k] for k in sorted(alone))]):
        out[row, members] = True
    return out


def _numbers(groups: np.ndarray, size: int) -> list[list[int]]:
    ordered = sorted(groups.tolist(), key=lambda g: [n for n, own in enumerate(g) if own])
    return [[n for n, g in enumerate(ordered) if g[level]] for level in range(size)]


def assign_letters(size: int, differing: Sequence[tuple[int, int]]) -> list[str]:
    """Letters for the groups of ``assign_groups``."""
    return ["".join(map(_letter_name, own)) for own in assign_groups(size, differing)]


@F.pandas_udf(
    ArrayType(
        StructType()
        .add("position", IntegerType())
        .add("letters", StringType())
        .add("letter_groups", ArrayType(IntegerType()))
    )
)
def _display(sizes: pd.Series, ends: pd.Series, pairs: pd.Series) -> pd.Series:
    out = []
    for size, stretch, found in zip(sizes, ends, pairs):
        if stretch is not None:
            groups = groups_of_ends([int(e) for e in stretch])
        else:
            groups = assign_groups(int(size), [(p["i"], p["j"]) for p in found])
        out.append([{"position": i, "letters": "".join(map(_letter_name, own)), "letter_groups": own} for i, own in enumerate(groups)])
    return pd.Series(out)


def letter_groups(
    estimates: DataFrame,
    contrasts: DataFrame,
    by: Sequence[str] = ("family", "x"),
    level: str = "treatment",
    value: str = "emmean",
    alpha: float = 0.05,
) -> DataFrame:
    """Estimates with ``letters`` and ``letter_groups``; the largest mean gets the first letter.

    Two levels share a group number exactly when their p is at least alpha; the
    numbers stay apart where more than 26 letters run into each other. Per by-group
    only small integers reach Python, not the means: the pairs that differ, as places in
    the display order. Beyond ``FEW_LEVELS`` levels (the estimates are counted) it is for
    each level the last one that it does not differ from, where these stretches never fall back.
    """
    by = list(by)
    known = estimates.where(F.col(value).isNotNull())
    order = Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(level))
    placed = known.withColumn("position", (F.row_number().over(order) - 1).cast("int"))
    place = placed.select(*by, F.col(level).alias("_level"), F.col("position"))
    differ = contrasts.where(F.col("p") < alpha).select(*by, "level_a", "level_b")
    indexed = differ.join(
        place.select(*by, F.col("_level").alias("level_a"), F.col("position").alias("_pa")),
        [*by, "level_a"],
    ).join(
        place.select(*by, F.col("_level").alias("level_b"), F.col("position").alias("_pb")),
        [*by, "level_b"],
    )
    pairs = indexed.select(*by, F.least("_pa", "_pb").alias("i"), F.greatest("_pa", "_pb").alias("j"))
    sizes = placed.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("_size"))
    few = (known.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= FEW_LEVELS
    shape, other = (sizes.withColumn("_ends", F.lit(None).cast("array<int>")), pairs) if few else _stretches(placed, pairs, sizes, by)
    found = other.groupBy(*by).agg(F.collect_list(F.struct("i", "j")).alias("pairs"))
    none = F.array().cast("array<struct<i:int,j:int>>")
    shown = (
        shape.join(found, by, "left")
        .select(*by, "_size", "_ends", F.coalesce("pairs", none).alias("pairs"))
        .select(*by, F.inline(_display("_size", "_ends", "pairs")))
    )
    return placed.join(shown, [*by, "position"]).drop("position")


def _stretches(placed: DataFrame, pairs: DataFrame, sizes: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """For each by-group its size and, where they never fall back, the ends of its levels' stretches; and the pairs of all others."""
    pairs = materialize(pairs)  # read twice
    first = pairs.groupBy(*by, F.col("i").alias("position")).agg(F.min("j").alias("_j"), F.count(F.lit(1)).alias("_n"))
    last = F.coalesce(F.col("_j"), F.col("_size")) - 1
    whole = F.coalesce(F.col("_n"), F.lit(0)) == F.col("_size") - 1 - last
    forward = Window.partitionBy(*by).orderBy("position")
    reach = (
        placed.select(*by, "position")
        .join(sizes, by)
        .join(first, [*by, "position"], "left")
        .select(*by, "position", "_size", last.alias("_end"), whole.alias("_whole"))
        .withColumn("_whole", F.col("_whole") & (F.col("_end") >= F.coalesce(F.lag("_end").over(forward), F.lit(-1))))
    )
    ends = F.transform(F.array_sort(F.collect_list(F.struct("position", "_end"))), lambda s: s["_end"])
    shape = reach.groupBy(*by).agg(F.first("_size").alias("_size"), F.bool_and("_whole").alias("_sorted"), ends.alias("_all"))
    shape = shape.withColumn("_ends", F.when(F.col("_sorted"), F.col("_all"))).drop("_all")
    return shape, pairs.join(shape.where(~F.col("_sorted")).select(*by), by, "left_semi")


def signif_by_letters(
    lettered: DataFrame, by: Sequence[str] = ("family", "x"), out: str = "signif"
) -> DataFrame:
    """``*`` for groups where some level carries other letters than ``a``, else empty."""
    alike = F.bool_and(F.col("letters") == "a").over(Window.partitionBy(*by))
    return lettered.withColumn(out, F.when(alike, "").otherwise("*"))


def blank_letters(lettered: DataFrame, by: Sequence[str] = ("family", "x")) -> DataFrame:
    """Letters removed from groups where every level has the first letter only."""
    alike = F.bool_and(F.col("letters") == "a").over(Window.partitionBy(*by))
    return lettered.withColumn("letters", F.when(alike, "").otherwise(F.col("letters")))
