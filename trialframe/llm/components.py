"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trialframe.session import materialize


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, root) for each node of ``links``; root is the smallest node it reaches.

    Every round rewrites the links: a node's larger neighbours are linked to the
    smallest neighbour (large star), then its smaller ones (small star). No
    neighbourhood is gathered in one place: minima are partial aggregates, and the
    joins back carry rows of two numbers. Rounds grow with the logarithm of the
    longest path. The driver sees a count and a checksum of each round; links
    stay in the shared checkpoint folder.

    Links with a null end are left out; loops add nothing. An empty table gives
    an empty table.
    """
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = materialize(_oriented(links))
    before = None
    while (now := _state(edges)) != before:
        before = now
        edges = materialize(_small_star(_large_star(edges)))
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())


def _oriented(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", "m")).distinct()
