"""URL filters: fixed host and path rules, and association rules mined from labels.

Fixed rules come first: a rule ``host/path`` fits its host and every subdomain
where the path starts with the rule's; the longest that fits decides. Hosts are
matched by their suffixes as an equi-join on the rule's host.

All other URLs are judged by rules that Spark's FP-growth mines from labelled
URLs: combinations of URL tokens that lead to the bad label with enough support,
confidence and lift. A rule is dropped when a rule with a part of its tokens is
as confident. Matching goes by inverted index: each rule is filed under its
rarest token, URLs meet only the rules of tokens they have, and the rule's other
tokens are then checked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from trialframe.session import materialize

# The rules that always hold.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MIN_SUPPORT = 0.001
MIN_COUNT = 5
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a URL without ``://``."""
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels, path parts, file ending, query keys and fragment; digits fold into ``#``."""
    def tagged(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), F.regexp_replace(x, r"[0-9]+", "#")))

    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    scheme = F.array(F.when(F.contains(url, F.lit("://")), F.lower(F.substring_index(url, "://", 1))).otherwise(""))
    ending = F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    fragment = F.array(F.when(F.contains(url, F.lit("#")), F.lit("any")).otherwise(""))
    every = F.concat(
        tagged("scheme", scheme), tagged("host", F.split(host, r"\.")), tagged("path", F.split(path, "[/.]")),
        tagged("ending", ending), tagged("query", keys), tagged("fragment", fragment),
    )
    return F.array_distinct(F.coalesce(every, F.array().cast("array<string>")))


def fixed_rule(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(url, rule, fixed): the longest rule that fits each distinct (url, host, path), where one does."""
    spark = urls.sparkSession
    table = spark.createDataFrame(
        [(r, v, r[: r.index("/")].lower(), r[r.index("/") :]) for r, v in rules], "rule string, fixed string, rule_host string, rule_path string"
    )
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    met = urls.select("url", "path", F.explode(suffix).alias("rule_host")).join(table, "rule_host")
    best = met.where(F.startswith("path", "rule_path")).groupBy("url").agg(
        F.max(F.struct(F.length("rule"), "rule", "fixed")).alias("best")
    )
    return best.select("url", "best.rule", "best.fixed")


def mine_rules(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_count: int = MIN_COUNT,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
    partitions: int | None = None,
) -> DataFrame:
    """(parts, confidence): token sets that lead to the bad label. ``labelled`` has (tokens, bad).

    Support is the share of labelled rows that have the tokens and the bad label;
    it must also be ``min_count`` rows. Without labelled or bad rows there are no rules.
    """
    labelled = materialize(labelled)
    n, bad = labelled.agg(F.count("*"), F.sum(F.col("bad").cast("int"))).first()
    nothing = labelled.sparkSession.createDataFrame([], "parts array<string>, confidence double")
    if not n or not bad:
        return nothing
    support = min(1.0, max(min_support, min_count / n))
    # Only token sets of bad rows can lead to the label; their counts over all rows give the confidence.
    baskets = labelled.where("bad").select(F.col("tokens").alias("items")).where(F.size("items") > 0)
    miner = FPGrowth(itemsCol="items", minSupport=min(1.0, support * n / bad), minConfidence=1.0)
    if partitions:
        miner.setNumPartitions(partitions)
    sets = materialize(miner.fit(baskets).freqItemsets.select(F.array_sort("items").alias("parts"), F.col("freq").alias("hits")))
    counted = matches(sets, labelled.where(F.size("tokens") > 0).groupBy("tokens").agg(F.count("*").alias("n")))
    totals = counted.groupBy("parts").agg(F.sum("n").alias("seen"), F.max("hits").alias("hits"))
    strong = materialize(
        totals.withColumn("confidence", F.col("hits") / F.col("seen")).where(
            (F.col("confidence") >= min_confidence) & (F.col("confidence") >= min_lift * bad / n)
        )
    )
    smaller = strong.select(F.col("parts").alias("fewer"), F.col("confidence").alias("as_sure"))
    # A rule meets its one-smaller parts by equality of token sets.
    subset = strong.select("parts", "confidence", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.concat(F.slice("parts", F.lit(1), k - 1), F.slice("parts", k + 1, F.size("parts"))))).alias("fewer"))
    spare = subset.join(smaller, "fewer").where("as_sure >= confidence").select("parts").distinct()
    return strong.join(spare, "parts", "left_anti").select("parts", "confidence")


def matches(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Rows of ``urls`` (with ``tokens``) beside every rule (with ``parts``) whose tokens they all have, by inverted index."""
    token_counts = rules.select(F.explode("parts").alias("token")).distinct().join(
        urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n_token")), "token", "left"
    )
    filed = (
        rules.select("parts", F.explode("parts").alias("token"))
        .join(token_counts, "token")
        .groupBy("parts")
        .agg(F.min_by("token", F.struct(F.coalesce("n_token", F.lit(0)), "token")).alias("token"))
        .join(rules, "parts")
    )
    return (
        urls.withColumn("token", F.explode("tokens")).join(filed, "token").where(F.size(F.array_except("parts", "tokens")) == 0).drop("token")
    )


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id_col: str = "doc_id",
    quality_col: str = "quality",
    toxic_col: str = "toxic",
    rules: Sequence[tuple[str, str]] = RULES,
    **mining,
) -> DataFrame:
    """(id, host, path, rule, verdict, confidence) for every page.

    A label marks the page of the same id as bad if its quality is 0 or it is toxic
    (one such label of several is enough; a label without both values says nothing). ``verdict`` is the fixed rule's; else ``block`` if a
    mined rule matches, with that rule's ``confidence``, else ``allow``. A null
    URL, or one without ``://``, has empty host and path; no fixed rule fits it.
    Every row is kept, repeated or without id. An empty table gives an empty one.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    distinct = rows.select("url").where("url is not null").distinct()
    host, path = host_and_path(F.col("url"))
    distinct = distinct.select("url", host.alias("host"), path.alias("path"))
    distinct = materialize(distinct.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path"))))
    bad = F.coalesce(F.col(quality_col) <= 0, F.lit(False)) | F.coalesce(F.col(toxic_col) > 0, F.lit(False))
    said = labels.where(F.col(quality_col).isNotNull() | F.col(toxic_col).isNotNull())
    marks = said.groupBy(F.col(label_id_col).alias("id")).agg(F.max(bad).alias("bad"))
    labelled = rows.join(marks, "id").join(distinct, "url").select("tokens", "bad")
    mined = materialize(mine_rules(labelled, **mining))
    blocked = matches(mined, distinct.select("url", "tokens")).groupBy("url").agg(F.max("confidence").alias("confidence"))
    judged = distinct.select("url", "host", "path").join(fixed_rule(distinct, rules), "url", "left").join(blocked, "url", "left")
    verdict = F.coalesce("fixed", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return rows.join(judged, "url", "left").select(
        "id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", verdict.alias("verdict"), "confidence"
    )
