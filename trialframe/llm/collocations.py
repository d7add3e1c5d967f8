"""Phrase collocations, counted by prefix-free parsing.

The words of a text are cut into chunks where a hash of ``longest - 1`` consecutive
words says so. Neighbouring chunks overlap by just these words, so every phrase of up to
``longest`` words lies whole in some chunk, and equal passages give equal chunks wherever
they stand. The distinct chunks with their frequencies are the dictionary; phrases are
counted inside it, each chunk weighted by its frequency. A phrase that starts within the
overlap at a chunk's end belongs to the next chunk, so it is counted once. A chunk keeps
the places where a piece (a stretch between punctuation marks or line ends) ends; no
phrase goes beyond one.

Phrases of one more word at a time: one of k words can only reach the least count if
both of its parts of k - 1 words do. The frequent ones of the level before reach the
tasks as a bit array of a fixed size, by hash. A hash that is shared lets a phrase be
counted that need not be; no phrase is lost, whatever the size of the corpus. Counts
are keyed by the phrases' text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trialframe.llm._arrays import SpanHash, ascii_lower, byte_table, chunks, gathered, kept_spans, mixed, numbered, spans, text_bytes
from trialframe.session import broadcast_if_small, materialize, written

LEAST = 100
LONGEST = 5
TOP = 2000
TOP_PARTS = 64  # of a group, ranked first by themselves
SPACING = 32  # words between triggers, in the mean
FILTER_BITS = 27  # of the bit array of frequent phrases: 16 MB
BATCH_BYTES = 4 << 20
SLICE_BYTES = 4 << 20
ROW_BYTES = 96  # of a counted phrase, when it is sent to every task
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_BREAK = byte_table(lambda b: b in _BREAKS)
_WORD = byte_table(lambda b: b not in _BREAKS and b not in b" \t")
_IN_CHUNK = byte_table(lambda b: b != 0x20 and b != 0x0A)
_FACTORS = np.random.default_rng(23).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def phrase_hashes(words: np.ndarray, groups: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that start at each word, with the group of the first."""
    n = max(len(words) - size + 1, 0)
    h = groups[:n] * _FACTORS[-1]
    for k in range(size):
        h = h + words[k : k + n] * _FACTORS[k]
    return mixed(h)


def parse(column: pa.Array, longest: int, spacing: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of all texts, their row, whether a text ends with them, and how many words they do not leave to the next.

    Behind each word of a chunk stands a space, or a newline where a piece ends.
    """
    data, at = text_bytes(column)
    data = ascii_lower(data)
    start, stop, row = spans(data, at, _WORD)
    n, over = len(start), longest - 1
    if not n:
        empty = np.empty(0, np.int64)
        return pa.array([], pa.large_string()), empty, empty.astype(bool), empty
    breaks = np.cumsum(_BREAK[data])[start]
    new_text = np.append(True, row[1:] != row[:-1])
    ends_piece = np.append(new_text[1:] | (breaks[1:] != breaks[:-1]), True)
    first = np.flatnonzero(new_text)
    end = np.append(first[1:], n)[np.cumsum(new_text) - 1]  # of the text, for each word
    window = phrase_hashes(SpanHash(data)(start, stop), np.zeros(n, np.uint64), over)
    cut = np.flatnonzero(window % np.uint64(spacing) == 0)
    begins = new_text.copy()
    begins[cut[cut + over < end[cut]]] = True
    lo = np.flatnonzero(begins)
    closed = np.append(new_text[lo[1:]], True)
    hi = np.where(closed, end[lo], np.append(lo[1:], 0) + over)
    size = stop - start + 1
    spaced = np.full(int(size.sum()), 0x20, np.uint8)  # every word with one byte behind
    word_at = np.concatenate([[0], np.cumsum(size)])
    inside = np.ones(len(spaced), bool)
    inside[word_at[1:] - 1] = False
    spaced[inside] = data[_WORD[data]]
    spaced[word_at[1:][ends_piece] - 1] = 0x0A
    return gathered(spaced, word_at[lo], word_at[hi]), row[lo], closed, hi - lo - np.where(closed, 0, over)


def chunk_dictionary(docs: DataFrame, longest: int, spacing: int) -> DataFrame:
    """(grp, chunk, closed, starts, n): the distinct chunks of ``docs`` (grp, text) and how often the parse has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in chunks(batch, limit=SLICE_BYTES):
                chunk, row, closed, starts = parse(column, longest, spacing)
                found = pa.table({"grp": part.column(0).take(pa.array(row)), "chunk": chunk.cast(pa.string()), "closed": closed, "starts": starts})
                counted = found.group_by(["grp", "chunk", "closed", "starts"]).aggregate([([], "count_all")])
                yield from counted.rename_columns(["grp", "chunk", "closed", "starts", "n"]).to_batches()

    parts = docs.mapInArrow(run, "grp string, chunk string, closed boolean, starts bigint, n bigint")
    return parts.groupBy("grp", "chunk", "closed", "starts").agg(F.sum("n").alias("n"))


def count_batch(table: pa.Table, size: int, over: int, bits: np.ndarray | None) -> pa.RecordBatch:
    """(grp, phrase, n): phrases of ``size`` words in dictionary rows, those that the level before does not rule out."""
    data, at = text_bytes(table["chunk"].combine_chunks().cast(pa.large_string()))
    start, stop, row = spans(data, at, _IN_CHUNK)
    n = len(start)
    group, groups = numbered(table["grp"].combine_chunks())
    at_word = np.searchsorted(row, np.arange(len(table) + 1))
    last = np.where(table["closed"].to_numpy(), at_word[1:], at_word[1:] - over)[row]
    piece = np.cumsum(np.append(0, data[stop[:-1]] == 0x0A)) if n else np.empty(0, np.int64)
    here = np.flatnonzero(np.arange(n) < last)
    here = here[here + size <= n]
    here = here[(piece[here + size - 1] == piece[here]) & (row[here + size - 1] == row[here])]
    if bits is not None:
        before = phrase_hashes(SpanHash(data)(start, stop), _group_hashes(groups)[group[row]], size - 1) >> np.uint64(64 - FILTER_BITS)
        seen = (bits[before >> np.uint64(3)] >> (before & np.uint64(7)).astype(np.uint8)) & 1
        here = here[(seen[here] & seen[here + 1]).astype(bool)]
    words = kept_spans(data, _IN_CHUNK, stop - start).take(pa.array(here)) if size == 1 else gathered(data, start[here], stop[here + size - 1])
    number, phrases = numbered(words)
    weight, group = table["n"].to_numpy()[row[here]], group[row[here]]
    key = group.astype(np.int64) * max(len(phrases), 1) + number
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(order) else np.empty(0, np.int64)
    total = np.add.reduceat(weight[order], first) if len(first) else np.empty(0, np.int64)
    one = order[first]
    phrase = phrases.take(pa.array(number[one])).cast(pa.string())
    return pa.RecordBatch.from_arrays([groups.take(pa.array(group[one])), phrase, pa.array(total)], names=["grp", "phrase", "n"])


def _group_hashes(groups: pa.Array) -> np.ndarray:
    data, at = text_bytes(groups.cast(pa.large_string()))
    return SpanHash(data)(at[:-1], at[1:])


def gathered_batches(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Batches put together up to about ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def count_phrases(dictionary: DataFrame, size: int, over: int, bits: np.ndarray | None = None) -> DataFrame:
    """(grp, phrase, n) of all phrases of ``size`` words whose parts of one word less are in ``bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered_batches(batches, BATCH_BYTES):
            yield count_batch(table, size, over, bits)

    parts = dictionary.select("grp", "chunk", "closed", "n").mapInArrow(run, "grp string, phrase string, n bigint")
    return parts.groupBy("grp", "phrase").agg(F.sum("n").alias("n"))


def frequent_bits(phrases: DataFrame, size: int) -> np.ndarray:
    """Bit array of 2^FILTER_BITS with the hashes of ``phrases`` (grp, phrase), all of ``size`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, groups = numbered(batch.column(0))
            column = batch.column(1).cast(pa.large_string())
            data, at = text_bytes(column)
            start, stop, row = spans(data, at, _IN_CHUNK)
            h = phrase_hashes(SpanHash(data)(start, stop), _group_hashes(groups)[group[row]], size)
            first = np.searchsorted(row, np.arange(len(batch)))
            yield pa.RecordBatch.from_arrays([pa.array((h[first] >> np.uint64(64 - FILTER_BITS)).astype(np.int64) + 1)], names=["place"])

    places = phrases.select("grp", "phrase").mapInArrow(run, "place bigint")
    parts = places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for bucket, found in parts.collect():  # at most FILTER_BITS' 16 MB, at any size of the corpus
        lo = (bucket - 1) * len(found)
        bits[lo : lo + len(found)] = np.frombuffer(bytes(found), np.uint8)
    return bits


def phrase_counts(docs: DataFrame, longest: int, least: int, spacing: int) -> tuple[DataFrame, DataFrame]:
    """(grp, phrase, words, n) of all phrases of 1 to ``longest`` words with ``least`` occurrences or more; (grp, n) of all words."""
    dictionary = written(chunk_dictionary(docs, longest, spacing))
    totals = dictionary.groupBy("grp").agg(F.sum(F.col("starts") * F.col("n")).alias("n"))
    levels, bits = [], None
    for size in range(1, longest + 1):
        found = materialize(count_phrases(dictionary, size, longest - 1, bits).where(F.col("n") >= least))
        levels.append(found.withColumn("words", F.lit(size)))
        if size < longest:
            bits = frequent_bits(found, size)
    return reduce(DataFrame.unionByName, levels), totals


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    group_col: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    top: int | None = TOP,
    contained: int = 100,
    spacing: int = SPACING,
) -> DataFrame:
    """(grp, rank, phrase, words, a, l, r, n, score): the strongest phrases of each group.

    A-Z are lower-cased; texts are split at ``. , ; : ! ?`` and line ends into pieces,
    and those at spaces and tabs into words. ``a`` is the count of a phrase of 2 to
    ``longest`` words with ``least`` occurrences or more, ``n`` that of all words of the
    group. Cut after its first k words, a phrase scores floor(1000 a n / (l r)), with l and
    r the counts of the parts; the cut of the least score counts, then the one of least k.
    A phrase inside a longer one with ``contained`` hundredths or more of its count is left
    out. Of the rest, the first ``top`` by score, count and text are returned, all if ``top`` is null.

    A null text is empty, a null group ``und``. A group without a phrase has no row; an empty
    table gives an empty one. Repeated rows count as often as they stand.
    """
    if not 2 <= longest <= 32:
        raise ValueError("phrases have 2 to 32 words")
    rows = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("grp"), F.col(text_col).alias("text"))
    counts, totals = phrase_counts(rows, longest, least, spacing)
    chosen = counts.where("words >= 2").withColumnRenamed("n", "a")
    word = F.split("phrase", " ")
    shorter = F.array(F.array_join(F.slice(word, 1, F.col("words") - 1), " "), F.array_join(F.slice(word, 2, F.col("words") - 1), " "))
    around = chosen.where("words >= 3").select("grp", F.explode(shorter).alias("phrase"), "a").groupBy("grp", "phrase").agg(F.max("a").alias("most"))
    kept = chosen.join(around, ["grp", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("most") < F.lit(contained) * F.col("a"), F.lit(True)))

    first = F.expr("substring_index(phrase, ' ', k)")
    cuts = (
        kept.select("grp", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        .withColumn("first", first)
        .withColumn("rest", F.substr("phrase", F.length("first") + F.lit(2)))
    )
    known = broadcast_if_small(counts, ROW_BYTES)

    def side(part: str, count: str) -> DataFrame:
        return known.select("grp", F.col("phrase").alias(part), F.col("n").alias(count))

    n = cuts.join(side("first", "l"), ["grp", "first"]).join(side("rest", "r"), ["grp", "rest"]).join(F.broadcast(totals), "grp")
    scored = n.withColumn("score", F.expr("(1000BD * cast(a as decimal(18, 0)) * cast(n as decimal(16, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"))
    best = scored.groupBy("grp", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("b"), *(F.first(c).alias(c) for c in ("words", "a", "n"))
    )
    out = best.select("grp", "phrase", "words", "a", "b.l", "b.r", "n", "b.score", "b.k")
    best_first = F.desc("score"), F.desc("a"), "phrase"
    if top is not None:  # the first of each part of a group, so that few rows of a large one meet
        part = F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS))
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("grp", part).orderBy(*best_first))).where(F.col("rank") <= top)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*best_first)))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("grp", F.col("rank").cast("bigint").alias("rank"), "phrase", "words", "a", "l", "r", "n", "score", "k")
