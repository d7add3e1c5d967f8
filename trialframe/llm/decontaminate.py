"""Benchmark decontamination: a prefix-filtered join of item windows with whole documents.

A window is ``size`` consecutive words of an item; a shorter item is one window.
A document word is hit if it lies inside any occurrence of any window.

The words of a window are ordered by rarity (their count over all documents). As
an occurrence needs every word of its window, the necessary prefix is one token,
the rarest: only places of that word are candidates. The word's offset in the
window gives the one start that is possible; a start before the document's first
word or an end after its last drops out; what is left is compared word by word
over the window's own length.

Words are compared by their bytes: a block of windows numbers its distinct words, and
a document's words are looked up in them.

The windows go to the tasks in blocks of at most ``BLOCK_BYTES``. A benchmark
within one block takes one pass; a larger one takes a pass for each block, with what
earlier ones have found written in between. Nothing of the documents is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from trialframe.llm._arrays import ascii_lower, byte_table, chunks, gathered, kept_spans, list_array, numbered, runs, spans, text_bytes
from trialframe.session import materialize

WINDOW = 13
BLOCK_BYTES = 32 << 20
WINDOW_BYTES = 128  # of a window beside its words: their numbers, and its place in the index
CHUNK = 4 << 20
_WORD = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Text and row of every word: runs of digits, letters and bytes beyond ASCII, A-Z lower-cased."""
    data, at = text_bytes(column)
    data = ascii_lower(data)
    starts, stops, rows = spans(data, at, _WORD)
    return kept_spans(data, _WORD, stops - starts), rows


def known_words(column: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Place in ``vocabulary`` (-1 where it has none) and row of every word; words are compared by their bytes."""
    words, rows = words_of(column)
    number, distinct = numbered(words)
    place = pc.fill_null(pc.index_in(distinct, value_set=vocabulary), -1).to_numpy()
    return place[number], rows


@dataclass
class WindowIndex:
    """Windows by their rarest word: words are places in ``vocabulary``, windows are in order of ``token``."""

    vocabulary: pa.Array
    first: np.ndarray  # of each word as a token: its first window, and one more at the end
    offset: np.ndarray  # place of the token in its window
    size: np.ndarray
    words: np.ndarray  # windows x longest window, -2 beyond a window's size
    item_at: np.ndarray  # first item of each window in ``items``
    items: list[str]

    def occurrences(self, places: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and windows of all occurrences; ``places`` are those of ``known_words``, in text order."""
        n_windows = np.diff(self.first)
        at = np.flatnonzero(places >= 0)
        at = at[n_windows[places[at]] > 0]
        n = n_windows[places[at]]
        window, place = runs(self.first[places[at]], n), np.repeat(at, n)
        start = place - self.offset[window]
        stop = start + self.size[window]
        fits = (start >= 0) & (stop <= len(places))
        start, stop, window, place = start[fits], stop[fits], window[fits], place[fits]
        fits = (rows[start] == rows[place]) & (rows[stop - 1] == rows[place])
        start, window = start[fits], window[fits]
        for k in range(self.words.shape[1]):
            size = self.size[window]
            here = np.minimum(start + k, len(places) - 1)
            same = (k >= size) | (places[here] == self.words[window, k])
            start, window = start[same], window[same]
        return start, window


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(item, words): every distinct window of every item, as words with a space between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in chunks(batch):
                words, rows = words_of(column)
                if not len(words):
                    continue
                spaced, word_at = text_bytes(pc.binary_join_element_wise(words, *(pa.scalar(x, pa.large_string()) for x in ("", " "))))
                at = np.searchsorted(rows, np.arange(len(part) + 1))
                n = np.diff(at)
                own = np.where(n > 0, np.maximum(n - size, 0) + 1, 0)  # windows of each row
                row = np.repeat(np.arange(len(part)), own)
                first = runs(at[:-1], own)
                last = first + np.minimum(n, size)[row]
                windows = gathered(spaced, word_at[first], word_at[last] - 1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), windows.cast(pa.string())], names=["item", "words"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return rows.where("item is not null").mapInArrow(run, "item string, words string").distinct()


def corpus_counts(docs: DataFrame, text_col: str, vocabulary: pa.Array) -> np.ndarray:
    """How often each word of ``vocabulary`` occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, column in chunks(batch, 0, CHUNK):
                places, _ = known_words(column, vocabulary)
                counts += np.bincount(places[places >= 0], minlength=len(vocabulary))
        places = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(counts[places])], names=["place", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    partial = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "place bigint, n bigint")
    for place, n in partial.groupBy("place").agg(F.sum("n")).collect():  # at most the vocabulary of one block
        out[place] = n
    return out


def build_index(windows: pa.Table, docs: DataFrame, text_col: str) -> WindowIndex:
    """Index of one block of (item, words) rows, ordered by rarity over all documents."""
    which, distinct = numbered(windows["words"].combine_chunks().cast(pa.large_string()))
    lists = pc.split_pattern(distinct, " ")
    size = np.diff(lists.offsets.to_numpy())
    number, vocabulary = numbered(lists.flatten())
    longest = int(size.max())
    inside = np.arange(longest)[None, :] < size[:, None]
    words = np.full(inside.shape, -2, np.int32)
    words[inside] = number
    counts = corpus_counts(docs, text_col, vocabulary)
    rarity = np.where(inside, counts[words], np.iinfo(np.int64).max)
    offset = rarity.argmin(axis=1)
    token = words[np.arange(len(words)), offset]
    order = np.argsort(token, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by_window = np.argsort(rank[which], kind="stable")
    item_at = np.searchsorted(rank[which][by_window], np.arange(len(order) + 1))
    items = windows["item"].take(pa.array(by_window)).to_pylist()
    first = np.searchsorted(token[order], np.arange(len(vocabulary) + 1))
    return WindowIndex(vocabulary, first, offset[order], size[order], words[order], item_at, items)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, n_words, starts, stops, items) for every document.

    ``starts`` and ``stops`` are the maximal runs of hit words (word places, end
    exclusive); ``items`` are the ids, as strings, of the items with a window in
    the document. A null or empty text has no words. Items without words or id,
    and repeated items, add nothing. Rows with equal ids each keep their row. An
    empty benchmark hits nothing.
    """
    windows = materialize(item_windows(benchmark, item_col, item_text_col, window))
    bytes_ = windows.agg(F.sum(F.octet_length("words") + F.octet_length("item") + WINDOW_BYTES)).first()[0] or 0
    n_blocks = -(-int(bytes_) // block_bytes)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<int>").alias("starts"),
        F.array().cast("array<int>").alias("stops"),
        F.array().cast("array<string>").alias("items"),
    )
    kinds = rows.schema
    for block in range(max(n_blocks, 1)):
        here = windows.where(F.pmod(F.xxhash64("item", "words"), F.lit(max(n_blocks, 1))) == block)
        found = here.toArrow()  # at most about block_bytes
        index = build_index(found, docs, text_col) if len(found) else None
        rows = rows.mapInArrow(lambda batches, index=index: _marked(batches, index), kinds)
        if n_blocks > 1:  # so that one index at a time is in the tasks
            rows = materialize(rows)
    return rows.drop("text")


def _marked(batches: Iterator[pa.RecordBatch], index: WindowIndex | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, column in chunks(batch, limit=CHUNK):
            places, rows = known_words(column, index.vocabulary if index is not None else pa.array([], pa.large_string()))
            n = len(part)
            at = np.searchsorted(rows, np.arange(n + 1))
            edges = np.zeros(len(places) + 1, np.int64)
            for name, sign in (("starts", 1), ("stops", -1)):  # what earlier blocks have found
                lists = part.column(part.schema.get_field_index(name))
                values = lists.flatten().to_numpy(zero_copy_only=False)
                np.add.at(edges, values + np.repeat(at[:n], np.diff(lists.offsets.to_numpy())), sign)
            items = part.column(part.schema.get_field_index("items")).to_pylist()
            if index is not None:
                start, window = index.occurrences(places, rows)
                np.add.at(edges, start, 1)
                np.add.at(edges, start + index.size[window], -1)
                for row, w in np.unique(np.stack([rows[start], window]), axis=1).T.tolist():
                    items[row] = [*items[row], *index.items[index.item_at[w] : index.item_at[w + 1]]]
            hit = np.cumsum(edges)[:-1] > 0
            before = np.concatenate([[False], hit[:-1]])
            before[at[:n][at[:n] < len(hit)]] = False  # a run ends with its document
            after = np.concatenate([hit[1:], [False]])
            last = at[1:] - 1
            after[last[last >= 0]] = False
            first, end = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
            of = rows[first]
            counts = np.bincount(of, minlength=n)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(np.diff(at)),
                    list_array(counts, pa.array((first - at[of]).astype(np.int32))),
                    list_array(counts, pa.array((end - at[of]).astype(np.int32))),
                    pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
                ],
                names=["id", "text", "n_words", "starts", "stops", "items"],
            )


def judged(found: DataFrame) -> DataFrame:
    """``contamination`` with n_hit, n_items and contaminated (hit words make up a twentieth or more)."""
    n_hit = F.aggregate(F.zip_with("starts", "stops", lambda a, b: (b - a).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("bigint"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )
