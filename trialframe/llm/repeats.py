"""Suffix-array deduplication of exact passages, keeping the first copy.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier:
in a smaller id, or in the same document at a smaller place.

Equal strings choose equal anchors: of the ``GRAM``-byte pieces in a string the
one of least hash, the leftmost on a tie. So each string is filed under its
anchor's hash, and only strings filed together are ever compared. The strings of
one anchor are consecutive and overlap; they travel as one segment.

* Where a whole segment repeats, its later copies go at once; this folding is
  done in the tasks that read the documents, before any shuffle, and again by
  anchor. A crowd of copies is one row for each chunk of text from then on.
* Where segments of one anchor differ, they share some of their strings at most.
  They are cut further, by the place of the anchor and by the bytes that all
  strings of a cut have in common, dealt by that key, and a suffix array over the
  segments that meet (ranks of 8, 16, 32, 64 and 100 bytes by doubling) gives for
  each string the longest previous factor: the larger of its common prefixes with
  the nearest suffixes before and after it, in suffix order, that start earlier.
  A string whose factor reaches the length is an earlier one's copy.
* A task holds the cuts of one key up to a bound. Beyond it (a line in a large part of all
  documents, between texts that differ) it passes the strings of that key on as they
  come, by the 128-bit hash of each, and the first of each hash stays.

Rows that share an id count as one document, as the order is by id and place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from trialframe.llm._arrays import SpanHash, chunks, list_array, mixed, text_bytes
from trialframe.session import materialize

LENGTH = 100
GRAM = 32
CUT = 16  # places of an anchor that travel together
BATCH_BYTES = 4 << 20
KEY_BYTES = 16 << 20  # of cuts with one key that a task holds; the strings of a larger key are dealt on
_LOW = np.uint64(0xFFFFFFFF)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    grid = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: hash of the anchor, hash of the segment, row, first and last string, anchor.

    Places are in the chunk.
    """
    if len(data) < length:
        empty = np.empty(0, np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty, empty
    hashed = SpanHash(data)
    grams = hashed.fixed(gram)
    anchor = (_sliding_min((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & _LOW).astype(np.int64)
    last = at[1:] - length  # last string of each row
    change = np.ones(len(anchor) + 1, np.int8)
    change[1:-1] = anchor[1:] != anchor[:-1]
    change[at[:-1][at[:-1] < len(anchor)]] = 1
    beyond = np.clip(last + 1, 0, len(anchor))
    change[beyond] = 1
    lo = np.flatnonzero(change[:-1])
    hi = np.append(lo[1:], len(anchor)) - 1
    row = np.searchsorted(at, lo, "right") - 1
    inside = hi <= last[row]
    lo, hi, row = lo[inside], hi[inside], row[inside]
    return grams[anchor[lo]], hashed(lo, hi + length), row, lo, hi, anchor[lo]


def first_of_each(keys: tuple[np.ndarray, ...], ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Flags of the rows that come first, by id and place, among the rows with their keys."""
    order = np.lexsort((place, ids, *keys))
    first = np.zeros(len(ids), bool)
    start = np.ones(len(ids), bool)
    tied = np.ones(len(ids), bool)
    if len(ids):
        start[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        tied = (ids[order] == ids[order][np.maximum.accumulate(np.where(start, np.arange(len(ids)), 0))]) & (
            place[order] == place[order][np.maximum.accumulate(np.where(start, np.arange(len(ids)), 0))]
        )
    first[order] = tied
    return first


def _spread(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys that deal rows evenly."""
    return mixed(ids.view(np.uint64) ^ mixed(place.astype(np.uint64) + np.uint64(1))).view(np.int64)


def _anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, segment, id, tag, lo, size, off, copy): segments of each chunk, later copies within the chunk marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in chunks(batch):
                data, at = text_bytes(column)
                key, whole, row, lo, hi, anchor = segments(data, at, length, gram)
                ids, tags = (part.column(k).to_numpy()[row] for k in (0, 2))
                place = lo - at[row]
                first = first_of_each((whole, key), ids, place)
                later = np.flatnonzero(~first)
                joins = np.zeros(len(later), bool)  # runs of copies that follow on each other are one row
                joins[1:] = (later[1:] == later[:-1] + 1) & (row[later[1:]] == row[later[:-1]]) & (lo[later[1:]] == hi[later[:-1]] + 1)
                begin = np.flatnonzero(~joins)
                end = np.append(begin[1:], len(later)) - 1
                a, b = later[begin], later[end] if len(later) else later
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([key[first].view(np.int64), _spread(ids[a], place[a])])),
                        pa.array(np.concatenate([whole[first].view(np.int64), np.zeros(len(a), np.int64)])),
                        pa.array(np.concatenate([ids[first], ids[a]])),
                        pa.array(np.concatenate([tags[first], tags[a]])),
                        pa.array(np.concatenate([place[first], place[a]])),
                        pa.array(np.concatenate([(hi - lo)[first], hi[b] - lo[a]]).astype(np.int32)),
                        pa.array(np.concatenate([(anchor - lo)[first], np.zeros(len(a), np.int64)]).astype(np.int32)),
                        pa.array(np.concatenate([np.zeros(int(first.sum()), bool), np.ones(len(a), bool)])),
                    ],
                    names=["anchor", "segment", "id", "tag", "lo", "size", "off", "copy"],
                )

    return docs.mapInArrow(run, "anchor bigint, segment bigint, id bigint, tag bigint, lo bigint, size int, off int, copy boolean")


def _cut(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, id, tag, lo, n, bytes): the strings of differing segments, cut by place of the anchor and common bytes.

    ``rows`` has (id, text, tag, open) with open: (lo, size, off) of its segments. A
    later copy of a whole cut, within a chunk, has null bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in chunks(batch):
                data, at = text_bytes(column)
                lists = part.column(3)
                row = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
                lo, size, off = (lists.flatten().field(k).to_numpy() for k in range(3))
                lo = lo + at[row]
                hi, anchor = lo + size, lo + off
                hashed = SpanHash(data)
                pieces = []
                for q in range(-(-(length - gram + 1) // CUT)):
                    a, b = np.maximum(lo, anchor - CUT * q - CUT + 1), np.minimum(hi, anchor - CUT * q)
                    own = a <= b
                    a, b, common = a[own], b[own], anchor[own] - CUT * q
                    key = mixed(hashed(anchor[own], anchor[own] + gram) ^ mixed(hashed(common, common + length - CUT + 1) + np.uint64(q)))
                    pieces.append((key, a, b, row[own]))
                key, a, b, row = (np.concatenate(x) for x in zip(*pieces))
                ids, tags = (part.column(k).to_numpy()[row] for k in (0, 2))
                place = a - at[row]
                first = first_of_each((hashed(a, b + length), key), ids, place)
                key = np.where(first, key.view(np.int64), _spread(ids, place))
                whole = data.tobytes()
                texts = [whole[x:y] if f else None for x, y, f in zip(a.tolist(), (b + length).tolist(), first.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(ids), pa.array(tags), pa.array(place), pa.array((b - a + 1).astype(np.int32)), pa.array(texts, pa.binary())],
                    names=["key", "id", "tag", "lo", "n", "bytes"],
                )

    return rows.mapInArrow(run, "key bigint, id bigint, tag bigint, lo bigint, n int, bytes binary")


def ranks(text: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(size, rank of each suffix by its first ``size`` bytes) for sizes 8, 16, ... and ``length``; zeros beyond the end."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    head = np.zeros(n, np.uint64)
    for k in range(8):
        head = (head << np.uint64(8)) | wide[k : k + n]
    rank = np.unique(head, return_inverse=True)[1].astype(np.uint64)
    out, size = [(8, rank)], 8
    while size < length:
        step = min(size, length - size)
        ahead = np.zeros(n, np.uint64)
        if step < n:
            ahead[: n - step] = rank[step:] + np.uint64(1)
        rank = np.unique(rank << np.uint64(32) | ahead, return_inverse=True)[1].astype(np.uint64)
        size += step
        out.append((size, rank))
    return out


def common_prefixes(order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """For each suffix in order, the largest rank size at which it equals the one before it (0 for none)."""
    out = np.zeros(len(order), np.int64)
    for size, rank in levels:
        r = rank[order]
        out[1:][r[1:] == r[:-1]] = size
    return out


def previous_factors(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix in suffix order.

    ``place`` is the order of starts, ``common`` the common prefix with the
    suffix before. The previous and the next smaller place are found for all
    suffixes together: a pointer to a larger place jumps on to where that one
    points, keeping the least common prefix on its way.
    """
    best = np.zeros(len(place), np.int64)
    for turned in (False, True):
        own = place[::-1] if turned else place
        shared = np.concatenate([[0], common[1:][::-1]]) if turned else common.copy()
        to = np.arange(len(own)) - 1
        live = np.flatnonzero(to >= 0)
        while len(live := live[(shared[live] > 0) & (to[live] >= 0)]):
            live = live[own[to[live]] >= own[live]]
            ahead = to[live]
            shared[live], to[live] = np.minimum(shared[live], shared[ahead]), to[ahead]
        shared[to < 0] = 0
        best = np.maximum(best, shared[::-1] if turned else shared)
    return best


def _copies(cuts: DataFrame, length: int, key_bytes: int) -> DataFrame:
    """(id, tag, start, stop): bytes of strings that start earlier elsewhere.

    A task holds up to about ``key_bytes`` of cuts, whatever the size of a key.
    """
    limit = min(BATCH_BYTES, key_bytes)
    names = ["id", "tag", "start", "stop", "head", "tail"]
    dealt = cuts.repartition("key").sortWithinPartitions("key")

    def judged(table: pa.Table) -> pa.RecordBatch:
        key = table["key"].to_numpy()
        known = table["bytes"].is_null().to_numpy()  # copies found before
        met = np.zeros(len(key), bool)
        met[1:] = key[1:] == key[:-1]
        met[:-1] |= met[1:].copy()
        ids, tags, lo, n = (table[c].to_numpy() for c in ("id", "tag", "lo", "n"))
        starts, stops, of = [lo[known]], [lo[known] + n[known] - 1 + length], [np.flatnonzero(known)]
        rows = np.flatnonzero(met & ~known)
        if len(rows):
            texts = table["bytes"].take(pa.array(rows)).combine_chunks().cast(pa.large_binary())
            data, at = text_bytes(texts)
            count = n[rows]
            row = np.repeat(np.arange(len(rows)), count)
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            suffix = at[row] + step
            levels = [(size, rank[suffix]) for size, rank in ranks(data, length)]
            place = np.lexsort((lo[rows][row] + step, ids[rows][row]))
            rank_of = np.empty(len(place), np.int64)
            rank_of[place] = np.arange(len(place))
            same = np.zeros(len(place), bool)  # rows that share id and place are one start
            a, b = place[1:], place[:-1]
            same[1:] = (ids[rows][row[a]] == ids[rows][row[b]]) & ((lo[rows][row] + step)[a] == (lo[rows][row] + step)[b])
            rank_of[place] = np.cumsum(~same)
            order = np.lexsort((rank_of, levels[-1][1]))
            factor = previous_factors(rank_of[order], common_prefixes(order, levels))
            gone = np.zeros(len(order), bool)
            gone[order] = factor >= length
            flips = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            edge = np.zeros(len(gone) + 1, bool)
            edge[np.cumsum(count)] = True  # a run ends with its row
            first = np.flatnonzero(gone & ((flips[:-1] == 1) | edge[:-1]))
            last = np.flatnonzero(gone & ((flips[1:] == -1) | edge[1:]))
            starts.append(lo[rows][row[first]] + step[first])
            stops.append(lo[rows][row[last]] + step[last] + length)
            of.append(rows[row[first]])
        own = np.concatenate(of)
        own, start = np.concatenate(of), np.concatenate(starts)
        spread = pa.array(_spread(ids[own], start))
        arrays = [ids[own], tags[own], start, np.concatenate(stops)]
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in arrays), spread, pa.nulls(len(own), pa.int64())], names=names)

    def dealt_on(table: pa.Table) -> pa.RecordBatch:
        """Every string of the cuts, with the hashes of its two halves."""
        data, at = text_bytes(table["bytes"].combine_chunks().cast(pa.large_binary()))
        ids, tags, lo, n = (table[c].to_numpy() for c in ("id", "tag", "lo", "n"))
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        hashed, begin, start = SpanHash(data), at[row] + step, lo[row] + step
        middle = begin + length // 2
        head, tail = hashed(begin, middle).view(np.int64), hashed(middle, begin + length).view(np.int64)
        arrays = [ids[row], tags[row], start, start + length, head, tail]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        large = None  # a key beyond the bound
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) < limit:
                continue
            table = pa.Table.from_batches(held)
            key = table["key"].to_numpy()
            if large is not None:
                more = int(np.searchsorted(key, large, "right"))
                yield from passed_on(table.slice(0, more))
                table, key = table.slice(more), key[more:]
                held = []
                if not len(key):
                    continue
                large = None
            whole = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if whole:
                yield judged(table.slice(0, whole))
            table = table.slice(whole)
            held = table.to_batches()
            if table.nbytes >= key_bytes:
                large = key[-1]
                yield from passed_on(table)
                held = []
        if held:
            table = pa.Table.from_batches(held)
            more = 0 if large is None else int(np.searchsorted(table["key"].to_numpy(), large, "right"))
            yield from passed_on(table.slice(0, more))
            if more < len(table):
                yield judged(table.slice(more))

    def passed_on(table: pa.Table, rows: int = 1 << 13) -> Iterator[pa.RecordBatch]:
        for begin in range(0, len(table), rows):
            part = table.slice(begin, rows)
            known = part["bytes"].is_null()
            yield judged(part.filter(known))
            yield dealt_on(part.filter(pc.invert(known)))

    found = dealt.mapInArrow(run, "id bigint, tag bigint, start bigint, stop bigint, head bigint, tail bigint")
    # Copies have an even key of their own and no tail; of the strings dealt on, the first of each hash is none.
    so_far = Window.partitionBy("head", "tail").orderBy("id", "start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.struct("id", "start")
    first = found.withColumn("first", F.first(own).over(so_far))
    return first.where(F.col("tail").isNull() | (own != F.col("first"))).select("id", "tag", "start", "stop")


def _without(rows: DataFrame) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) from (id, text, found): lists of (start, stop) in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in chunks(batch):
                data, at = text_bytes(column)
                lists = part.column(2)
                row = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
                start, stop = (lists.flatten().field(k).to_numpy() + at[row] for k in range(2))
                edges = np.zeros(len(data) + 1, np.int32)
                np.add.at(edges, start, 1)
                np.add.at(edges, stop, -1)
                gone = np.cumsum(edges)[:-1] > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                heads = at[:-1][at[:-1] < len(gone)]
                begins[heads] = gone[heads]
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins)]
                removed, runs = (s[at[1:]] - s[at[:-1]] for s in sums)
                kept = data[~gone]
                ends = at - sums[0][at]
                array = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(kept.copy())])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(at)), pa.array(removed), pa.array(runs), array.cast(pa.binary())],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return rows.mapInArrow(run, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def _numbered_ids(rows: DataFrame) -> DataFrame:
    """(own, number): the distinct ids of ``rows``, numbered in their order.

    Ids are laid out by range; each range counts its own, and the counts of the ranges before
    (one row for each range) are added.
    """
    distinct = rows.where("own is not null").select("own").distinct()
    placed = materialize(distinct.repartitionByRange("own").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    sizes = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("own"))
    return materialize(placed.withColumn("number", number).join(F.broadcast(sizes), "part").select("own", (F.col("before") + F.col("number")).alias("number")))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for every document; ``kept`` are the remaining bytes (UTF-8).

    Strings are judged on the input, not on what is left; matches never cross
    documents. Null texts count as empty. Ids are whole numbers, or of any other type
    with an order, which are numbered in it first. A null id comes before all others
    (as the least whole number, which therefore shares its row with none).
    Rows that share an id are each kept and are earlier than each other by place
    only. An empty table gives an empty one.
    """
    if not CUT <= gram < length - CUT:
        raise ValueError("the anchor must be shorter than the string by more than a cut")
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        own = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text"))
        numbers = _numbered_ids(own)
        found = without_repeats(own.join(numbers, "own", "left"), "number", "text", length, gram, key_bytes)
        back = found.join(numbers.withColumnRenamed("number", "id"), "id", "left")
        return back.select(F.col("own").alias("id"), "n_bytes", "n_removed", "n_spans", "kept")
    least = F.lit(-(1 << 63))
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), least).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Rows that share an id are told apart by their text; without such rows the tag is a constant.
    repeated = rows.groupBy("id").count().where("count > 1").limit(1).count()
    rows = rows.withColumn("tag", F.xxhash64("text") if repeated else F.lit(0).cast("bigint"))
    found = _anchored(rows, length, gram)
    by_segment, by_anchor = Window.partitionBy("anchor", "segment"), Window.partitionBy("anchor")
    found = (
        found.repartition("anchor")
        .withColumn("first", F.min(F.struct("id", "lo")).over(by_segment))
        .withColumn("n", F.count("*").over(by_anchor))
        .withColumn("differ", F.min("segment").over(by_anchor) != F.max("segment").over(by_anchor))
        .where("copy or n > 1")
        .withColumn("gone", F.col("copy") | (F.struct("id", "lo") != F.col("first")))
        .where("gone or differ")
    )
    marks = materialize(
        found.groupBy("id", "tag").agg(
            F.collect_list(
                F.when(F.col("gone"), F.struct(F.col("lo").alias("start"), (F.col("lo") + F.col("size") + length).alias("stop")))
            ).alias("copies"),
            F.collect_list(F.when(~F.col("gone"), F.struct("lo", "size", "off"))).alias("open"),
        )
    )
    open_ = rows.join(marks.where(F.size("open") > 0).select("id", "tag", "open"), ["id", "tag"])
    more = _copies(_cut(open_.select("id", "text", "tag", "open"), length, gram), length, key_bytes)
    more = more.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("more"))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    every = rows.join(marks.select("id", "tag", "copies"), ["id", "tag"], "left").join(more, ["id", "tag"], "left")
    out = _without(every.select("id", "text", F.concat(F.coalesce("copies", none), F.coalesce("more", none)).alias("found")))
    return out.withColumn("id", F.nullif("id", least))
