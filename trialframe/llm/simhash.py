"""SimHash near-duplicates: fingerprints, and links by tiled exact comparison.

Fingerprints are made in Arrow batches (XXH64 of each word shingle, bits by
majority). Equal fingerprints fold into one row first, so a group of copies of
any size is one row from then on. The distinct fingerprints are dealt into tiles
and compared exactly with exclusive-or and bit counts; a pair of tiles whose
population counts differ by more than the radius is skipped.

Which tiles meet: for a small radius on 64 bits, fingerprints that agree on two
of four 16-bit blocks (at radius 2 or less every linked pair agrees on at least
two), so tiles are short and the work follows the number of fingerprints.
For a larger radius all pairs of tiles whose population counts are within it, as
blocks of a fixed size; that is quadratic in the number of distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from trialframe.llm._arrays import as_text
from trialframe.llm.components import connected
from trialframe.session import broadcast_if_small, materialize

TILE = 128
BLOCK_ROWS = 32768
UID_BYTES = 64  # of a document's key, when it is sent to every task
_LANES = np.arange(256, dtype=np.uint8)[:, None] >> np.arange(8, dtype=np.uint8)[None, :] & 1


def shingle_hashes(text: bytes, k: int, seed: int) -> np.ndarray:
    """XXH64 of the ``k``-word shingles of a text, A-Z lower-cased, joined by single spaces."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    stops = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], stops[:-1]])
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), (stops[k - 1 :] - 1).tolist())],
        np.uint64,
    )


def majority(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Bits set in over half of each row's hashes; zero for a row without any."""
    total = np.bincount(rows, minlength=n)
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    out = np.zeros((n, 8), np.uint8)
    for start in range(0, n, 256):
        stop = min(start + 256, n)
        lo, hi = np.searchsorted(rows, [start, stop])
        here = (rows[lo:hi] - start) * 256
        for lane in range(8):
            counts = np.bincount(here + lanes[lo:hi, lane], minlength=256 * (stop - start)).reshape(-1, 256)
            bits = 2 * (counts @ _LANES.astype(np.int64)) > total[start:stop, None]
            out[start:stop, lane] = np.packbits(bits, axis=1, bitorder="little")[:, 0]
    return out.view(np.uint64)[:, 0]


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seeds: tuple[int, ...] = (42,)
) -> DataFrame:
    """(id, n, fp0, fp1, ...): number of shingles, and a 64-bit fingerprint for every seed, as signed long.

    A text of fewer words is one shingle; a null text, or one without words, has fingerprint zero.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_text(batch.column(1)).cast(pa.large_binary())
            for start in range(0, len(texts), 512):
                part = texts.slice(start, 512)
                columns = [batch.column(0).slice(start, 512)]
                for seed in seeds:
                    found = [shingle_hashes(t.as_py(), words, seed) for t in part]
                    rows = np.repeat(np.arange(len(found)), [len(h) for h in found])
                    fp = majority(np.concatenate(found) if found else np.empty(0, np.uint64), rows, len(found))
                    columns.append(pa.array(fp.view(np.int64)))
                columns.insert(1, pa.array([len(h) for h in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", *(f"fp{k}" for k in range(len(seeds)))])

    schema = f"id {id_type}, n bigint, " + ", ".join(f"fp{k} bigint" for k in range(len(seeds)))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def links_in_bands(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between distinct 64-bit fingerprints that differ in at most ``radius`` (0 to 2) bits.

    ``fps`` has one row (fp) for each distinct fingerprint. Of the links within a
    tile pair, a spanning forest is kept, so a crowd of near-equal fingerprints
    gives as many links as members, and components stay whole.
    """
    if not 0 <= radius <= 2:
        raise ValueError("four blocks find every pair only up to radius 2")
    blocks = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    keys = [
        F.shiftleft(F.lit(c).cast("bigint"), 32).bitwiseOR(F.shiftleft(blocks[i], 16)).bitwiseOR(blocks[j])
        for c, (i, j) in enumerate(combinations(range(4), 2))
    ]
    rows = fps.select(F.explode(F.array(*keys)).alias("key"), "fp")
    dealt = rows.repartition("key").sortWithinPartitions("key", F.bit_count("fp"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.empty(0, np.int64)
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            if not len(key):
                continue
            whole = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            yield _linked(key[:whole], fp[:whole], radius)
            key, fp = key[whole:], fp[whole:]
        yield _linked(key, fp, radius)

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _linked(key: np.ndarray, fp: np.ndarray, radius: int) -> pa.RecordBatch:
    value = np.ascontiguousarray(fp).view(np.uint64)
    pop = np.bitwise_count(value)
    left, right = [], []
    for a in range(0, len(key), TILE):
        top = min(a + TILE, len(key))
        for b in range(a, len(key), TILE):
            end = min(b + TILE, len(key))
            if key[b] > key[top - 1]:
                break
            if key[a] == key[end - 1] and int(pop[b]) - int(pop[top - 1]) > radius:
                continue  # one key, ordered by population count
            near = np.bitwise_count(value[a:top, None] ^ value[None, b:end]) <= radius
            near &= key[a:top, None] == key[None, b:end]
            i, j = np.nonzero(np.triu(near, 1) if a == b else near)
            if len(i):
                kept = spanning_forest(a + i, b + j, np.zeros(len(i), np.int64))
                left.append(fp[(a + i)[kept]])
                right.append(fp[(b + j)[kept]])
    empty = np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *x])) for x in (left, right)], names=["a", "b"])


def spanning_forest(i: np.ndarray, j: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Places of the links of a minimal spanning forest: cheapest first, one link for each node and pass."""
    nodes, ends = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = ends[: len(i)], ends[len(i) :]
    label = np.arange(len(nodes))
    kept: list[int] = []

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for level in np.unique(cost):
        left = np.flatnonzero(cost == level)
        while len(left):
            li, lj = label[i[left]], label[j[left]]
            apart = li != lj
            left, li, lj = left[apart], li[apart], lj[apart]
            _, first = np.unique(np.maximum(li, lj), return_index=True)
            for k in left[first].tolist():
                x, y = root(i[k]), root(j[k])
                if x != y:
                    label[max(x, y)] = min(x, y)
                    kept.append(k)
            while (flat := label[label]).tolist() != label.tolist():
                label = flat
    return np.array(kept, np.int64)


def links_in_grid(
    fps: DataFrame, columns: list[str], radius: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Links (a, b, distance) between rows (id, *columns) whose fingerprints differ in at most ``radius`` bits together.

    Rows are laid out in blocks of about ``block_rows`` by population count; each pair
    of blocks within the radius is one task's tile, and inside it sub-tiles beyond it
    are skipped. From every tile the links of a minimal spanning forest are kept, so
    that at any smaller radius the components are those of all links.
    """
    spark = fps.sparkSession
    key = sum(F.bit_count(c) for c in columns)
    fps = materialize(fps.select("id", *columns, key.alias("pop")))
    counts = dict(fps.groupBy("pop").count().collect())  # one row for each population count
    total = sum(counts.values())
    if not total:
        return spark.createDataFrame([], fps.select("id", F.col("id").alias("b"), F.lit(0).alias("distance")).toDF("a", "b", "distance").schema)
    n_blocks = -(-total // block_rows)
    pops = sorted(counts)
    before = dict(zip(pops, np.concatenate([[0], np.cumsum([counts[p] for p in pops])[:-1]]).tolist()))
    first = {p: before[p] * n_blocks // total for p in pops}
    low, high = [0] * n_blocks, [0] * n_blocks
    for b in range(n_blocks):
        inside = [p for p in pops if first[p] <= b <= (before[p] + counts[p]) * n_blocks // total] or pops
        low[b], high[b] = min(inside), max(inside)

    def looked_up(values: dict[int, int]) -> Column:
        return F.element_at(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*map(F.lit, values.values()))), F.col("pop"))

    place = looked_up(before) + F.floor(F.pmod(F.xxhash64("id", *columns), F.lit(1 << 30)) / (1 << 30) * looked_up(counts))
    rows = fps.withColumn("block", F.floor(place * n_blocks / total).cast("int"))
    lows, highs = F.array(*map(F.lit, low)), F.array(*map(F.lit, high))
    other = F.col("other")
    at = lambda array, k: F.element_at(array, k + 1)
    met = (at(lows, F.greatest("block", other)) - at(highs, F.least("block", other))) <= radius
    tiles = (
        rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        .where(met)
        .select((F.least("block", other).cast("bigint") * n_blocks + F.greatest("block", other)).alias("tile"), "block", "pop", "id", *columns)
    )
    id_type = fps.schema["id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("pop", "ascending")])
        block, pop = table["block"].to_numpy(), table["pop"].to_numpy()
        values = [np.ascontiguousarray(table[c].to_numpy()).view(np.uint64) for c in columns]
        cut = int(np.searchsorted(block, block[0], "right"))
        same = cut == len(block)
        i, j, d = _near(values, pop, slice(0, cut), slice(0, cut) if same else slice(cut, len(block)), same, radius)
        ids = table["id"].combine_chunks()
        return pa.table({"a": ids.take(pa.array(i)), "b": ids.take(pa.array(j)), "distance": pa.array(d.astype(np.int32))})

    return tiles.groupBy("tile").applyInArrow(run, f"a {id_type}, b {id_type}, distance int")


def _near(values, pop, rows: slice, others: slice, same: bool, radius: int, high: int = 64, wide: int = 2048):
    """Places and distances of the links that ``_thinned`` keeps, by sub-tiles within reach."""
    held = (np.empty(0, np.int64),) * 3
    for a in range(rows.start, rows.stop, high):
        top = min(a + high, rows.stop)
        found = []
        for b in range(others.start if not same else a - (a - rows.start) % wide, others.stop, wide):
            end = min(b + wide, others.stop)
            if pop[b] - pop[top - 1] > radius or pop[a] - pop[end - 1] > radius:
                continue
            d = np.bitwise_count(values[0][a:top, None] ^ values[0][None, b:end])
            for v in values[1:]:
                d = d + np.bitwise_count(v[a:top, None] ^ v[None, b:end])
            i, j = np.nonzero(d <= radius)
            if len(i):
                gi, gj, gd = a + i, b + j, d[i, j].astype(np.int64)
                ahead = gi < gj if same else slice(None)
                found.append((gi[ahead], gj[ahead], gd[ahead]))
        if found:
            stripe = tuple(np.concatenate(x) for x in zip(*found))
            held = tuple(np.concatenate(x) for x in zip(held, _thinned(*stripe)))
            if len(held[0]) > 1 << 19:  # what one pass over the stripes drops, another may too
                held = _thinned(*held)
    return _thinned(*held)


def _thinned(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links of a minimal spanning forest."""
    kept = spanning_forest(i, j, d) if len(i) else slice(None)
    return i[kept], j[kept], d[kept]


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42
) -> DataFrame:
    """(id, fp, component): documents whose fingerprints are linked, directly or through others.

    Two fingerprints link at ``radius`` or fewer differing bits; ``component`` is
    the smallest id reached, the row itself included. Null texts and texts
    without words have fingerprint zero and link like any other. Rows with equal
    ids each keep their row. A null id gets its component's smallest id, null if
    the component has none. An empty table gives an empty one.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, words, (seed,)).select("id", F.col("fp0").alias("fp")))
    groups = rows.groupBy("fp").agg(F.min("id").alias("least"))
    if radius <= 2:
        links = links_in_bands(groups.select("fp"), radius)
    else:
        links = links_in_grid(groups.select(F.col("fp").alias("id"), "fp"), ["fp"], radius)
    roots = connected(links)
    placed = groups.join(roots, groups["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    return rows.join(placed.join(least, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42
) -> DataFrame:
    """The rows of ``docs`` with one document left of each component of ``simhash_components``: the one with the smallest id.

    Null texts and texts without words are copies of each other. Of rows that repeat in
    id and text one stays. A null id comes after all others. All columns of ``docs`` are
    returned as they are, whatever their names.
    """
    own, text = F.col(id_col), F.col(text_col)
    uid = F.md5(F.concat_ws(":", F.coalesce(own.cast("string"), F.lit("")), F.length(F.coalesce(text, F.lit(""))).cast("string"), text))
    place = F.struct(own.isNull().alias("last"), own.alias("own"), uid.alias("uid"))  # without a null, smallest id first
    found = simhash_components(docs.select(place.alias("id"), text.alias("text")), "id", "text", words, radius, seed)
    found = materialize(found.select(F.col("id.uid").alias("uid"), (F.col("id") != F.col("component")).alias("gone")))
    repeats = found.groupBy("uid").count().where("count > 1").limit(1).count() > 0
    gone = broadcast_if_small(materialize(found.where("gone").select("uid").distinct()), UID_BYTES)
    out = docs.select(uid.alias("uid"), F.struct(*docs.columns).alias("row")).join(gone, "uid", "left_anti")
    if repeats:
        out = out.dropDuplicates(["uid"])
    return out.select("row.*")
