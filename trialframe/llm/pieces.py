"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces.

Spaces become the marker U+2581, with one marker before a text that is not
empty. The best path over a text is the sequence of pieces with the largest sum
of log scores; on a tie the path whose last piece starts earliest. A character
that no piece spells is given by its UTF-8 bytes, as byte pieces. A marker that
stands in the text itself is spelled by its bytes too, so decoding gives every
text back exactly.

No piece has a marker after another character, so the best path over a text is
made of the best paths between markers. Each chunk therefore solves its distinct
words once, all words together, one byte place after the other, and lays the
results out by occurrence.

Log scores: a model file of type unigram has them. A file of merge ranks has
``-rank``; by Zipf's law the log score is then ``-log(1 + rank)``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trialframe.llm._arrays import chunks, list_array, numbered, text_bytes

MARK = 0xFF  # stands for the marker in byte arrays; no UTF-8 text has this byte
UNKNOWN_PENALTY = 10.0
UNKNOWN = -1
BLOCK_AREA = 1 << 20  # byte places of the words that are solved together
SCALE = 1 << 24  # scores are added as whole numbers of 1/SCALE, so that sums, and ties, are exact
_UNREACHED = np.int64(-(1 << 62))


@dataclass
class Pieces:
    """Pieces as a double-array trie: from state s, byte b leads to base[s] + b if check there is s."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray  # piece that ends at a state, or UNKNOWN
    score: np.ndarray  # log scores in units of 1/SCALE
    unknown_score: int
    byte_piece: np.ndarray  # 256 pieces
    blob: np.ndarray  # bytes of all pieces, spaces for markers
    start: np.ndarray
    size: np.ndarray
    alone: np.ndarray  # bytes that occur in no piece beside other bytes: words end around them


def load_pieces(path: str) -> Pieces:
    """Reads a SentencePiece model file (on the driver; the tables are a few megabytes)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    spelled, raw, byte_piece = {}, np.zeros(n), np.full(256, UNKNOWN)
    texts = [b""] * n
    for k in range(n):
        text = model.id_to_piece(k)
        if model.is_byte(k):
            value = int(text[3:5], 16)
            byte_piece[value], texts[k] = k, bytes([value])
        elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
            spelled[text.encode().replace("▁".encode(), bytes([MARK]))] = k
            texts[k] = text.replace("▁", " ").encode()
            raw[k] = model.get_score(k)
    if (byte_piece < 0).any():
        raise ValueError("the model has no byte pieces")
    own = np.array(sorted(spelled.values()))
    ranks = bool((raw[own] == np.round(raw[own])).all())
    scores = np.array([-math.log1p(-x) for x in raw]) if ranks else raw
    return make_pieces(spelled, scores, byte_piece, texts)


def make_pieces(spelled: dict[bytes, int], scores: np.ndarray, byte_piece: np.ndarray, texts: list[bytes]) -> Pieces:
    if any(MARK in text.lstrip(bytes([MARK])) for text in spelled):
        raise ValueError("a piece has a marker after another character")
    base, check, piece = double_array(spelled)
    size = np.array([len(t) for t in texts])
    beside = np.zeros(256, bool)
    for text in spelled:
        if len(text) > 1:
            beside[list(text)] = True
    alone = ~beside
    alone[0x80:] = False
    byte_piece = byte_piece.copy()
    byte_piece[MARK] = byte_piece[0x20]  # where the marker itself is no piece
    units = np.round(scores * SCALE).astype(np.int64)
    unknown = int(units[list(spelled.values())].min() - UNKNOWN_PENALTY * SCALE)
    return Pieces(
        base, check, piece, units, unknown, byte_piece,
        np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size, alone,
    )


def double_array(spelled: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, piece) arrays of a trie over byte strings; state 0 is the root."""
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for text, k in spelled.items():
        node = 0
        for byte in text:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
            node = children[node][byte]
        ends[node] = k
    room = 2 * len(children) + 70_000
    base, check, piece = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, UNKNOWN, np.int32)
    taken = bytearray(room)
    taken[:257] = b"\1" * 257
    free, state, todo = 257, {0: 0}, [0]
    while todo:
        node = todo.pop()
        here = state[node]
        if node in ends:
            piece[here] = ends[node]
        bytes_ = sorted(children[node])
        if not bytes_:
            continue
        while taken[free]:
            free += 1
        at = free
        while taken[at] or any(taken[at - bytes_[0] + b] for b in bytes_):
            at += 1
        base[here] = at - bytes_[0]
        for b in bytes_:
            place = base[here] + b
            taken[place], check[place] = 1, here
            state[children[node][b]] = int(place)
            todo.append(children[node][b])
    top = max(state.values()) + 257
    return base[:top], check[:top], piece[:top]


def best_paths(pieces: Pieces, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best path of every word, one word after the other, and the number of ids of each."""
    size = stop - start
    order = np.argsort(size, kind="stable")
    ids: list[np.ndarray] = []
    counts = np.zeros(len(size), np.int64)
    lo = 0
    while lo < len(order):  # words of like length together, in blocks of bounded area
        longest = size[order[lo]] * 5 // 4 + 4
        hi = min(int(np.searchsorted(size[order], longest, "right")), lo + max(1, BLOCK_AREA // int(longest + 1)))
        rows = order[lo:hi]
        found, n = _viterbi(pieces, data, start[rows], size[rows])
        ids.append(found)
        counts[rows] = n
        lo = hi
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    of = np.repeat(order, counts[order])  # back to the order of the words
    return flat[np.argsort(of, kind="stable")], counts


def _viterbi(pieces: Pieces, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, longest = len(size), int(size[-1])
    place = np.arange(longest)
    text = np.zeros((longest + 1, n), np.uint8)
    text[:-1] = np.where(place[:, None] < size, data[np.minimum(start + place[:, None], len(data) - 1)], 0)
    best = np.full((longest + 1, n), _UNREACHED)
    best[0] = 0
    came, by = np.zeros((longest + 1, n), np.int32), np.full((longest + 1, n), UNKNOWN, np.int32)

    def offer(rows, end, score, at, k):
        better = score > best[end, rows]
        rows = rows[better]
        end = end if np.isscalar(end) else end[better]
        best[end, rows], came[end, rows] = score[better], at
        by[end, rows] = k if np.isscalar(k) else k[better]

    for at in range(longest):
        rows = np.flatnonzero((size > at) & (best[at] > _UNREACHED))
        if not len(rows):
            continue
        byte = text[at, rows]
        width = 1 + (byte >= 0xC0).astype(np.int64) + (byte >= 0xE0) + (byte >= 0xF0)
        width[byte == MARK] = 1
        spelled = np.zeros(len(rows), bool)
        live, state, k = np.arange(len(rows)), np.zeros(len(rows), np.int64), at
        while len(live) and k < longest:
            step = pieces.base[state] + text[k, rows[live]]
            go = (pieces.check[step] == state) & (size[rows[live]] > k)
            live, state = live[go], step[go].astype(np.int64)
            k += 1
            end = pieces.piece[state]
            whole = end >= 0
            if whole.any():
                here, end = live[whole], end[whole]
                spelled[here] |= width[here] == k - at
                offer(rows[here], k, best[at, rows[here]] + pieces.score[end], at, end)
        left = rows[~spelled]
        if len(left):
            offer(left, np.minimum(at + width[~spelled], size[left]), best[at, left] + pieces.unknown_score, at, UNKNOWN)
    # From the end back to the start; a character without a piece becomes its bytes.
    cursor, rows = size.copy(), np.arange(n)
    out_id, out_row = [], []
    while len(rows):
        rows = rows[cursor[rows] > 0]
        k, before = by[cursor[rows], rows], came[cursor[rows], rows]
        known = k >= 0
        out_id.append(k[known])
        out_row.append(rows[known])
        lost, end, first = rows[~known], cursor[rows[~known]], before[~known]
        back = 1
        while len(lost):  # bytes from last to first
            out_id.append(pieces.byte_piece[text[end - back, lost]].astype(np.int32))
            out_row.append(lost)
            back += 1
            more = end - back >= first
            lost, end, first = lost[more], end[more], first[more]
        cursor[rows] = before
    ids, of = np.concatenate(out_id), np.concatenate(out_row)
    turn = np.argsort(of[::-1], kind="stable")
    return ids[::-1][turn], np.bincount(of, minlength=n)


def encode_chunk(pieces: Pieces, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a column, one after the other, and the number of ids of each text."""
    data, at = text_bytes(column)
    full = np.flatnonzero(np.diff(at))
    # One marker before every text that is not empty; spaces become markers.
    lead = at[full] + np.arange(len(full))
    marked = np.empty(len(data) + len(full), np.uint8)
    own = np.ones(len(marked), bool)
    own[lead] = False
    marked[own] = np.where(data == 0x20, MARK, data)
    marked[lead] = MARK
    if not len(marked):
        return np.empty(0, np.int32), np.zeros(len(column), np.int64)
    is_mark, alone = marked == MARK, pieces.alone[marked]
    cut = alone.copy()
    cut[1:] |= (is_mark[1:] & ~is_mark[:-1]) | alone[:-1]
    cut[lead] = True
    start = np.flatnonzero(cut)
    ends = pa.py_buffer(np.append(start, len(marked)).astype(np.int64))
    word, words = numbered(pa.Array.from_buffers(pa.large_binary(), len(start), [None, ends, pa.py_buffer(marked)]))
    spelled, word_at = text_bytes(words)
    ids, counts = best_paths(pieces, spelled, word_at[:-1], word_at[1:])
    begin = np.cumsum(counts) - counts
    n = counts[word]
    ids = ids[np.repeat(begin[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    row = full[np.searchsorted(lead, start, "right") - 1]
    return ids, np.bincount(row, n, len(column)).astype(np.int64)


def decode_ids(pieces: Pieces, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the number of bytes of each, without the leading marker."""
    ends = np.cumsum(counts)
    full = np.flatnonzero(counts)
    size, start = pieces.size[ids], pieces.start[ids]
    head = ids[(ends - counts)[full]]
    marked = pieces.blob[np.minimum(pieces.start[head], len(pieces.blob) - 1)] == 0x20
    marked &= pieces.size[head] > 0
    lead = (ends - counts)[full][marked]
    size[lead] -= 1
    start[lead] += 1
    n_bytes = np.add.reduceat(np.append(size, 0), np.minimum(ends - counts, len(size))) * (counts > 0)
    where = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return pieces.blob[where], n_bytes


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, ids) for every document: the ids of its pieces.

    A null text has no ids, as an empty one. Rows with equal ids each keep their
    row; other columns are not looked at. An empty table gives an empty one.
    """
    return _encoded(docs, load_pieces(model_path), id_col, text_col, False)


def encode_and_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, ids, decoded): ``encode``, and the text that the ids spell, in one pass."""
    return _encoded(docs, load_pieces(model_path), id_col, text_col, True)


def _encoded(docs: DataFrame, pieces: Pieces, id_col: str, text_col: str, back: bool) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "text", "ids", "decoded"][: 3 + back]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in chunks(batch):
                ids, counts = encode_chunk(pieces, column)
                arrays = [part.column(0), part.column(1), list_array(counts, pa.array(ids))]
                if back:
                    arrays.append(pa.array(decoded_texts(pieces, ids, counts), pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string, ids array<int>" + ", decoded string" * back)


def decoded_texts(pieces: Pieces, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    data, n_bytes = decode_ids(pieces, ids, counts)
    ends = np.cumsum(n_bytes)
    whole = data.tobytes()
    return [whole[a:b].decode("utf-8", "replace") for a, b in zip((ends - n_bytes).tolist(), ends.tolist())]


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with a column ``decoded``: the text that the ids spell, null for null ids.

    Ids that are not pieces of the model fail; bytes that are not UTF-8 become
    U+FFFD.
    """
    pieces = load_pieces(model_path)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(names.index(ids_col))
            for row in range(0, len(lists), 256):
                part = lists.slice(row, 256)
                counts = np.diff(part.offsets.to_numpy())
                ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(ids) and not (ids.min() >= 0 and ids.max() < len(pieces.size)):
                    raise ValueError("an id is not a piece of the model")
                texts = decoded_texts(pieces, ids, counts)
                column = pa.array([t if ok else None for t, ok in zip(texts, part.is_valid().to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(row, 256) for k in range(len(names))), column], names=[*names, "decoded"]
                )

    return rows.mapInArrow(run, rows.withColumn("decoded", F.lit(None).cast("string")).schema)
