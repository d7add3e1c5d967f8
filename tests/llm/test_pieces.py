import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from text_fixtures import ODD, table, thue_morse
from trialframe.llm import pieces as P
from trialframe.llm.queries import PIECE_MODEL

MARK = bytes([P.MARK])


@pytest.fixture(scope="module")
def model():
    return P.load_pieces(PIECE_MODEL)


def small(spelled):
    """A model with these pieces and scores after the 256 byte pieces."""
    texts = [bytes([b]) for b in range(256)] + [t.replace(MARK, b" ") for t in spelled]
    scores = np.array([0.0] * 256 + list(spelled.values()))
    return P.make_pieces({t: 256 + k for k, t in enumerate(spelled)}, scores, np.arange(256), texts)


def encoded(model, texts):
    ids, counts = P.encode_chunk(model, pa.array(texts, pa.large_string()))
    at = np.cumsum(counts)
    data, n = P.decode_ids(model, ids, counts)
    ends = np.cumsum(n)
    lists = [ids[a - c : a].tolist() for a, c in zip(at, counts)]
    return lists, [data[b - c : b].tobytes().decode() for b, c in zip(ends, n)]


def best_score(spelled, unknown, text):
    """The best sum of scores over a whole text, by its definition."""
    text = MARK + text.encode().replace(b" ", MARK) if text else b""
    best = [0] + [None] * len(text)
    for at in range(len(text)):
        if best[at] is None:
            continue
        width = 1 if text[at] == P.MARK or text[at] < 0x80 else 2 if text[at] < 0xE0 else 3 if text[at] < 0xF0 else 4
        single = text[at : at + width] in spelled
        options = [(len(t), s) for t, s in spelled.items() if text.startswith(t, at)] + ([] if single else [(width, unknown)])
        for size, score in options:
            total = best[at] + score
            if best[at + size] is None or total > best[at + size]:
                best[at + size] = total
    return best[-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abcé \n", max_size=14), min_size=1, max_size=8), st.randoms(use_true_random=False))
def test_paths_are_the_best_ones(texts, rng):
    parts = [b"a", b"b", b"c", b"ab", b"abc", b"bc", b"ca", "é".encode(), "aé".encode(), MARK, MARK + MARK, MARK + b"a", MARK + b"ab"]
    spelled = {t: float(-rng.randint(1, 40)) for t in parts if rng.random() < 0.7} or {b"a": -1.0}
    model = small(spelled)
    units = {t: round(s * P.SCALE) for t, s in spelled.items()}
    lists, decoded = encoded(model, texts)
    assert decoded == texts
    for text, ids in zip(texts, lists):
        found, k = 0, 0
        while k < len(ids):
            if ids[k] >= 256:
                found, k = found + int(model.score[ids[k]]), k + 1
            else:  # the bytes of one character
                k += 1 if ids[k] < 0x80 else 2
                found += model.unknown_score
        assert found == (best_score(units, model.unknown_score, text) or 0)


def test_against_the_library(model, tmp_path, spark):
    """The model file, made a unigram one with the same scores, gives the same ids."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=_as_unigram(open(PIECE_MODEL, "rb").read(), model.score / P.SCALE))
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [t for _, t in ODD if t and len(t) < 10_000 and "▁" not in t] + ["Hello  world\n é 🙂 ", " ", "  a  b "]
    lists, decoded = encoded(model, texts)
    assert decoded == texts
    same = 0
    for text, ids in zip(texts, lists):
        other = processor.encode(text)
        assert abs(sum(model.score[ids]) - sum(model.score[other])) < 1e-3 * P.SCALE
        same += ids == other
    assert same >= 0.95 * len(texts)  # the library adds in single precision, so ties can differ


def _as_unigram(data, scores):
    import struct

    def number(b, i):
        x = s = 0
        while True:
            x |= (b[i] & 127) << s
            s, i = s + 7, i + 1
            if b[i - 1] < 128:
                return x, i

    def coded(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    def fields(b):
        i = 0
        while i < len(b):
            start = i
            tag, i = number(b, i)
            if tag & 7 == 0:
                _, i = number(b, i)
                yield tag >> 3, b[start:i], None
            elif tag & 7 == 5:
                i += 4
                yield tag >> 3, b[start:i], None
            else:
                size, i = number(b, i)
                i += size
                yield tag >> 3, b[start:i], b[i - size : i]

    out, k = b"", 0
    for field, raw, body in fields(data):
        if field == 1:  # a piece: field 2 is its score
            body = b"".join(bytes([0x15]) + struct.pack("<f", scores[k]) if f == 2 else r for f, r, _ in fields(body))
            k += 1
        elif field == 2:  # field 3 is the type
            body = b"".join(coded(3 << 3) + coded(1) if f == 3 else r for f, r, _ in fields(body))
        out += coded(field << 3 | 2) + coded(len(body)) + body
    return out


def test_odd_rows_and_empty_table(odd, empty):
    rows = P.decode(P.encode(odd, PIECE_MODEL), PIECE_MODEL).collect()
    both = P.encode_and_decode(odd, PIECE_MODEL).collect()
    assert sorted(map(tuple, both), key=str) == sorted(map(tuple, rows), key=str)
    assert sorted((r["id"], r["text"]) for r in rows if r["id"]) == sorted((d, t) for d, t in ODD if d) or len(rows) == len(ODD)
    assert all(r["decoded"] == (r["text"] or "") for r in rows)
    assert all(len(r["ids"]) == 0 for r in rows if not r["text"])
    assert P.decode(P.encode(empty, PIECE_MODEL), PIECE_MODEL).collect() == []


def test_decode_of_null_and_foreign_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "id long, ids array<int>")
    assert [r["decoded"] for r in P.decode(rows, PIECE_MODEL).orderBy("id").collect()] == [None, ""]
    with pytest.raises(Exception, match="not a piece"):
        P.decode(spark.createDataFrame([(1, [40_000])], "id long, ids array<int>"), PIECE_MODEL).collect()


def test_trie_holds_every_piece_and_no_other():
    rng = random.Random(1)
    spelled = {bytes(rng.choices(range(1, 256), k=rng.randint(1, 6))): k for k in range(3000)}
    base, check, piece = P.double_array(spelled)

    def look(text):
        state = 0
        for b in text:
            to = base[state] + b
            if check[to] != state:
                return P.UNKNOWN
            state = to
        return piece[state]

    assert all(look(t) == k for t, k in spelled.items())
    others = [bytes(rng.choices(range(1, 256), k=rng.randint(1, 6))) for _ in range(3000)]
    assert all(look(t) == spelled.get(t, P.UNKNOWN) for t in others)


def test_piece_across_a_marker_is_refused():
    with pytest.raises(ValueError):
        small({b"a" + MARK + b"b": -1.0})


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_whose_polynomial_hashes_collide_stay_apart(model, n):
    for a, b in ("ab", "01", "et"):
        texts = [f"{thue_morse(n, a, b)} x {thue_morse(n, b, a)}", thue_morse(n, b, a)]
        assert encoded(model, texts)[1] == [" " + t for t in texts] or encoded(model, texts)[1] == texts
