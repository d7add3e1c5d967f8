import hashlib
import random
import re
import struct

import xxhash

from text_fixtures import LONG, ODD, table
from trialframe.llm import winnow as W


def xx(value, seed=42):
    data = value.encode() if isinstance(value, str) else struct.pack("<q", value)
    h = xxhash.xxh64_intdigest(data, seed % (1 << 64))
    return h - (1 << 64) if h >> 63 else h


ALONE = "\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[{ALONE}]|[^ \t\n\x0b\f\r{ALONE}]{{1,8}}")


def brute(text, window=8, short=32):
    """(hash, place) of every window's smallest hash, the rightmost on a tie; all hashes of a short text. The hash rolls."""
    h = [xx(w) % (1 << 64) for w in TOKEN.findall((text or "").lower())]
    turn = lambda x, k: (x << k | x >> (64 - k)) % (1 << 64) if k else x
    if not h:
        return []
    if len(h) < 2:
        total = 42
        for x in h:
            total = xx(x - (1 << 64) if x >> 63 else x, total)
        grams = [total]
    else:
        value, grams = turn(h[0], 1) ^ h[1], []
        for k in range(len(h) - 1):
            grams.append(xx(value - (1 << 64) if value >> 63 else value))
            if k + 2 < len(h):
                value = turn(value ^ turn(h[k], 1), 1) ^ h[k + 2]
    grams = [g & 0x7FFFFFFF for g in grams]
    if len(grams) < short:
        return [(g, k) for k, g in enumerate(grams)]
    out = []
    for a in range(len(grams) - window + 1):
        part = grams[a : a + window]
        least = min(part)
        choice = (least, a + max(i for i, g in enumerate(part) if g == least))
        if choice not in out[-window:]:
            out.append(choice)
    return out


def unpacked(marks):
    return [(m >> 32, 0xFFFFFFFF - (m & 0xFFFFFFFF)) for m in marks]


def test_marks_against_definition(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcde", k=rng.randint(0, 60))) for _ in range(120)] + [t for _, t in ODD if len(t or "") < 10_000]
    texts += ["same same same " * 30, "Tabs\tand\nlines  and\r\nmore  here we go again"]
    rows = W.document_marks(table(spark, list(enumerate(texts)))).collect()
    for r in rows:
        assert unpacked(r["marks"]) == brute(texts[r["id"]]), texts[r["id"]]


def test_shared_passage_shares_a_mark(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = [word() for _ in range(W.GRAM + W.WINDOW - 1)]
    texts = [" ".join([word() for _ in range(rng.randint(0, 90))] + passage + [word() for _ in range(40)]) for _ in range(30)]
    sets = [{h for h, _ in unpacked(r["marks"])} for r in W.document_marks(table(spark, list(enumerate(texts)))).collect()]
    assert all(sets[0] & s for s in sets)


def check(docs, rows):
    got = W.edited_fingerprints(docs).collect()
    ids = sorted({d for d, _ in rows if d is not None})
    first = {}
    for d, t in rows:
        first.setdefault(d, []).append(t or "")
    follow = {d: min(first[ids[(k + 1) % len(ids)]], key=xx) for k, d in enumerate(ids)}
    expected = []
    for d, t in rows:
        t = t or ""
        n = len(t)
        after = follow.get(d, "")
        edited = t[: n - n // 2] + after[: n // 2]
        a, b, c = ({h for h, _ in brute(x)} for x in (t, edited, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        expected.append((d, n, hashlib.sha256(edited.encode()).hexdigest(), round(like(a, b), 9), round(like(a, c), 9) if d is not None else 0.0))
    found = [(r["id"], r["n_chars"], hashlib.sha256(r["edited"].encode()).hexdigest(), round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got]
    assert sorted(found, key=str) == sorted(expected, key=str)
    return got


def test_next_document_and_likeness(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(-500, 10_000) * 7, " ".join(rng.choices(["é", "bb", "ccc", "d"], k=rng.randint(0, 50)))) for _ in range(150)]
    rows = list({d: (d, t) for d, t in rows}.values())
    got = check(table(spark, rows).repartition(6), rows)
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows)[r["id"]], set()).add(r["digest"])
    assert all(len(x) == 1 for x in by_text.values())


def test_odd_rows(spark):
    rows = [(d, t) for d, t in ODD if len(t or "") < 10_000]
    check(table(spark, rows), rows)


def test_one_document_is_its_own_next(spark):
    (row,) = check(table(spark, [(3, "only one document here now")]), [(3, "only one document here now")])
    assert row["near_next"] == 1.0


def test_long_text_and_empty_table(spark, empty):
    got = {r["id"]: r for r in W.edited_fingerprints(table(spark, [(1, LONG), (2, "short")])).collect()}
    assert got[1]["n_chars"] == len(LONG) and got[2]["edited"] == "sholo"
    assert W.edited_fingerprints(empty).collect() == []


def test_native_plan(odd):
    plan = W.edited_fingerprints(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_half_of_a_short_or_unspaced_text_is_seen(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 12)))
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    rows = [(k, " ".join(word() for _ in range(8 + k % 30))) for k in range(200)]
    rows += [(1000 + k, "".join(rng.choices("abcdefghijklmnop", k=40 + 7 * k))) for k in range(100)]
    rows += [(2000 + k, han(6 + 9 * k)) for k in range(100)]
    found = W.edited_fingerprints(table(spark, rows)).collect()
    assert len(found) == 400 and all(0 < r["near_edited"] < 1 for r in found)
    assert sum(r["near_next"] < 0.1 for r in found) > 390


def test_shifted_han_text_shares_marks(spark):
    rng = random.Random(4)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200))
    a, b = W.document_marks(table(spark, [(1, text), (2, "xyz" + text[3:])])).orderBy("id").collect()
    one, other = ({h for h, _ in unpacked(r["marks"])} for r in (a, b))
    assert len(one & other) >= 0.9 * len(one) > 30
