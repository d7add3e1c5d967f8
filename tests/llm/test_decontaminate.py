import random
import re

import pytest

from text_fixtures import ODD, table, thue_morse
from trialframe.llm.decontaminate import contamination, judged

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [(1, "c d e f g h i j k l m n o"), (2, "tie tie tie"), (3, None), (4, " ."), (5, "Été naïve"), (6, "x1 y2"), (None, "one"), (2, "tie tie tie")]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    out = []
    for doc, text in rows:
        w, hit, inside = words(text), set(), set()
        for item, other in items:
            x = words(other)
            size = min(13, len(x))
            if item is None or not size:
                continue
            for s in range(len(x) - size + 1):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == x[s : s + size]:
                        hit.update(range(p, p + size))
                        inside.add(str(item))
        out.append((doc, len(w), len(hit), sorted(inside), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def found(docs, items, spark, **more):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = judged(contamination(docs, benchmark, **more)).collect()
    for r in rows:
        assert r["n_hit"] == sum(b - a for a, b in zip(r["starts"], r["stops"]))
        assert all(a < b for a, b in zip(r["starts"], r["stops"])) and all(b < a for b, a in zip(r["stops"], r["starts"][1:]))
    return sorted(((r["id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows), key=str)


SHORT = [(d, t) for d, t in ODD if len(t or "") < 10_000]


@pytest.mark.parametrize("block_bytes", [32 << 20, 300])
def test_odd_rows_in_one_block_and_in_many(spark, block_bytes):
    assert found(table(spark, SHORT), ITEMS, spark, block_bytes=block_bytes) == brute(SHORT, ITEMS)


def test_random_passages(spark):
    rng = random.Random(1)
    items = [(k, " ".join(rng.choices("ab", k=rng.randint(1, 20)) + rng.choices("cdefgh", k=rng.randint(0, 30)))) for k in range(20)]
    rows = []
    for k in range(60):
        text = rng.choices("abcdefgh", k=rng.randint(0, 80))
        passage = rng.choice(items)[1].split()
        a = rng.randrange(len(text) + 1)
        rows.append((k, " ".join(text[:a] + passage[rng.randrange(3) :] + text[a:])))
    assert found(table(spark, rows), items, spark) == brute(rows, items)


def test_long_text_is_read_to_its_end(spark):
    text = "filler " * 200_000 + "alpha beta gamma"
    got = found(table(spark, [(1, text)]), [(7, "alpha beta gamma")], spark)
    assert got == [(1, 200_003, 3, ["7"], False)]


def test_empty_tables(spark, empty):
    assert found(empty, ITEMS, spark) == []
    assert {r[2] for r in found(table(spark, SHORT), [], spark)} == {0}


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_whose_polynomial_hashes_collide_do_not_match(spark, n):
    one, other = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    rows = [(1, f"{other} tail"), (2, f"{one} tail"), (3, other)]
    items = [(1, f"{one} tail")]
    assert found(table(spark, rows), items, spark) == brute(rows, items)
