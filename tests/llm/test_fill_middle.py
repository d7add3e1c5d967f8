import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from text_fixtures import LONG, ODD, table
from trialframe.llm.fill_middle import CharIndex, fill_in_middle, line_ends, restored

MORE = [
    (20, "a\nb\n\nc"),
    (21, "ü\n東京\n🙂x\n"),
    (22, "has <S> inside\nand more\n"),
    (23, "<<P\n<S\n<\nP>\nS>M>\n<"),
    (24, "\n"),
    (25, "\r\n\r\n"),
    (26, "line é\n" * 3000),
]


def brute(doc, text, unit, rate=100, spm_rate=50, seed="7"):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc, n, "plain", None, None, text)
    if h[3] % 100 < spm_rate:
        return (doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit,rate", [("line", 100), ("char", 100), ("line", 40), ("char", 0)])
def test_against_brute_force(spark, unit, rate):
    rows = ODD + MORE
    found = fill_in_middle(table(spark, rows), unit=unit, rate=rate).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in found), key=str) == sorted((brute(d, t, unit, rate) for d, t in rows), key=str)
    assert sorted(r["back"] for r in found) == sorted(t or "" for _, t in rows)


def test_random_texts_of_all_widths(spark):
    rng = random.Random(3)
    letters = "ab <>PSM\n\té東🙂"
    rows = [(k, "".join(rng.choices(letters, k=rng.randint(0, 60)))) for k in range(400)]
    for unit in ("line", "char"):
        found = fill_in_middle(table(spark, rows), unit=unit, spm_rate=30, seed="other").withColumn("back", restored(F.col("output"), F.col("form"))).collect()
        assert sorted(tuple(r)[:6] for r in found) == sorted(brute(d, t, unit, 100, 30, "other") for d, t in rows)
        assert sorted((r["id"], r["back"]) for r in found) == rows


def test_char_index_converts_both_ways():
    text = "aé東🙂z" * 50 + "plain " * 40 + "🙂🙂"
    data = np.frombuffer(text.encode(), np.uint8)
    index = CharIndex.of(data)
    bytes_ = np.cumsum([0] + [len(c.encode()) for c in text])
    assert index.to_byte(np.arange(len(text) + 1)).tolist() == bytes_.tolist()
    assert index.to_char(bytes_).tolist() == list(range(len(text) + 1))
    assert len(index.char) == sum(c > "\x7f" for c in text)  # ASCII leaves no entry


def test_line_ends():
    data, at = np.frombuffer(b"a\nb\nc\n\n", np.uint8), np.array([0, 0, 3, 4, 4, 7])
    assert line_ends(data, at).tolist() == [2, 3, 4, 6, 7]


def test_own_marks_and_wrong_parameters(spark):
    docs = table(spark, [(1, "one\ntwo\nthree\n"), (2, "has <P> in it\nx\n")])
    marks = ("[pre]", "[suf]", "[mid]")
    found = fill_in_middle(docs, marks=marks).withColumn("back", restored(F.col("output"), F.col("form"), marks))
    assert [r["back"] for r in found.orderBy("id").collect()] == ["one\ntwo\nthree\n", "has <P> in it\nx\n"]
    assert found.where("form = 'plain'").count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(docs, unit="word")
    with pytest.raises(ValueError):
        fill_in_middle(docs, marks=("<<>", "<S>", "<M>"))


def test_text_ids_and_empty_table(spark, empty):
    assert fill_in_middle(empty).collect() == []
    docs = spark.createDataFrame([("x", LONG + "\n" + LONG), (None, "a\nb\n")], "doc_id string, text string")
    found = {r["id"]: tuple(r) for r in fill_in_middle(docs).collect()}
    assert found["x"] == brute("x", LONG + "\n" + LONG, "line") and found[None] == brute(None, "a\nb\n", "line")
