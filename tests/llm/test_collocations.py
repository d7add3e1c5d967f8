import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from text_fixtures import ODD, table, thue_morse
from trialframe.llm.collocations import chunk_dictionary, collocations, count_phrases, frequent_bits, parse, phrase_counts
from trialframe.session import materialize


def pieces(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
        words = re.findall(r"[^\x20\x09]+", piece)
        if words:
            yield words


def counts(rows, longest):
    found = Counter()
    for group, text in rows:
        for words in pieces(text):
            for k in range(1, longest + 1):
                for s in range(len(words) - k + 1):
                    found["und" if group is None else group, tuple(words[s : s + k])] += 1
    return found


def brute(rows, least, longest, top, contained=100):
    f, total = counts(rows, longest), Counter()
    for (g, p), c in f.items():
        total[g] += c if len(p) == 1 else 0
    chosen = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    out = {}
    for (g, p), a in chosen.items():
        inside = any(
            h == g and len(q) > len(p) and 100 * c >= contained * a and any(q[s : s + len(p)] == p for s in range(len(q) - len(p) + 1))
            for (h, q), c in chosen.items()
        )
        if not inside:
            score, k = min((1000 * a * total[g] // (f[g, p[:k]] * f[g, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(g, []).append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
    rows = []
    for g, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            rows.append((g, rank, phrase.decode(), -a, left, right, total[g], -score))
    return sorted(rows)


def found(docs, **more):
    return sorted(tuple(r) for r in collocations(docs, **more).select("grp", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def prose(rng, n):
    words = ["the", "of", "a", "cat", "dog", "New", "york", "CITY", "x", "é", "東京"]
    text = []
    for _ in range(n):
        text.append(rng.choice(["new york city hall", "the cat", rng.choice(words)]))
        text.append(rng.choice([" ", "  ", "\t", ", ", ".\n", " "]))
    return "".join(text)


@pytest.mark.parametrize("longest,contained,spacing", [(5, 100, 16), (3, 60, 2), (2, 100, 1), (6, 80, 3)])
def test_against_brute_force(spark, longest, contained, spacing):
    rng = random.Random(longest)
    rows = [(k, prose(rng, rng.randint(0, 120)), rng.choice(["en", "de", None])) for k in range(60)]
    rows += [(100 + k, "again and again and again and again it says the same", "en") for k in range(9)]
    docs = table(spark, rows, "doc_id long, text string, lang string")
    got = found(docs, least=6, longest=longest, top=15, contained=contained, spacing=spacing)
    assert got == brute([(g, t) for _, t, g in rows], 6, longest, 15, contained) and len(got) > 20


def test_counts_do_not_depend_on_the_parse(spark):
    rng = random.Random(8)
    text = " ".join(rng.choice(["tie", "a", "b"]) for _ in range(3000))
    docs = spark.createDataFrame([("en", text)] * 3 + [("en", "tie " * 500)], "grp string, text string")
    expected = {p: c for (_, p), c in counts(docs.collect(), 5).items() if c >= 4}
    for spacing in (1, 2, 7, 1000):
        every, totals = phrase_counts(docs, 5, 4, spacing)
        assert {tuple(r["phrase"].split(" ")): r["n"] for r in every.collect()} == expected
        assert totals.first()["n"] == 9500


def test_chunks_overlap_by_a_phrase_less_one(spark):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(40)}" + ("," if k % 50 == 7 else "") for k in range(2000))
    chunk, row, closed, starts = parse(pa.array([text], pa.large_string()), 5, 8)
    kept = chunk.to_pylist()
    chunk = [c.split() for c in kept]
    assert len(chunk) > 50 and sum(starts) == 2000 and closed.tolist() == [False] * (len(chunk) - 1) + [True]
    assert all(a[-4:] == b[:4] for a, b in zip(chunk, chunk[1:]))
    joined = [w for c, own in zip(chunk, starts) for w in c[:own]]
    assert " ".join(joined) == text.replace(",", "")
    assert sum(c.count("\n") for c in kept) >= 40  # piece ends stay
    again, *_ = parse(pa.array(["other words first, " + text], pa.large_string()), 5, 8)
    assert [c.split() for c in again.to_pylist()][-len(chunk) + 1 :] == chunk[1:]  # content decides


def test_equal_texts_fold_into_one_dictionary(spark):
    docs = spark.createDataFrame([("en", "one two three four five six, seven. eight nine")] * 50, "grp string, text string")
    rows = chunk_dictionary(docs.repartition(4), 5, 4).collect()
    assert all(r["n"] == 50 for r in rows)


def test_filter_loses_no_phrase(spark):
    rng = random.Random(4)
    rows = [("en", " ".join(f"w{min(rng.randrange(12), rng.randrange(12), rng.randrange(12))}" for _ in range(400))) for _ in range(20)]
    docs = spark.createDataFrame(rows, "grp string, text string")
    dictionary = materialize(chunk_dictionary(docs, 3, 16))
    two = count_phrases(dictionary, 2, 2).where("n >= 20")
    bits = frequent_bits(two, 2)
    pruned = {r["phrase"]: r["n"] for r in count_phrases(dictionary, 3, 2, bits).where("n >= 20").collect()}
    whole = {r["phrase"]: r["n"] for r in count_phrases(dictionary, 3, 2).where("n >= 20").collect()}
    assert pruned == whole and whole
    assert count_phrases(dictionary, 3, 2, bits).count() < count_phrases(dictionary, 3, 2).count()
    assert np.unpackbits(bits).sum() <= two.count()


def test_odd_rows_and_empty_table(spark, odd, empty):
    assert found(empty) == []
    assert found(odd, least=2) == brute([("en", t) for _, t in ODD], 2, 5, 2000)
    assert found(odd.limit(4)) == []


def test_products_beyond_64_bits(spark):
    import decimal

    from pyspark.sql import functions as F

    row = spark.createDataFrame([(10**13, 10**15, 10**13, 10**13)], "a long, n long, l long, r long")
    score = F.expr("(1000BD * cast(a as decimal(18, 0)) * cast(n as decimal(16, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    assert row.select(score).first()[0] == 1000 * 10**13 * 10**15 // 10**26
    assert decimal.getcontext().prec >= 28


def test_top_is_a_report_and_null_gives_all(spark):
    docs = table(spark, [(k, "new york, new york, old town, old town, big apple") for k in range(5)])
    assert len(found(docs, least=5, top=2)) == 2
    assert len(found(docs, least=5, top=None)) == 3


def test_colliding_words_are_counted_apart(spark):
    a, b = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    rows = [(k, f"say {a} now, say {b} {b} now", "en") for k in range(6)]
    docs = table(spark, rows, "doc_id long, text string, lang string")
    assert found(docs, least=5) == brute([(g, t) for _, t, g in rows], 5, 5, 2000)
