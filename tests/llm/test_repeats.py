import random

import numpy as np
from hypothesis import given, settings, strategies as st

from text_fixtures import LONG, ODD, table
from trialframe.llm.repeats import common_prefixes, previous_factors, ranks, without_repeats


def brute(rows, length=100):
    """By id and place; rows that share an id are one document."""
    first = {}
    coded = [(-(1 << 63) if d is None else d, (t or "").encode()) for d, t in rows]
    for doc, text in coded:
        for i in range(len(text) - length + 1):
            key = text[i : i + length]
            first[key] = min(first.get(key, (doc, i)), (doc, i))
    out = []
    for (doc, text), (own, _) in zip(coded, rows):
        gone = np.zeros(len(text) + 2, bool)
        end = 0
        for i in range(len(text) - length + 1):
            if first[text[i : i + length]] < (doc, i):
                gone[max(i, end) + 1 : i + length + 1] = True
                end = i + length
        runs = int((gone[1:] & ~gone[:-1]).sum())
        out.append((own, len(text), int(gone.sum()), runs, bytes(np.frombuffer(text, np.uint8)[~gone[1:-1]])))
    return sorted(out, key=str)


def found(docs, **more):
    return sorted(((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in without_repeats(docs, **more).collect()), key=str)


def test_odd_rows(odd):
    assert found(odd) == brute(ODD)


def test_empty_table(empty):
    assert found(empty) == []


def test_random_passages_and_periods(spark):
    rng = random.Random(6)
    passages = ["".join(rng.choices("abcdé ", k=rng.randint(90, 400))) for _ in range(12)]
    rows = []
    for k in range(80):
        parts = [rng.choice(passages)[rng.randrange(60) :] if rng.random() < 0.6 else "".join(rng.choices("xyz ", k=rng.randint(0, 200))) for _ in range(4)]
        rows.append((rng.randrange(60), "".join(parts)))
    rows += [(200, "ab" * 150), (201, "ab" * 150 + "c"), (202, "abc" * 99), (203, "q" * 99), (204, "q" * 100), (205, "q" * 101)]
    assert found(table(spark, rows).repartition(7)) == brute(rows)


def test_common_line_with_many_neighbours(spark):
    rng = random.Random(8)
    line = "".join(rng.choices("abcdefghij ", k=110))
    rows = [(k, "".join(rng.choices("klmnop", k=50)) + line + "".join(rng.choices("klmnop", k=50))) for k in range(200)]
    assert found(table(spark, rows).repartition(5)) == brute(rows)


def test_keys_beyond_the_bound_of_a_task(spark):
    rng = random.Random(9)
    line = "".join(rng.choices("abcdefghij ", k=110))
    rows = [(k % 280, "".join(rng.choices("klm", k=rng.choice([3, 40]))) + line + "".join(rng.choices("kl", k=rng.choice([3, 40])))) for k in range(300)]
    rows += [(k, "other " + line[:50] * 3 + str(k % 7)) for k in range(300, 330)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        for bound in (1, 3000):
            assert found(table(spark, rows).repartition(5), key_bytes=bound) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_copy(spark):
    rows = [(1, LONG), (2, LONG[5:]), (3, "new:" + LONG[:120])]
    got = {r[0]: r[1:4] for r in found(table(spark, rows))}
    assert got[2] == (len(LONG) - 5, len(LONG) - 5, 1)
    assert got[3] == (124, 120, 1)
    period = len("lorem ipsum dolor sit amet ")
    assert got[1] == (len(LONG), len(LONG) - period, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2]), min_size=1, max_size=80))
def test_previous_factors_against_definition(letters):
    text = np.array(letters, np.uint8) + 97
    levels = ranks(text, 16)
    place = np.arange(len(text))
    order = np.lexsort((place, levels[-1][1]))
    factor = np.zeros(len(text), np.int64)
    factor[order] = previous_factors(place[order], common_prefixes(order, levels))
    whole = bytes(text) + b"\0" * 40
    for i in range(len(text)):
        for size in (8, 16):
            earlier = any(whole[j : j + size] == whole[i : i + size] for j in range(i))
            assert (factor[i] >= size) == earlier


def test_text_ids_are_taken_in_their_order(spark, empty):
    rng = random.Random(12)
    line = "".join(rng.choices("abc ", k=150))
    rows = [(k, "".join(rng.choices("xyz ", k=40)) + (line if k % 3 else "") + str(k)) for k in range(30)] + [(None, line), (7, "again " + line)]
    name = {k: f"id-{'abcdefghij'[k // 10]}{k % 10}" for k in range(30)} | {None: None}
    docs = spark.createDataFrame([(name[d], t) for d, t in rows], "doc_id string, text string").repartition(5)
    assert found(docs) == sorted(((name[d], *rest) for d, *rest in brute(rows)), key=str)
    assert found(docs.limit(0)) == []
