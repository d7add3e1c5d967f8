import random
import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from text_fixtures import LONG, ODD, table
from trialframe.llm.components import connected
from trialframe.llm.simhash import drop_near_duplicates, links_in_bands, links_in_grid, simhash_components, spanning_forest


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingles(text, k):
    w = words(text)
    return [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def fingerprint(text, k=3):
    found = [xxhash.xxh64_intdigest(x, 42) for x in shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(rows, radius=2):
    prints = [fingerprint(t) for _, t in rows]
    near = [(i, j) for i, j in combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= radius]
    root = roots(range(len(rows)), near)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root[i]] = min(doc, least.get(root[i], doc))
    return sorted(((doc, prints[i], least.get(root[i])) for i, (doc, _) in enumerate(rows)), key=str)


def found(docs):
    got = simhash_components(docs).collect()
    return sorted(((r["id"], r["fp"] % (1 << 64), r["component"]) for r in got), key=str)


def test_components_of_odd_rows(odd):
    assert found(odd) == brute(ODD)


def test_empty_table(empty):
    assert found(empty) == []
    assert drop_near_duplicates(empty).collect() == []


def test_components_of_near_copies(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(12):
        text = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(300)]
        for _ in range(6):
            edited = list(text)
            edited[rng.randrange(300)] = "z"
            rows.append((len(rows), " ".join(edited)))
    rng.shuffle(rows)
    got = found(table(spark, rows))
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len({p for _, p, _ in got})


def test_band_links_find_every_component(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(8):
            flips = rng.choice(63, 2, replace=False)
            prints.add(int(b) ^ (1 << int(flips[0])) ^ (1 << int(flips[1])))
    prints = sorted(prints)
    near = [(a, b) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 2]
    links = links_in_bands(spark.createDataFrame([(p,) for p in prints], "fp long"), 2).collect()
    assert all((r["a"] ^ r["b"]).bit_count() <= 2 for r in links)
    assert roots(prints, [(r["a"], r["b"]) for r in links]) == roots(prints, near)


def test_grid_links_keep_components_at_every_radius(spark):
    rng = np.random.default_rng(3)
    rows = [(k, int(a), int(b)) for k, (a, b) in enumerate(rng.integers(0, 1 << 62, (150, 2), dtype=np.int64))]
    for k in range(150, 300):
        _, a, b = rows[rng.integers(150)]
        rows.append((k, a ^ (1 << int(rng.integers(60))), b ^ (1 << int(rng.integers(60))) ^ (1 << int(rng.integers(60)))))
    links = links_in_grid(spark.createDataFrame(rows, "id long, x long, y long"), ["x", "y"], 20, block_rows=64).collect()
    apart = {(p[0], q[0]): (p[1] ^ q[1]).bit_count() + (p[2] ^ q[2]).bit_count() for p, q in combinations(rows, 2)}
    for radius in (0, 2, 4, 20):
        near = [pair for pair, d in apart.items() if d <= radius]
        kept = [(r["a"], r["b"]) for r in links if r["distance"] <= radius]
        assert roots(range(300), kept) == roots(range(300), near)
    assert all(apart[min(r["a"], r["b"]), max(r["a"], r["b"])] == r["distance"] for r in links)


def test_spanning_forest_is_minimal_and_short():
    i, j = np.array([0, 0, 1, 3]), np.array([1, 2, 2, 4])
    kept = spanning_forest(i, j, np.array([1, 5, 2, 7]))
    assert sorted(kept.tolist()) == [0, 2, 3]


def test_connected_chain_star_and_nulls(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(21)} | {k: 100 for k in range(100, 140)}


def kept_by_brute(rows, radius=2):
    """The least id of each component; a null id comes last."""
    prints = [fingerprint(t) for _, t in rows]
    near = [(i, j) for i, j in combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= radius]
    root = roots(range(len(rows)), near)
    order = {}
    for i, (doc, _) in enumerate(rows):
        order.setdefault(root[i], []).append((doc is None, doc))
    return sorted((min(x)[1] for x in order.values()), key=str)


def kept(docs, **more):
    return sorted((r["doc_id"] for r in drop_near_duplicates(docs, **more).collect()), key=str)


def near_copies(rng, n=25):
    rows = []
    for _ in range(n):
        text = ["".join(rng.choices("abcdef", k=4)) for _ in range(rng.randint(3, 300))]
        for _ in range(rng.randint(1, 6)):
            edited = list(text)
            for _ in range(rng.randint(0, 2)):
                edited[rng.randrange(len(edited))] = "edit"
            rows.append((len(rows), " ".join(edited)))
    return rows


def test_one_of_each_of_odd_rows(odd):
    found = drop_near_duplicates(odd)
    assert found.columns == odd.columns
    assert kept(odd) == kept_by_brute(ODD)


def test_one_of_each_against_all_pairs(spark):
    rows = near_copies(random.Random(9))
    assert kept(table(spark, rows)) == kept_by_brute(rows)
    assert len(kept_by_brute(rows)) < len({t for _, t in rows})  # edited copies go, too


def test_larger_radius_against_all_pairs(spark):
    rows = near_copies(random.Random(10), 15)
    assert kept(table(spark, rows), radius=6) == kept_by_brute(rows, 6)
    assert len(kept_by_brute(rows, 6)) < len(kept_by_brute(rows, 2))


def test_copies_of_a_long_text(spark):
    rows = [(k, LONG) for k in range(3)] + [(9, None), (8, "")]
    assert kept(table(spark, rows)) == [0, 8]


def test_repeated_rows_and_text_ids(spark):
    docs = spark.createDataFrame([("b", "one two three four")] * 3 + [("a", "other words than these"), (None, "one two three four")], "doc_id string, text string")
    assert kept(docs) == ["a", "b"]


def test_no_column_of_a_clashing_name_is_changed(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, "other words there")], "doc_id long, text string")
    for name in ("uid", "row", "fp", "_near_duplicate_uid", "id", "component", "gone", "least", "root"):
        docs = docs.withColumn(name, F.lit(name))
    assert sorted(map(tuple, drop_near_duplicates(docs).collect())) == sorted(map(tuple, docs.collect()))


def test_plan_has_no_cross_join(odd):
    plan = simhash_components(odd).select(F.col("id"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
