"""General hypotheses, self-starting curves, dependent or many terms, and many levels."""

import itertools
import random
import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import DataFrame, functions as F

from trialframe.operators import curves as C
from trialframe.operators import hypotheses as H
from trialframe.operators import least_squares as G
from trialframe.operators import letters as K
from trialframe.operators import linear as L
from trialframe.operators import means as M
from trialframe.operators.cells import cell_stats


def cells(spark, curves, xs=range(1, 41), n=5, ss=1.0):
    rows = [(f, t, float(x), n, float(fn(x)), ss) for (f, t), fn in curves.items() for x in xs]
    return spark.createDataFrame(rows, "family string, treatment string, x double, n long, mean double, ss double")


def logistic(a, m, s):
    return lambda x: a / (1 + np.exp((m - x) / s))


def asymptotic(a, lrc, c0):
    return lambda x: a * (1 - np.exp(-np.exp(lrc) * (x - c0)))


SHARED = {("g", "A"): logistic(20, 15, 4), ("g", "B"): logistic(26, 15, 4), ("g", "C"): logistic(21, 15, 4)}
OWN = {t: f"asym_{t}" for t in "ABC"}


def shared_fit(spark, table=None):
    curve = C.shared_logistic(list("ABC"))
    starts = {"asym_A": 18, "asym_B": 18, "asym_C": 18, "xmid": 14, "scal": 3}
    return C.fit_curve(table or cells(spark, SHARED), curve, starts, keys=["family"]), curve


def shared_covariance():
    x = np.arange(1, 41)
    rows = []
    for k, a in enumerate((20, 26, 21)):
        z = 1 / (1 + np.exp((15 - x) / 4))
        own = np.zeros((len(x), 3))
        own[:, k] = z
        rows.append(np.column_stack([own, -a * z * (1 - z) / 4, -a * z * (1 - z) * (x - 15) / 16]))
    jac = np.concatenate(rows)
    return np.linalg.inv(5 * jac.T @ jac) * (120.0 / (600 - 5))


def test_contrasts_of_shared_parameters_use_their_covariance(spark):
    fits, curve = shared_fit(spark)
    cov = shared_covariance()
    rows = {(r.level_a, r.level_b): r for r in H.shared_contrasts(fits, curve, OWN, "asym").collect()}
    assert set(rows) == {("A", "B"), ("A", "C"), ("B", "C")}
    for (a, b), (i, j) in zip([("A", "B"), ("A", "C"), ("B", "C")], itertools.combinations(range(3), 2)):
        own = rows[a, b]
        assert own.se == pytest.approx(np.sqrt(cov[i, i] + cov[j, j] - 2 * cov[i, j]), rel=1e-6)
        assert own.se < np.sqrt(cov[i, i] + cov[j, j]) * 0.999  # the asymptotes share midpoint and scale
        assert own.difference == pytest.approx((20, 26, 21)[i] - (20, 26, 21)[j], rel=1e-6)
        assert (own.df, own.levels) == (595, 3)
    means = H.own_estimates(fits, curve, OWN, "asym")
    lettered = K.letter_groups(means, H.shared_contrasts(fits, curve, OWN, "asym"), ["family", "param"], value="estimate")
    assert {r.treatment: r.letters for r in lettered.collect()} == {"B": "a", "C": "b", "A": "c"}


def test_combinations_and_joint_tests(spark):
    fits, curve = shared_fit(spark)
    cov, theta = shared_covariance(), np.array([20, 26, 21, 15, 4.0])
    combos = {"mean": {"asym_A": 1 / 3, "asym_B": 1 / 3, "asym_C": 1 / 3}, "odd": {"asym_B": 2.0, "xmid": -1.0, "scal": 0.5}}
    for r in H.linear_hypotheses(fits, curve, combos).collect():
        w = np.array([combos[r.hypothesis].get(p, 0.0) for p in curve.params])
        assert r.estimate == pytest.approx(w @ theta, rel=1e-6) and r.se == pytest.approx(np.sqrt(w @ cov @ w), rel=1e-6)
    tests = {"equal": [{"asym_A": 1, "asym_B": -1}, {"asym_A": 1, "asym_C": -1}], "again": [{"asym_A": 1, "asym_B": -1}, {"asym_A": 2, "asym_B": -2}], "scal": [{"scal": 1}]}
    got = {r.term: r for r in H.joint_tests(fits, curve, tests).collect()}
    m = np.array([[1, -1, 0, 0, 0], [1, 0, -1, 0, 0.0]])
    v = m @ theta
    assert got["equal"].f == pytest.approx(v @ np.linalg.solve(m @ cov @ m.T, v) / 2, rel=1e-6) and got["equal"].df1 == 2
    assert got["again"].df1 == 1 and got["again"].f == pytest.approx(36 / (m @ cov @ m.T)[0, 0], rel=1e-6)
    assert got["scal"].f == pytest.approx(16 / cov[4, 4], rel=1e-6)
    with pytest.raises(ValueError):
        H.linear_hypotheses(fits, curve, {"bad": {"asym_X": 1.0}})


def test_hypotheses_about_a_failed_fit_are_null(spark):
    flat = cells(spark, {("g", t): (lambda x: 0.0) for t in "ABC"}, xs=range(1, 3))
    fits, curve = shared_fit(spark, flat)
    assert all(r.se is None and r.p is None for r in H.shared_contrasts(fits, curve, OWN, "asym").collect())
    assert all(r.f is None and r.p is None for r in H.shared_wald_f(fits, curve, OWN, "asym").collect())


def test_planted_asymptotic_curves_start_themselves(spark):
    planted = {("g", "fast"): (3.0, 0.5, 1.0), ("g", "slow"): (50.0, -4.5, -3.0), ("h", "fall"): (-4.0, -2.0, 2.0), ("h", "tall"): (1e4, -1.0, 0.5)}
    table = cells(spark, {k: asymptotic(*p) for k, p in planted.items()} | {("h", "two"): lambda x: x})
    table = table.where("treatment <> 'two' or x < 3")
    got = {(r.family, r.treatment): r for r in C.asymptotic_self_start(table).collect()}
    for key, (a, lrc, c0) in planted.items():
        own = got[key]
        assert own.converged and (own.asym, own.lrc, own.c0) == (pytest.approx(a, rel=1e-5), pytest.approx(lrc, rel=1e-5), pytest.approx(c0, abs=1e-4))
    assert got["h", "two"].status == "no start" and got["h", "two"].asym is None


def test_noisy_asymptotic_curves_equal_the_fit_from_good_starts(spark):
    rng = np.random.default_rng(2)
    table = cells(spark, {("g", t): (lambda x, p=p: asymptotic(*p)(x) + rng.normal(0, 0.05)) for t, p in (("a", (5, -2, 1)), ("b", (4, -1, -2)))})
    table = table.cache()
    got = {r.treatment: r for r in C.asymptotic_self_start(table).collect()}
    given = {r.treatment: r for r in C.fit_curve(table, C.ASYMPTOTIC, {"asym": 4.5, "lrc": -1.5, "c0": 0.0}).collect()}
    for t in "ab":
        assert got[t].rss == pytest.approx(given[t].rss, rel=1e-9) and got[t].lrc == pytest.approx(given[t].lrc, rel=1e-6)


def test_offset_logistic_starts_itself_and_others_say_so(spark):
    table = cells(spark, {("g", "a"): lambda x: 4 + logistic(12, 20, 3)(x)})
    got = C.self_start_fit(table, C.LOGISTIC_OFFSET).first()
    assert (got.asym, got.xmid, got.scal, got.offset) == tuple(pytest.approx(v, rel=1e-6) for v in (12, 20, 3, 4))
    with pytest.raises(ValueError):
        C.curve_starts(table, C.shared_logistic(["a"]))


def broken(b, before=2.0, turn=-1.5):
    return lambda x: 10 + before * x + turn * max(x - b, 0)


def test_breaks_are_found_from_any_guess(spark):
    table = cells(spark, {("v", "A"): broken(12.4), ("v", "B"): broken(33.7, -1.0, 4.0), ("w", "A"): broken(5.0, 0.0, 1.0), ("w", "B"): broken(20.0)})
    planted = {("v", "A"): 12.4, ("v", "B"): 33.7, ("w", "A"): 5.0, ("w", "B"): 20.0}
    for guess in (None, {"A": 39.0, "B": 2.0}, {"A": -100.0, "B": 1e6}, ["A", "B"]):
        got = {(r.family, r.treatment): r for r in C.segmented_fit(table, guess).collect()}
        assert {k: r["break"] for k, r in got.items()} == {k: pytest.approx(v, abs=1e-6) for k, v in planted.items()}
    some = {(r.family, r.treatment): r.status for r in C.segmented_fit(table, ["A"]).collect()}
    assert some["v", "A"] == "converged" and some["v", "B"] == "no start"


def test_profile_start_is_the_least_residual_of_all_breaks(spark):
    rng = np.random.default_rng(7)
    x = np.arange(1, 31)
    y = np.array([broken(14.0)(v) for v in x]) + rng.normal(0, 3.0, 30)
    n = rng.integers(1, 9, 30)
    table = spark.createDataFrame([("g", "a", float(v), int(k), float(m), 0.0) for v, k, m in zip(x, n, y)], "family string, treatment string, x double, n long, mean double, ss double")
    got = C.profile_starts(table).first()

    def rss(p):
        d = np.column_stack([np.ones(30), x, np.maximum(x - p, 0)]) * np.sqrt(n)[:, None]
        return np.linalg.lstsq(d, y * np.sqrt(n), rcond=None)[1][0]

    assert rss(got["break"]) <= min(rss(p) for p in np.linspace(2.01, 28.99, 3000)) * (1 + 1e-6)
    assert C.profile_starts(table.where("x < 4")).count() == 0


def frame(spark, x, y, family):
    names = [f"c{k}" for k in range(x.shape[1])]
    rows = [(f, *map(float, r), float(v)) for f, r, v in zip(family, x, y)]
    return spark.createDataFrame(rows, f"family string, {', '.join(f'{n} double' for n in names)}, y double"), {n: F.col(n) for n in names}


def test_dependent_terms_are_set_aside(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 300))
    x = np.column_stack([a, 2 * a + 3, b, np.full(300, 0.1), a - b, b**2])
    y = 1 + a - 2 * b + rng.normal(size=300)
    df, terms = frame(spark, x, y, ["f", "g"] * 150)
    rows = {(r.family, r.term): r for r in G.gram_ols(df, "y", terms).collect()}
    for k, f in enumerate("fg"):
        own = np.arange(300) % 2 == k
        design = np.column_stack([np.ones(150), x[own][:, [0, 2, 5]]])
        beta, rss, *_ = np.linalg.lstsq(design, y[own], rcond=None)
        assert {t for t in terms if rows[f, t].aliased} == {"c1", "c3", "c4"}
        se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / 146)
        for t, v, s in zip(("(intercept)", "c0", "c2", "c5"), beta, se):
            assert rows[f, t].estimate == pytest.approx(v, rel=1e-8) and rows[f, t].se == pytest.approx(s, rel=1e-8)
        assert rows[f, "c0"].parameters == 4 and rows[f, "c0"].df == 146 and rows[f, "c1"].estimate is None and rows[f, "c1"].p is None


def test_sequential_sums_are_drops_of_the_residual(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    x = np.column_stack([x, x[:, 0] + x[:, 1]])
    y = x[:, 1] * 0.2 + rng.normal(size=200)
    df, terms = frame(spark, x, y, ["f"] * 200)
    gram = G.gram_table(df, "y", terms)
    rows = {r.term: r for r in G.sequential_anova(gram, list(terms)).collect()}
    before = ((y - y.mean()) ** 2).sum()
    for k, name in enumerate(list(terms)[:4], 1):
        design = np.column_stack([np.ones(200), x[:, :k]])
        rss = np.linalg.lstsq(design, y, rcond=None)[1][0]
        assert rows[name].ss == pytest.approx(before - rss, abs=1e-8) and rows[name].df == 1
        before = rss
    assert (rows["c4"].df, rows["c4"].f) == (0, None) and rows["residual"].ss == pytest.approx(before) and rows["residual"].df == 195
    grouped = {r.term: r for r in G.sequential_anova(gram, list(terms), {"one": ["c0", "c1"], "rest": ["c2", "c3", "c4"]}).collect()}
    assert grouped["rest"].df == 2 and grouped["one"].ss == pytest.approx(rows["c0"].ss + rows["c1"].ss)
    assert sum(r.ss for r in grouped.values()) == pytest.approx(((y - y.mean()) ** 2).sum())
    with pytest.raises(ValueError):
        G.sequential_anova(gram, list(terms), {"one": ["c1", "c0"]})


def test_forty_terms_in_dense_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 40)) + 1e4 * rng.normal(size=40)  # far from zero: raw squares would lose their digits
    y = x @ rng.normal(size=40) + rng.normal(size=1200)
    family = ["f", "g", "h"] * 400
    df, terms = frame(spark, x, y, family)
    extra = df.limit(1).withColumn("y", F.lit(None).cast("double")).union(df.limit(1).withColumn("c3", F.lit(float("nan"))))
    df = df.union(extra).repartition(5)
    dense = {r.family: r for r in G.gram_table_dense(df, "y", terms).collect()}
    for k, f in enumerate("fgh"):
        v = np.column_stack([x, y])[k::3]
        away = v - v.mean(axis=0)
        assert dense[f].n == 400 and np.allclose(dense[f].means, v.mean(axis=0), rtol=1e-12)
        expected = (away.T @ away)[np.triu_indices(41)]
        assert np.allclose(dense[f].gram, expected, rtol=1e-8, atol=1e-6 * np.abs(expected).max())
    fit = {(r.family, r.term): r for r in G.gram_ols(df, "y", terms).collect()}
    beta = np.linalg.lstsq(np.column_stack([np.ones(400), (x - x.mean(axis=0))[::3]]), y[::3], rcond=None)[0]
    assert [fit["f", f"c{k}"].estimate for k in range(40)] == pytest.approx(list(beta[1:]), rel=1e-6)


def test_dense_blocks_equal_the_covariances_for_few_terms(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df, terms = frame(spark, rng.normal(size=(300, 3)), rng.normal(size=300), [random.Random(k).choice("abcdefgh") for k in range(300)])
    few = {r.family: r for r in G.gram_table(df, "y", terms).collect()}
    monkeypatch.setattr(G, "HELD_BYTES", 1)  # every block is handed on at once
    dense = {r.family: r for r in G.gram_table_dense(df, "y", terms).collect()}
    assert few.keys() == dense.keys()
    for f, own in few.items():
        assert own.n == dense[f].n and np.allclose(own.gram, dense[f].gram) and np.allclose(own.means, dense[f].means)
    assert G.gram_table_dense(df.limit(0), "y", terms).count() == 0


def test_conjugate_gradients_equal_the_dense_solution(spark):
    rng = np.random.default_rng(8)
    rows = []
    for family, k, m in (("f", 14, 12), ("g", 9, 30)):
        for t in range(k):
            for x in rng.choice(m, rng.integers(4, m), replace=False):
                rows.append((family, f"t{t}", f"x{x}", int(rng.integers(1, 20)), float(rng.normal() + t * 0.1 + x * 0.05), 1.0))
    # two groups of treatments that share no x
    rows += [("h", f"t{t}", f"x{x}", 3, float(rng.normal()), 1.0) for t in range(6) for x in range(4 * (t % 2), 4 * (t % 2) + 3)]
    table = spark.createDataFrame(rows, "family string, treatment string, x string, n long, mean double, ss double").cache()
    dense = {r.family: r for r in L._dense_given_x(table).collect()}
    turned = {r.family: r for r in L._from_x_given_treatment(table).collect()}
    steps = {r.family: r for r in L.gradient_given_x(table).collect()}
    assert dense.keys() == steps.keys() == turned.keys()
    for f in dense:
        for other in (steps[f], turned[f]):
            assert other.ss_t_given_x == pytest.approx(dense[f].ss_t_given_x, rel=1e-9) and other.t_rank == dense[f].t_rank
    assert steps["h"].t_rank == 4


def test_twenty_thousand_levels_without_their_pairs(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("treatment"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("x")
    ).where("(treatment + x) % 7 > 0")
    y = F.sin(F.col("treatment") * 1.0) + F.col("x") * 0.5
    table = rows.select(F.lit("f").alias("family"), "treatment", "x", F.lit(2).cast("long").alias("n"), y.alias("mean"), F.lit(1.0).alias("ss")).cache()
    data = table.toPandas()  # no interaction: the cells' scatter is that of the two factors
    n, mean, t, x = (data[c].to_numpy() for c in ("n", "mean", "treatment", "x"))
    effect = np.zeros(20_000)
    for _ in range(200):  # treatment and x by turns
        by_x = np.bincount(x, n * (mean - effect[t])) / np.bincount(x, n)
        effect = np.bincount(t, n * (mean - by_x[x])) / np.bincount(t, n)
    fitted = effect[t] + by_x[x]
    alone = (np.bincount(x, n * mean) / np.bincount(x, n))[x]
    expected = (n * (fitted - np.average(mean, weights=n)) ** 2).sum() - (n * (alone - np.average(mean, weights=n)) ** 2).sum()
    for got in (L.treatment_given_x(table).first(), L.gradient_given_x(table).first()):
        assert got.t_rank == 19_999 and got.ss_t_given_x == pytest.approx(expected, rel=1e-7)


PAIRS = st.integers(2, 9).flatmap(
    lambda n: st.tuples(st.just(n), st.sets(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)).filter(lambda p: p[0] < p[1])))
)


def holds(groups, size, differing):
    own = [set(g) for g in groups]
    differing = set(differing)
    return all(own) and all(bool(own[i] & own[j]) == ((i, j) not in differing) for i in range(size) for j in range(i + 1, size))


@settings(max_examples=200, deadline=None)
@given(PAIRS)
def test_cliques_cover_exactly_the_pairs_that_do_not_differ(case):
    size, differing = case
    groups = K._cover_groups(size, sorted(differing))
    assert holds(K._numbers(groups, size), size, differing) and len(groups) <= size * size


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=12))
def test_a_run_over_ordered_means_equals_the_split(reach):
    size = len(reach)
    ends = [min(size - 1, max([i, *(k + r for k, r in enumerate(reach[: i + 1]))])) for i in range(size)]
    differing = [(i, j) for i in range(size) for j in range(ends[i] + 1, size)]
    split = K._split_groups(size, differing)
    assert K.assign_groups(size, differing) == K._numbers(split, size) == K.groups_of_ends(ends)


def test_disjoint_pairs_and_hundreds_of_levels_stay_few_groups():
    disjoint = [(2 * k, 2 * k + 1) for k in range(12)]  # a split would make 4,096 groups
    groups = K.assign_groups(24, disjoint)
    assert holds(groups, 24, disjoint) and 1 + max(map(max, groups)) <= 24 * 24
    ordered = [(i, j) for i in range(400) for j in range(i + 30, 400)]
    groups = K.assign_groups(400, ordered)
    assert holds(groups, 400, ordered) and 1 + max(map(max, groups)) == 371


@pytest.mark.parametrize("few", [256, 0])
def test_letters_of_groups_with_and_without_order(spark, monkeypatch, few):
    monkeypatch.setattr(K, "FEW_LEVELS", few)
    rows = [("o", t, float(m), 1.0) for t, m in enumerate([9, 8, 7, 4, 3, 0])]
    rows += [("u", t, float(m), s) for t, (m, s) in enumerate([(9, 0.1), (8, 9.0), (7, 0.1), (6, 0.1), (5, 9.0)])]  # errors that differ: no stretches
    table = spark.createDataFrame(rows, "family string, treatment int, emmean double, se double").withColumn("df", F.lit(50))
    contrasts = M.pairwise_contrasts(table, ["family"])
    shown = K.letter_groups(table, contrasts, ["family"]).collect()
    assert len(shown) == len(rows)
    own = {(r.family, r.treatment): set(r.letter_groups) for r in shown}
    for r in contrasts.collect():
        assert bool(own[r.family, r.level_a] & own[r.family, r.level_b]) == (r.p >= 0.05)


def test_pairs_do_not_depend_on_the_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(f, int(t), float(rng.normal()), 1.0, 100) for f, k in (("f", 37), ("g", 2), ("h", 1)) for t in range(k)]
    rows.append(("f", 99, None, None, 100))
    table = spark.createDataFrame(rows, "family string, treatment int, emmean double, se double, df long")
    one = sorted(map(tuple, M.pairwise_contrasts(table, ["family"]).collect()))
    assert len(one) == 37 * 36 // 2 + 1
    for block in (1, 5, 36):
        assert sorted(map(tuple, M.pairwise_contrasts(table, ["family"], block_levels=block).collect())) == one


def test_no_task_of_the_pairs_holds_a_family_whole(spark):
    table = spark.range(600).select(F.lit("f").alias("family"), F.col("id").alias("treatment"), F.rand(1).alias("emmean"), F.lit(1.0).alias("se"), F.lit(90).alias("df"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        pairs = M.pairwise_contrasts(table, ["family"], p_values=False, block_levels=60)
        sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sum(sizes) == 600 * 599 // 2 and max(sizes) < 0.25 * sum(sizes)


def test_levels_shipped_for_the_pairs_grow_no_faster_than_the_levels(spark):
    def shipped(levels):
        table = spark.range(levels).select(F.lit("f").alias("family"), F.col("id").alias("treatment"), F.rand(1).alias("emmean"), F.lit(1.0).alias("se"), F.lit(90).alias("df"))
        assert M.pairwise_contrasts(table, ["family"], p_values=False, block_levels=4).count() == levels * (levels - 1) // 2
        a, b, _ = M._dealt(table, ["family"], "treatment", "emmean", 4)
        return sum(side.agg(F.sum(F.size(rows))).first()[0] for side, rows in ((a, "_ra"), (b, "_rb")))

    assert shipped(1200) <= 2.1 * shipped(600) and shipped(600) <= 600 * (M.TILES + 2)


def test_pairs_of_levels_that_are_repeated_or_unknown(spark):
    rows = [("f", "b", 2.0, 1.0, 7), ("f", "b", 3.0, 1.0, 7), ("f", "a", 5.0, 2.0, 8), ("f", None, 1.0, 1.0, 7), (None, "c", 1.0, 1.0, 7)]
    table = spark.createDataFrame(rows, "family string, treatment string, emmean double, se double, df long")
    for block in (1, 9):
        got = M.pairwise_contrasts(table, ["family"], p_values=False, block_levels=block).select("level_a", "level_b", "difference", "df").collect()
        assert sorted(map(tuple, got)) == [("a", "b", 2.0, 8), ("a", "b", 3.0, 8)]
    assert M.pairwise_contrasts(table.limit(0), ["family"]).count() == 0


def test_many_levels_of_one_factor(spark):
    rows = spark.range(3000).select((F.col("id") % 150).alias("treatment"), (F.col("id") % 4).alias("x"), F.sin("id").alias("y"))
    table = cell_stats(rows, {"f": "y"}, "treatment", "x")
    many = {r.term: r.ss for r in L.anova_factorial(table.cache()).collect()}
    data = rows.toPandas()
    one = data.groupby("treatment").y.transform("mean")
    assert many["treatment"] == pytest.approx(((one - data.y.mean()) ** 2).sum(), rel=1e-9)


@pytest.fixture
def plain_shuffles(spark):
    """Joins as they come: nothing is broadcast or split but by the code's own hints."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _most_of_a_task(table):
    sizes = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes) if sum(sizes) >= 200 else 0.0


def _one_family(spark, treatments, xs):
    rows = spark.range(treatments * xs).where("id % 7 != 3")
    return rows.select(F.lit("f").alias("family"), (F.col("id") % treatments).alias("treatment"), F.expr(f"id div {treatments}").alias("x"), (1 + F.col("id") % 5).alias("n"), F.sin("id").alias("mean"), F.lit(1.0).alias("ss"))


def test_two_large_factors_of_one_family_never_meet_in_a_task(spark, plain_shuffles, monkeypatch):
    shares, cells = [], _one_family(spark, 300, 11).cache()
    write, between = L.materialize, L._between
    monkeypatch.setattr(L, "materialize", lambda df: shares.append(_most_of_a_task(out := write(df))) or out)
    monkeypatch.setattr(L, "_between", lambda c, *a: shares.append(_most_of_a_task(c)) or between(c, *a))
    got = L.treatment_given_x(cells, dense_levels=8).first()
    L.anova_factorial(cells).collect()
    assert len(shares) > 6 and max(shares) < 0.5
    dense = L._dense_given_x(cells).first()
    assert got.ss_t_given_x == pytest.approx(dense.ss_t_given_x, rel=1e-9) and got.t_rank == dense.t_rank


def test_many_levels_at_few_x_never_meet_in_a_task(spark, plain_shuffles, monkeypatch):
    shares, cells = [], _one_family(spark, 300, 3).cache()
    between = L._between
    monkeypatch.setattr(L, "_between", lambda c, *a: shares.append(_most_of_a_task(c)) or between(c, *a))
    got = L._from_x_given_treatment(cells).first()
    assert shares and max(shares) < 0.5
    dense = L._dense_given_x(cells).first()
    assert got.ss_t_given_x == pytest.approx(dense.ss_t_given_x, rel=1e-9) and got.t_rank == dense.t_rank


def test_rounds_of_the_gradients_ship_no_cells(spark, plain_shuffles, monkeypatch):
    plans, cells, write = [], _one_family(spark, 90, 70).cache(), L.materialize
    monkeypatch.setattr(L, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    got = L.gradient_given_x(cells).first()
    rounds = [p for p in plans if "rr0#" in p]
    assert len(rounds) > 3 and not any(re.search(r"hashpartitioning\([^)]*\bx#", p) for p in rounds)
    dense = L._dense_given_x(cells).first()
    assert got.ss_t_given_x == pytest.approx(dense.ss_t_given_x, rel=1e-9) and got.t_rank == dense.t_rank


@pytest.mark.parametrize("vector_row", [16, 1 << 40])
def test_effects_by_gradients_sent_to_blocks_or_joined_with_rows(spark, monkeypatch, vector_row):
    monkeypatch.setattr(L, "VECTOR_ROW", vector_row)
    one = _one_family(spark, 40, 9).where("treatment % 2 = x % 2")
    cells = one.unionByName(_one_family(spark, 30, 12).withColumn("family", F.lit("g")))
    cells = cells.withColumns({"treatment": F.format_string("t%s", "treatment"), "x": F.col("x").cast("double") - 2.5}).cache()
    want = {r.family: r for r in L._dense_effects(cells).collect()}
    turned = {r.family: r for r in L._turned_back(L._gradient_effects(L._turned(cells))).collect()}
    got = {r.family: r for r in L._gradient_effects(cells).collect()}
    assert got["f"].t_rank == 38 and got["g"].t_rank == 29
    for family, r in want.items():
        for name in ("ss_t", "a", "ss_x", "b", "ss_t_given_x", "t_rank"):
            assert got[family][name] == pytest.approx(r[name], rel=1e-9) and turned[family][name] == pytest.approx(r[name], rel=1e-9)


def test_blocks_of_cells_may_be_cut_between_any_two_x(monkeypatch):
    rng = np.random.default_rng(5)
    size = 400
    cells = {"family": rng.choice(["f", "g"], size), "x": rng.integers(0, 60, size), "id": rng.integers(0, 9, size).astype(np.int32), "n": rng.integers(1, 5, size).astype(float), "y": rng.normal(size=size)}
    batches = [pa.RecordBatch.from_pydict({k: v[i : i + 90] for k, v in cells.items()}) for i in range(0, size, 90)]

    def sums(block):
        monkeypatch.setattr(L, "BLOCK_CELLS", block)
        made = pa.Table.from_batches(L._made_blocks(iter(batches)))
        v, least = pa.array([rng.normal(size=9).tolist()] * len(made)), pa.array([list(range(9))] * len(made), pa.list_(pa.int32()))
        out = pa.Table.from_batches(L._sums_of_blocks(iter(made.append_column("v", v).append_column("least", least).combine_chunks().to_batches())))
        return len(made), sorted((tuple(map(str, (r["family"], r["id"], r["least"], r["b"]))), r["q"], r["ss_x"]) for r in out.to_pylist())

    (few, whole), (many, cut) = sums(1 << 20), sums(16)
    assert few == 2 and many > 10
    for a, b in zip(whole, cut, strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-9, abs=1e-9) and a[2] == pytest.approx(b[2], rel=1e-9)
    table = pd.DataFrame(cells)
    mean = table.assign(s=table.n * table.y).groupby(["family", "x"])[["s", "n"]].transform("sum")
    table["q"] = table.n * (table.y - mean.s / mean.n)
    assert whole[0][1] == pytest.approx(table[table.family == "f"].groupby("id").q.sum().tolist(), rel=1e-9, abs=1e-9)


def test_families_take_the_way_of_their_levels(spark, monkeypatch):
    taken, shapes = [], {"few": (5, 40), "thin": (40, 5), "wide": (15, 60), "tall": (60, 15)}
    for name in ("_dense_effects", "_gradient_effects"):
        solve = getattr(L, name)
        monkeypatch.setattr(L, name, lambda c, solve=solve, name=name: taken.append(name) or solve(c))
    tables = [_one_family(spark, *shape).withColumn("family", F.lit(name)) for name, shape in shapes.items()]
    cells = reduce(DataFrame.unionByName, tables).cache()
    got = {r.family: r for r in L._main_effects(cells, dense_levels=8).collect()}
    assert taken == ["_dense_effects"] * 2 + ["_gradient_effects"] * 2 and got.keys() == shapes.keys()
    for r in L._dense_effects(cells).collect():
        assert all(got[r.family][name] == pytest.approx(r[name], rel=1e-9) for name in ("ss_t", "a", "ss_x", "b", "ss_t_given_x", "t_rank"))
    assert L.anova_factorial(cells.limit(0)).count() == 0
