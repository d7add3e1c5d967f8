import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from trialframe.operators import letters as K
from trialframe.operators import means as M
from trialframe.operators import windows as W
from trialframe.operators.cells import cell_stats

PAIRS = st.integers(1, 9).flatmap(
    lambda n: st.tuples(
        st.just(n),
        st.sets(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)).filter(lambda p: p[0] < p[1])),
    )
)


@settings(max_examples=300, deadline=None)
@given(PAIRS)
def test_levels_share_a_letter_exactly_when_they_do_not_differ(case):
    size, differing = case
    marks = [set(m) for m in K.assign_letters(size, list(differing))]
    assert all(marks)
    for i in range(size):
        for j in range(i + 1, size):
            assert bool(marks[i] & marks[j]) == ((i, j) not in differing)


def test_letters_of_a_chain():
    assert K.assign_letters(3, [(0, 2)]) == ["a", "ab", "b"]
    assert K.assign_letters(3, []) == ["a", "a", "a"]
    assert K.assign_letters(3, [(0, 1), (0, 2), (1, 2)]) == ["a", "b", "c"]


def estimates(spark, rows):
    return spark.createDataFrame(
        [("f", 1, t, m, s, 20) for t, m, s in rows],
        "family string, x int, treatment string, emmean double, se double, df long",
    )


def test_letters_and_their_use(spark):
    est = estimates(spark, [("a1", 1.0, 1.0), ("b1", 4.0, 1.0), ("c1", 7.0, 1.0)])
    con = M.pairwise_contrasts(est)
    lettered = K.letter_groups(est, con)
    got = {r.treatment: r.letters for r in lettered.collect()}
    assert got == {"c1": "a", "b1": "ab", "a1": "b"}
    assert {r.signif for r in K.signif_by_letters(lettered).collect()} == {"*"}
    flat = K.letter_groups(est.withColumn("emmean", F.lit(2.0)), M.pairwise_contrasts(est.withColumn("emmean", F.lit(2.0))))
    assert {r.signif for r in K.signif_by_letters(flat).collect()} == {""}
    assert {r.letters for r in K.blank_letters(flat).collect()} == {""}
    assert {r.letters for r in K.blank_letters(lettered).collect()} == {"a", "ab", "b"}


def test_contrasts_of_two_levels_are_t_tests(spark):
    from trialframe.functions.tails import t_two_sided

    est = estimates(spark, [("Cold", 6.11, 1.2), ("Room", 3.44, 1.4)])
    row = M.pairwise_contrasts(est).first()
    assert (row.level_a, row.level_b) == ("Cold", "Room")
    assert row.difference == pytest.approx(2.67)
    assert row.p == pytest.approx(float(t_two_sided(row.t, 20)), abs=1e-12)


def test_a_level_that_cannot_be_estimated_is_left_out(spark):
    est = estimates(spark, [("a", 1.0, 1.0), ("b", None, None), ("c", 2.0, 1.0)])
    con = M.pairwise_contrasts(est).collect()
    assert [(r.level_a, r.level_b, r.levels) for r in con] == [("a", "c", 2)]
    shown = K.letter_groups(est, M.pairwise_contrasts(est)).collect()
    assert {r.treatment for r in shown} == {"a", "c"}


def test_pairwise_matrix_layout(spark):
    est = estimates(spark, [("Cold", 6.11, 1.2), ("Room", 3.44, 1.4)])
    got = {(r.row, r.col): (r.kind, r.value) for r in M.pairwise_matrix(est, M.pairwise_contrasts(est)).collect()}
    assert got["Cold", "Cold"] == ("mean", 6.11)
    assert got["Room", "Cold"][0] == "difference" and got["Room", "Cold"][1] == pytest.approx(2.67)
    assert got["Cold", "Room"][0] == "p"


def test_limits_hold_the_stated_share(spark):
    from trialframe.functions.tails import t_two_sided

    df = spark.createDataFrame(
        [("A", 1, float(v)) for v in (1, 2, 4)] + [("B", 1, float(v)) for v in (3, 5, 9)],
        "treatment string, x int, y double",
    )
    for r in M.emmeans_cell(cell_stats(df, ["y"])).collect():
        assert t_two_sided((r.upper - r.emmean) / r.se, r.df) == pytest.approx(0.05, abs=1e-10)


def test_label_places(spark):
    est = estimates(spark, [("Cold", 6.0, 1.0), ("Room", 3.0, 2.0)])
    place = lambda how: {r.treatment: r.label_y for r in W.label_position(est, how).collect()}
    assert place("above") == {"Cold": 7.0, "Room": 8.0}
    assert place("below") == {"Cold": 2.0, "Room": 1.0}
    assert place("below_bar") == {"Cold": 1.0, "Room": 1.0}
    assert place("beside") == {"Cold": 7.5, "Room": 0.0}


def test_slopes(spark):
    from trialframe.operators.cells import line_moments

    rng = np.random.default_rng(5)
    rows = [(t, float(x), float(b * x + rng.normal(0, 0.1))) for t, b in (("A", 1.0), ("B", 3.0)) for x in range(20)]
    moments = line_moments(spark.createDataFrame(rows, "treatment string, x double, y double"), ["y"])
    slopes = M.trend_slopes(moments)
    tests = {r.treatment: r for r in M.trend_test(slopes).collect()}
    assert tests["B"].slope == pytest.approx(3.0, abs=0.05) and tests["B"].p < 1e-12
    assert M.trend_contrasts(slopes).first().difference == pytest.approx(-2.0, abs=0.05)


def test_many_levels_get_groups_that_tell_them_apart():
    differing = [(i, j) for i in range(120) for j in range(i + 1, 120) if j - i > 3]
    groups = [set(g) for g in K.assign_groups(120, differing)]
    assert all(bool(groups[i] & groups[j]) == (j - i <= 3) for i in range(120) for j in range(i + 1, 120))
    rng = np.random.default_rng(0)
    scattered = [(i, j) for i in range(60) for j in range(i + 1, 60) if rng.random() < 0.9]
    groups = [set(g) for g in K.assign_groups(60, scattered)]
    assert all(bool(groups[i] & groups[j]) == ((i, j) not in set(scattered)) for i in range(60) for j in range(i + 1, 60))
