import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialframe.operators import least_squares as G
from trialframe.operators import linear as L
from trialframe.operators import means as M
from trialframe.operators.cells import cell_stats, line_moments, merge_cells


def make(levels, xs, size, seed=1, drop=0.0):
    """Random rows; unequal cell sizes when ``drop`` > 0."""
    rng = np.random.default_rng(seed)
    out = []
    for i, t in enumerate(levels):
        for x in xs:
            for _ in range(size):
                if rng.random() >= drop:
                    out.append((t, int(x), float(5 + i + 0.3 * x + 0.2 * i * x + rng.normal())))
    return pd.DataFrame(out, columns=["treatment", "x", "y"])


def rss(y, *columns):
    design = np.column_stack([np.ones(len(y)), *columns])
    return float(np.sum((y - design @ np.linalg.lstsq(design, y, rcond=None)[0]) ** 2))


def dummies(series):
    return [(series == v).to_numpy(float) for v in sorted(series.unique())[1:]]


def products(a, b):
    return [u * v for u in a for v in b]


def anova_dict(df):
    return {r.term: r for r in df.collect()}


@pytest.mark.parametrize("levels", [["Cold", "Room"], ["A", "B", "C", "D"]])
@pytest.mark.parametrize("first", ["treatment", "x"])
def test_factorial_anova_equals_nested_least_squares(spark, levels, first):
    data = make(levels, [0, 3, 7, 14], 5, drop=0.3)
    y, t, x = data.y.to_numpy(), dummies(data.treatment), dummies(data.x)
    got = anova_dict(L.anova_factorial(cell_stats(spark.createDataFrame(data), ["y"]), first))
    total, additive, full = rss(y), rss(y, *t, *x), rss(y, *t, *x, *products(t, x))
    one, other = (t, "x") if first == "treatment" else (x, "treatment")
    assert got[first].ss == pytest.approx(total - rss(y, *one), rel=1e-8)
    assert got[other].ss == pytest.approx(rss(y, *one) - additive, rel=1e-8)
    assert got["treatment:x"].ss == pytest.approx(additive - full, rel=1e-8)
    assert got["residual"].ss == pytest.approx(full, rel=1e-8)
    assert sum(r.df for r in got.values()) == len(y) - 1
    assert sum(r.ss for r in got.values()) == pytest.approx(total, rel=1e-8)


def test_factorial_anova_with_an_empty_cell(spark):
    data = make(["A", "B", "C"], [1, 2, 3], 4)
    data = data[~((data.treatment == "B") & (data.x == 2))]
    y, t, x = data.y.to_numpy(), dummies(data.treatment), dummies(data.x)
    got = anova_dict(L.anova_factorial(cell_stats(spark.createDataFrame(data), ["y"])))
    assert got["x"].ss == pytest.approx(rss(y, *t) - rss(y, *t, *x), rel=1e-8)
    assert got["treatment:x"].df == 3
    full = rss(y, *t, *x, *products(t, x))
    assert got["residual"].ss == pytest.approx(full, rel=1e-8)


def test_balanced_design_has_no_order(spark):
    cells = cell_stats(spark.createDataFrame(make(["A", "B"], [1, 2, 3], 4)), ["y"])
    a, b = (anova_dict(L.anova_factorial(cells, first)) for first in ("treatment", "x"))
    for term in ("treatment", "x", "treatment:x"):
        assert a[term].ss == pytest.approx(b[term].ss, rel=1e-9)


def test_ancova_anova_and_coefficients(spark):
    data = make(["Cold", "Room"], range(10), 4, drop=0.4)
    y, x = data.y.to_numpy(), data.x.to_numpy(float)
    room = (data.treatment == "Room").to_numpy(float)
    moments = line_moments(spark.createDataFrame(data), ["y"])
    got = anova_dict(L.anova_ancova(moments))
    steps = [rss(y), rss(y, x), rss(y, x, room), rss(y, x, room, x * room)]
    for term, before, after in zip(("x", "treatment", "x:treatment"), steps, steps[1:]):
        assert got[term].ss == pytest.approx(before - after, rel=1e-7)
    design = np.column_stack([np.ones(len(y)), x, room, x * room])
    inverse = np.linalg.inv(design.T @ design)
    beta = inverse @ design.T @ y
    sigma2 = steps[-1] / (len(y) - 4)
    coefs = {r.term: r for r in L.coef_summary(moments).collect()}
    for i, term in enumerate(["(intercept)", "x", "treatmentRoom", "x:treatmentRoom"]):
        assert coefs[term].estimate == pytest.approx(beta[i], rel=1e-8)
        assert coefs[term].se == pytest.approx(np.sqrt(sigma2 * inverse[i, i]), rel=1e-8)
    summary = L.model_summary(moments).first()
    assert summary.r2 == pytest.approx(1 - steps[-1] / steps[0], rel=1e-9)
    about_zero = L.model_summary(moments, with_intercept=False).first()
    assert about_zero.r2 == pytest.approx(1 - steps[-1] / np.sum(y**2), rel=1e-9)
    assert {r.term for r in L.ancova_no_intercept(moments).collect()} == {
        "x", "treatmentCold", "treatmentRoom", "x:treatmentRoom"
    }


def test_gram_fits_agree_with_numpy_and_with_each_other(spark):
    data = make(["Cold", "Room"], range(12), 5, drop=0.3)
    df = spark.createDataFrame(data).withColumn("family", F.lit("y"))
    x = F.col("x").cast("double")
    room = F.when(F.col("treatment") == "Room", 1.0).otherwise(0.0)
    terms = {"x": x, "x2": x * x, "x3": x * x * x, "room": room}
    nx = data.x.to_numpy(float)
    design = np.column_stack([np.ones(len(nx)), nx, nx**2, nx**3, (data.treatment == "Room").to_numpy(float)])
    beta = np.linalg.lstsq(design, data.y.to_numpy(), rcond=None)[0]
    raw = {r.term: r for r in G.gram_ols(df, "y", terms).collect()}
    cells = {r.term: r for r in G.gram_ols_cells(cell_stats(df, ["y"]), terms).collect()}
    for i, term in enumerate(["(intercept)", *terms]):
        assert raw[term].estimate == pytest.approx(beta[i], rel=1e-7)
        assert cells[term].estimate == pytest.approx(raw[term].estimate, rel=1e-8)
        assert cells[term].se == pytest.approx(raw[term].se, rel=1e-8)


def test_gram_sets_dependent_terms_aside(spark):
    df = spark.createDataFrame(make(["A"], range(5), 3)).withColumn("family", F.lit("y"))
    x = F.col("x").cast("double")
    got = {r.term: r for r in G.gram_ols(df, "y", {"x": x, "twice": x * 2}).collect()}
    alone = {r.term: r for r in G.gram_ols(df, "y", {"x": x}).collect()}
    assert got["twice"].aliased and got["twice"].estimate is None
    assert all(got[t].estimate == pytest.approx(alone[t].estimate) and got[t].se == pytest.approx(alone[t].se) for t in alone)


def test_gram_far_from_zero_keeps_its_digits(spark):
    data = make(["A"], range(8), 6)
    df = spark.createDataFrame(data).withColumn("family", F.lit("y"))
    x = F.col("x").cast("double")
    near = {r.term: r.estimate for r in G.gram_ols(df, "y", {"x": x, "x2": x * x}).collect()}
    far = x + 1e6
    moved = {r.term: r.estimate for r in G.gram_ols(df, "y", {"x": far}).collect()}
    plain = {r.term: r.estimate for r in G.gram_ols(df, "y", {"x": x}).collect()}
    assert moved["x"] == pytest.approx(plain["x"], rel=1e-6)
    assert near["x2"] is not None


def test_degenerate_inputs(spark):
    df = spark.createDataFrame(
        [("A", 1, 2.0), ("A", 2, 3.0), ("B", 1, 4.0)], "treatment string, x int, y double"
    )
    fit = L.cell_means_fit(cell_stats(df, ["y"])).first()
    assert fit.df == 0 and fit.sigma is None
    means = M.emmeans_cell(cell_stats(df, ["y"])).collect()
    assert len(means) == 3 and all(r.se is None and r.lower is None for r in means)
    # one x only: no slope for that treatment
    lines = {r.treatment: r.slope for r in L.ancova_fit(line_moments(df, ["y"])).collect()}
    assert lines["A"] == pytest.approx(1.0) and lines["B"] is None
    # equal values: no residual variance at all
    same = spark.createDataFrame([("A", 1, 2.0)] * 4 + [("B", 1, 2.0)] * 4, "treatment string, x int, y double")
    p = M.pairwise_contrasts(M.emmeans_cell(cell_stats(same, ["y"]))).first()
    assert p.difference == 0.0 and p.p is None


def test_missing_values_leave_the_model(spark):
    df = spark.createDataFrame(
        [("A", 1, 2.0, 1.0), ("A", 1, None, 3.0), (None, 1, 5.0, 5.0), ("A", None, 5.0, 5.0)],
        "treatment string, x int, y double, z double",
    )
    got = {r.family: (r.n, r.mean) for r in cell_stats(df, ["y", "z"]).collect()}
    assert got == {"y": (1, 2.0), "z": (2, 2.0)}


def test_statistics_do_not_depend_on_the_partitioning(spark):
    data = make(["A", "B", "C"], range(6), 20, drop=0.2)
    df = spark.createDataFrame(data)
    hot = df.withColumn("treatment", F.when(F.col("x") < 4, "A").otherwise(F.col("treatment")))
    for frame in (df, hot):
        one = cell_stats(frame.coalesce(1), ["y"]).orderBy("treatment", "x").collect()
        many = cell_stats(frame.orderBy(F.rand(3)).repartition(13), ["y"]).orderBy("treatment", "x").collect()
        for a, b in zip(one, many):
            assert a.n == b.n and a.mean == pytest.approx(b.mean) and a.ss == pytest.approx(b.ss)
    merged = merge_cells(cell_stats(df, ["y"]), ["family"]).first()
    assert merged.ss == pytest.approx(float(((data.y - data.y.mean()) ** 2).sum()), rel=1e-10)


def test_information_criteria_and_nested_test(spark):
    data = make(["Cold", "Room"], range(10), 3)
    y, x = data.y.to_numpy(), data.x.to_numpy(float)
    fit = L.simple_regression(line_moments(spark.createDataFrame(data), ["y"], treatment=None))
    row = L.information_criteria(fit.withColumn("parameters", F.lit(2))).first()
    n = len(y)
    loglik = -n / 2 * (np.log(2 * np.pi * rss(y, x) / n) + 1)
    assert row.aic == pytest.approx(-2 * loglik + 6) and row.bic == pytest.approx(-2 * loglik + 3 * np.log(n))


def test_one_day_treatment_takes_one_parameter(spark):
    rows = [("A", x, 1.0 * x + e) for x in range(4) for e in (-1.0, 0.5, 0.5)] + [("B", 2, y) for y in (1.0, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "treatment string, x int, y double")
    data = df.toPandas()
    own = [data[data.treatment == t] for t in "AB"]
    expected = rss(own[0].y.to_numpy(), own[0].x.to_numpy(float)) + rss(own[1].y.to_numpy())
    fit = L.ancova_fit(line_moments(df, ["y"])).first()
    assert fit.rss == pytest.approx(expected) and fit.df == 12
    assert fit.sigma == pytest.approx((expected / 12) ** 0.5)
    table = anova_dict(L.anova_ancova(line_moments(df, ["y"])))
    assert table["residual"].df == 12 and table["residual"].ss == pytest.approx(expected)
    assert table["x:treatment"].df == 0 and table["x:treatment"].f is None
    assert sum(r.df for r in table.values()) == 14


def test_exact_lines_leave_no_nan(spark):
    rows = [(t, x, 0.1 * x + (t == "B")) for t in "AB" for x in range(7)]
    df = spark.createDataFrame(rows, "treatment string, x int, y double")
    fit = L.ancova_fit(line_moments(df, ["y"])).first()
    assert fit.rss >= 0 and fit.sigma == pytest.approx(0, abs=1e-6)


def test_rare_level_keeps_its_dimension(spark):
    big, rows = 10**10, []
    for x, shift in ((1, 0.0), (2, 1.0)):
        rows += [("y", "A", x, big, shift), ("y", "B", x, big, shift), ("y", "C", x, 5, shift + 3.0)]
    cells = spark.createDataFrame(rows, "family string, treatment string, x int, n long, mean double")
    got = L.treatment_given_x(cells.withColumn("ss", F.lit(0.0))).first()
    assert got.t_rank == 2 and got.ss_t_given_x == pytest.approx(90.0, rel=1e-6)


def test_nan_is_a_missing_value(spark):
    nan = float("nan")
    df = spark.createDataFrame([("A", 1.0, 1.0), ("A", 1.0, nan), ("A", 1.0, 3.0), ("A", nan, 9.0)], "treatment string, x double, y double")
    (cell,) = cell_stats(df, ["y"]).collect()
    assert (cell.n, cell["mean"]) == (2, 2.0)
    assert line_moments(df, ["y"]).first().n == 2


def test_segments_are_families(spark):
    df = spark.createDataFrame([("s", "A", 1, 1.0), ("s", "A", 1, 3.0), ("t", "A", 1, 9.0), (None, "A", 1, 5.0)], "part string, treatment string, x int, y double")
    named = {r.family: r["mean"] for r in cell_stats(df, ["y"], segment="part").collect()}
    assert named == {"y:s": 2.0, "y:t": 9.0}
    alone = {r.family: r.y_mean for r in line_moments(df, {"": "y"}, segment="part").collect()}
    assert alone == {"s": 2.0, "t": 9.0}
