import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.operators import curves as C
from trialframe.plans.curve_comparison import compare_curves
from trialframe.plans.growth_rates import growth_rate_report
from trialframe.sources import factor_grid


def cells(spark, curves, n=5, ss=0.5):
    """Exact cell means of the given functions: {(family, treatment): f}."""
    rows = [(f, t, int(x), n, float(fn(x)), ss) for (f, t), fn in curves.items() for x in range(1, 41)]
    return spark.createDataFrame(
        rows, "family string, treatment string, x int, n long, mean double, ss double"
    )


def logistic(a, m, s, c=0.0):
    return lambda x: c + a / (1 + np.exp((m - x) / s))


TWO = {("g", "Cold"): logistic(20, 15, 4), ("g", "Room"): logistic(26, 18, 5)}


def by_treatment(df):
    return {r.treatment: r for r in df.collect()}


def test_logistic_recovered_from_far_starts_and_self_start(spark):
    data = cells(spark, TWO)
    for fits in (
        C.fit_curve(data, C.LOGISTIC, {"asym": 10, "xmid": 25, "scal": 8}),
        C.logistic_self_start(data),
    ):
        got = by_treatment(fits)
        assert got["Cold"].asym == pytest.approx(20, rel=1e-7) and got["Cold"].xmid == pytest.approx(15, rel=1e-7)
        assert got["Room"].scal == pytest.approx(5, rel=1e-7)
        assert got["Room"].rss == pytest.approx(40 * 0.5) and got["Room"].n == 200


def test_many_fits_path_gives_the_same(spark, monkeypatch):
    data = cells(spark, TWO)
    few = by_treatment(C.logistic_self_start(data))
    monkeypatch.setattr(C, "fits_broadcast", lambda *a: False)
    many = by_treatment(C.logistic_self_start(data))
    for t in few:
        assert many[t].asym == pytest.approx(few[t].asym, rel=1e-8)
        assert many[t].rss == pytest.approx(few[t].rss, rel=1e-8)


def test_asymptotic_offset_and_shared(spark):
    asym = lambda x: 4 * (1 - np.exp(-np.exp(-2.0) * (x + 3)))
    got = C.fit_curve(cells(spark, {("t", "Cold"): asym}), C.ASYMPTOTIC, {"asym": 3, "lrc": -1.5, "c0": -1}).first()
    assert (got.asym, got.lrc, got.c0) == (pytest.approx(4), pytest.approx(-2), pytest.approx(-3))
    got = C.fit_curve(
        cells(spark, {("t", "Cold"): logistic(12, 20, 3, 4)}), C.LOGISTIC_OFFSET,
        {"asym": 10, "xmid": 18, "scal": 2, "offset": 3},
    ).first()
    assert (got.asym, got.offset) == (pytest.approx(12), pytest.approx(4))
    shared = {("g", "Cold"): logistic(20, 15, 4), ("g", "Room"): logistic(26, 15, 4)}
    got = C.fit_curve(
        cells(spark, shared), C.shared_logistic(["Cold", "Room"]),
        {"asym_Cold": 18, "asym_Room": 18, "xmid": 14, "scal": 3}, keys=["family"],
    ).first()
    assert (got.asym_Cold, got.asym_Room, got.xmid) == (pytest.approx(20), pytest.approx(26), pytest.approx(15))


def test_flat_or_missing_data_gives_nulls_and_spares_the_rest(spark):
    data = cells(spark, {("g", "flat"): lambda x: 0.0, ("g", "good"): logistic(20, 15, 4)})
    got = by_treatment(C.fit_curve(data, C.LOGISTIC, {"asym": 15, "xmid": 12, "scal": 3}, max_rounds=40))
    assert not got["flat"].converged or got["flat"].asym == pytest.approx(0, abs=1e-6)
    assert got["good"].converged and got["good"].asym == pytest.approx(20)
    one = cells(spark, {("g", "single"): logistic(20, 15, 4)}).where("x = 3")
    row = C.fit_curve(one, C.LOGISTIC, {"asym": 15, "xmid": 12, "scal": 3}).first()
    assert row.asym is None and row.converged is False
    failed = C.curve_error(C.fit_curve(one, C.LOGISTIC, {"asym": 15, "xmid": 12, "scal": 3})).first()
    assert failed.sigma is None


def test_planted_break_recovered(spark):
    broken = lambda b: lambda x: 10 + 2 * x - 1.5 * max(x - b, 0)
    data = cells(spark, {("v", "Cold"): broken(12.4), ("v", "Room"): broken(25.6)})
    got = by_treatment(C.segmented_fit(data, {"Cold": 16.0, "Room": 22.0}))
    assert got["Cold"]["break"] == pytest.approx(12.4, abs=1e-6)
    assert got["Room"]["break"] == pytest.approx(25.6, abs=1e-6)
    table = {(r.treatment, r.term): r.estimate for r in C.segment_table(C.segmented_fit(data, {"Cold": 16.0, "Room": 22.0})).collect()}
    assert table["Cold", "slope_after"] == pytest.approx(0.5, abs=1e-6)


def test_standard_errors_are_those_of_the_jacobian(spark):
    data = cells(spark, TWO)
    rows = {(r.treatment, r.param): r for r in C.curve_summary(C.logistic_self_start(data), C.LOGISTIC).collect()}
    x = np.arange(1, 41)
    for t, (a, m, s) in {"Cold": (20, 15, 4), "Room": (26, 18, 5)}.items():
        z = 1 / (1 + np.exp((m - x) / s))
        jac = np.column_stack([z, -a * z * (1 - z) / s, -a * z * (1 - z) * (x - m) / s**2])
        cov = np.linalg.inv(5 * jac.T @ jac) * (40.0 / (400 - 6))
        for i, p in enumerate(("asym", "xmid", "scal")):
            assert rows[t, p].se == pytest.approx(np.sqrt(cov[i, i]), rel=1e-6)
            assert rows[t, p].df == 394


def test_comparison_and_bands(spark):
    data = cells(spark, TWO)
    out = compare_curves(data, C.LOGISTIC, {"asym": 18, "xmid": 14, "scal": 4})
    test = out.test.first()
    assert test.lr_df == 3 and test.p < 1e-6
    contrast = {r.param: r.difference for r in out.contrasts.collect()}
    assert contrast["asym"] == pytest.approx(-6, rel=1e-6)
    assert {(r.param, r.term) for r in out.wald.collect()} >= {("xmid", "treatment"), ("scal", "(intercept)")}
    grid = factor_grid(data.select("treatment").distinct(), 1, 60)
    band = C.curve_conf_band(grid, out.full_fits, C.LOGISTIC).collect()
    assert len(band) == 120 and all(r.lower < r.fitted < r.upper for r in band)


def test_growth_rate_report(spark):
    data = cells(spark, TWO)
    grid = factor_grid(data.select("treatment").distinct(), 1, 40)
    predictions = C.predict_curve(grid, C.logistic_self_start(data), C.LOGISTIC).withColumnRenamed("fitted", "value")
    rows = growth_rate_report(predictions, "Cold", "Room").collect()
    assert len(rows) == 78
    assert max(r.relative_rate for r in rows) == 1.0
    assert all(r.relative_allocation == pytest.approx(1.0) for r in rows)
    one = next(r for r in rows if r.x == 20 and r.treatment == "Room")
    other = next(r for r in rows if r.x == 20 and r.treatment == "Cold")
    assert one.ratio == pytest.approx(one.rate / other.rate) and one.difference == pytest.approx(one.rate - other.rate)


def test_every_key_has_a_row_with_a_status(spark):
    def broken(x):
        return 3 + 2 * x - 1.5 * np.maximum(x - 9, 0)

    table = cells(spark, {("g", "p"): broken, ("g", "q"): broken})
    fits = C.segmented_fit(table, {"p": 10.0})
    got = by_treatment(fits)
    assert got["p"].status == "converged" and got["p"]["break"] == pytest.approx(9, rel=1e-4)
    assert got["q"].status == "no start" and got["q"]["break"] is None and got["q"].n == got["p"].n
    error = C.curve_error(fits).first()
    assert error.sigma is None
    short = by_treatment(C.fit_curve(table, C.LOGISTIC, {"asym": 1.0, "xmid": 1e6, "scal": 1e-3}, max_rounds=2))
    assert all(r.status in ("stalled", "rounds used up") and r.asym is None for r in short.values())


def test_comparison_writes_few_checkpoints(spark, monkeypatch):
    from trialframe.operators import curves
    from trialframe.plans import curve_comparison

    written = []
    plain = curves.materialize

    def counted(df):
        written.append(df)
        return plain(df)

    monkeypatch.setattr(curves, "materialize", counted)
    monkeypatch.setattr(curve_comparison, "materialize", counted)
    compare_curves(cells(spark, TWO), C.LOGISTIC, {"asym": 22.0, "xmid": 16.0, "scal": 4.5})
    assert len(written) <= 9
