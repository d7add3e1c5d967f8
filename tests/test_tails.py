import math

import numpy as np
import pytest

from trialframe.functions import tails as T


@pytest.mark.parametrize(
    "t, df, p",
    [(2.0, 10, 0.07338803477074), (1.0, 1, 0.5), (12.706204736432095, 1, 0.05), (1.959963984540054, 1e12, 0.05)],
)
def test_t_published(t, df, p):
    assert T.t_two_sided(t, df) == pytest.approx(p, abs=1e-9)


@pytest.mark.parametrize("df", [1, 2, 3, 7, 30, 400, 9_999, 60_000, 2_000_000, 1e12])
def test_t_quantile_is_the_inverse(df):
    q = T.t_quantile([0.95, 0.5, 0.999], df)
    assert T.t_two_sided(q, df) == pytest.approx([0.05, 0.5, 0.001], abs=1e-9)


def test_t_by_integration():
    for df in (3, 17, 240):
        u = np.linspace(0, 2.3, 20001)
        density = np.exp(
            math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - (df + 1) / 2 * np.log1p(u * u / df)
        ) / math.sqrt(df * math.pi)
        h = u[1] - u[0]
        area = h / 3 * (density[0] + density[-1] + 4 * density[1:-1:2].sum() + 2 * density[2:-1:2].sum())
        assert T.t_two_sided(2.3, df) == pytest.approx(1 - 2 * area, abs=1e-10)


def test_large_df_forms_join_smoothly():
    for value in (0.3, 1.7, 4.0):
        below, above = T.t_two_sided(value, 99_990.0), T.t_two_sided(value, 100_010.0)
        assert below == pytest.approx(above, rel=1e-4, abs=1e-9)
        for d1 in (1, 6, 40):
            below, above = T.f_upper(value, d1, 99_990.0), T.f_upper(value, d1, 100_010.0)
            assert below == pytest.approx(above, rel=1e-3, abs=1e-9)


def test_f_and_chi2():
    assert T.f_upper(4.0, 1, 10) == pytest.approx(T.t_two_sided(2.0, 10), abs=1e-12)
    # closed forms: F(2, d) and chi-squared with 2 df
    assert T.f_upper(3.0, 2, 10) == pytest.approx((1 + 2 * 3.0 / 10) ** -5, abs=1e-12)
    assert T.chi2_upper(3.0, 2) == pytest.approx(math.exp(-1.5), abs=1e-13)
    assert T.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert T.chi2_upper(-1e-9, 3) == 1.0


def test_f_reciprocal_rule():
    assert T.f_upper(0.7, 5, 12) == pytest.approx(1 - T.f_upper(1 / 0.7, 12, 5), abs=1e-12)


def test_normal_cdf():
    x = np.linspace(-11, 11, 4001)
    exact = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    assert np.max(np.abs(T.normal_cdf(x) - exact)) < 1e-14


def test_range_of_two_is_t():
    for df in (3.0, 10.0, 59_986.0):
        q = np.array([0.5, 2.0, 3.5])
        general = T._range_upper_one_k(q, 2.0, np.full(3, df))
        assert general == pytest.approx(T.t_two_sided(q / math.sqrt(2), df), abs=1e-8)


def test_range_published_points():
    # five per cent points of the studentized range (infinite and 20 df)
    assert T.range_upper(3.314493, 3, 1e9)[0] == pytest.approx(0.05, abs=1e-6)
    assert T.range_upper(3.577935, 3, 20)[0] == pytest.approx(0.05, abs=1e-5)
    assert T.range_upper(4.170, 7, 1e9)[0] == pytest.approx(0.05, abs=1e-4)


def test_range_edges():
    out = T.range_upper([0.0, 200.0, np.nan], [4, 4, 4], [50, 50, 50])
    assert out[0] == pytest.approx(1.0, abs=1e-9) and out[1] < 1e-9 and np.isnan(out[2])
