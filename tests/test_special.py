"""Distribution functions against Commons Math on Spark's class path, and against identities."""

import math

import numpy as np
import pytest

from quillon.functions import special as S


@pytest.fixture(scope="module")
def cm(spark):
    return spark._jvm.org.apache.commons.math3.distribution


@pytest.mark.parametrize("df", [1.0, 2.5, 10.0, 200.0])
def test_t(cm, df):
    d = cm.TDistribution(df)
    for x in (-5.0, -0.3, 0.0, 1.7, 12.0):
        assert S.t_sf(x, df) == pytest.approx(1 - d.cumulativeProbability(x), abs=1e-12)
    for p in (0.01, 0.5, 0.975):
        assert S.t_ppf(p, df) == pytest.approx(d.inverseCumulativeProbability(p), abs=1e-6)


def test_f_chi2_beta_gamma_binomial(cm):
    assert S.f_sf(2.3, 3, 17) == pytest.approx(1 - cm.FDistribution(3.0, 17.0).cumulativeProbability(2.3), abs=1e-12)
    assert S.chi2_sf(7.1, 4) == pytest.approx(1 - cm.ChiSquaredDistribution(4.0).cumulativeProbability(7.1), abs=1e-12)
    assert S.beta_ppf(0.3, 2.0, 5.0) == pytest.approx(cm.BetaDistribution(2.0, 5.0).inverseCumulativeProbability(0.3), abs=1e-7)
    assert S.gamma_cdf(3.0, 2.5, 1.4) == pytest.approx(cm.GammaDistribution(2.5, 1.4).cumulativeProbability(3.0), abs=1e-12)
    assert S.binom_cdf(3, 20, 0.2) == pytest.approx(cm.BinomialDistribution(20, 0.2).cumulativeProbability(3), abs=1e-12)
    assert S.hypergeom_pmf(2, 50, 7, 10) == pytest.approx(cm.HypergeometricDistribution(50, 7, 10).probability(2), abs=1e-12)


def test_noncentral_and_range():
    assert S.nct_sf(1.5, 12, 0.0) == pytest.approx(S.t_sf(1.5, 12), abs=1e-8)
    assert S.ncf_sf(2.0, 3, 20, 0.0) == pytest.approx(S.f_sf(2.0, 3, 20), abs=1e-12)
    assert S.ncx2_sf(5.0, 4, 0.0) == pytest.approx(S.chi2_sf(5.0, 4), abs=1e-12)
    # two groups: the range is sqrt(2) |t|; published 5 % points of q
    assert S.studentized_range_sf(math.sqrt(2) * 2.1, 2, 15) == pytest.approx(S.t_two(2.1, 15), abs=1e-7)
    assert S.studentized_range_ppf(0.95, 3, 10) == pytest.approx(3.877, abs=2e-3)
    assert S.studentized_range_ppf(0.95, 5, 20) == pytest.approx(4.232, abs=2e-3)
    assert S.dunnett_sf(2.1, [math.sqrt(0.5)], 15) == pytest.approx(S.t_two(2.1, 15), abs=1e-7)


def test_exact_nulls():
    from itertools import combinations, product

    u = [sum(i > j for i in c for j in set(range(7)) - set(c)) for c in combinations(range(7), 3)]
    assert S.mann_whitney_exact(10, 3, 4, "greater") == pytest.approx(np.mean([x >= 10 for x in u]))
    w = [sum(r for r, s in zip(range(1, 7), signs) if s) for signs in product((0, 1), repeat=6)]
    assert S.wilcoxon_exact(3, 6) == pytest.approx(min(1.0, 2 * np.mean([x <= 3 for x in w])))


def test_shapiro_and_adf():
    w, p = S.shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert (w, p) == pytest.approx((0.79, 0.0067), abs=2e-3)  # the textbook men's weights
    assert S.adf_p(-2.86154) == pytest.approx(0.05, abs=1e-3)
    assert S.ks_sf(0.274, 10) == pytest.approx(1 - 0.6284796154565043, abs=1e-9)  # Marsaglia, Tsang and Wang's example
