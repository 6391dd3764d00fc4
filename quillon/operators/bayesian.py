"""Bayesian counterparts: quadrature Bayes factors, Beta-binomial, BIC factors, A/B comparison."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import special as S
from quillon.operators.parametric import _only, anova_parts, fisher_z, need, t_from_moments, two, two_sample_from
from quillon.operators.regression import ols_from
from quillon.plans.stats import dicts, finish, gram, group_stats, moments, unpack_gram, var0

OUT = "test_name string, bf10 double, bf01 double, bf_label string, posterior_mean double, posterior_std double, ci_lower double, ci_upper double, ci_level double"


def bf_label(bf: float) -> str:
    bf = 1 / bf if 0 < bf < 1 else bf
    for bound, word in ((3, "anecdotal"), (10, "moderate"), (30, "strong"), (100, "very_strong")):
        if bf < bound:
            return word
    return "extreme"


def jzs_bf(t: float, n: float, r: float = 0.707) -> float:
    """Evidence by quadrature over g: (1 + ng)^-1/2 exp(t^2 ng / (2 (1 + ng))) weighted by 2 / (pi r (1 + g / r^2)), over the t density at t.

    The weight is not squared, so this is no proper prior; it is the factor this engine is defined by.
    """
    if abs(t) < 1e-10:
        return 1.0

    def inside(u: np.ndarray) -> np.ndarray:  # g = r^2 u^2 / (1 - u)^2 tames both ends
        g = (r * u / (1 - u)) ** 2
        e = t * t * n * g / (2 * (1 + n * g))
        like = np.where(e > 500, 0.0, np.exp(np.minimum(e, 500.0))) / np.sqrt(1 + n * g)
        return like * 2 / (math.pi * r) / (1 + g / r**2) * 2 * r * r * u / (1 - u) ** 3

    top, low = S.integrate(inside, 0.0, 1.0, 400), S.t_pdf(t, max(1.0, n - 1))
    return max(1e-10, top / low) if low > 0 and top > 0 else 1.0


def out(name: str, bf: float, mean: float, sd: float, ci: tuple[float, float], level: float, **more) -> dict:
    return dict(test_name=name, bf10=bf, bf01=1 / bf if bf > 0 else math.inf, bf_label=bf_label(bf), posterior_mean=mean, posterior_std=sd, ci_lower=ci[0], ci_upper=ci[1], ci_level=level) | more


def bayes_factor_shadow(t_statistic: float, n: int, prior_scale: float = 0.707) -> dict:
    bf = jzs_bf(t_statistic, n, prior_scale)
    return dict(bf10=bf, bf01=1 / bf if bf > 0 else math.inf, bf_label=bf_label(bf))


def bayesian_ttest_one_sample(df: DataFrame, value: str, mu: float = 0.0, prior_scale: float = 0.707, ci_level: float = 0.95, rope: tuple[float, float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    def close(r):
        w = t_from_moments("", r["n"], r["mean"], r["var"], mu, 0.05, ci_level)
        p = None
        if rope is not None and w["se"] > 0:
            p = S.t_sf((rope[0] - (r["mean"] - mu)) / w["se"], w["df"]) - S.t_sf((rope[1] - (r["mean"] - mu)) / w["se"], w["df"])
        return out("Bayesian one-sample t-test", jzs_bf(w["statistic"], r["n"], prior_scale), r["mean"], w["se"], (w["ci_lower"], w["ci_upper"]), ci_level, p_rope=p)

    return finish(moments(df, value, by), by, close, OUT + ", p_rope double")


def bayesian_ttest_two_sample(df: DataFrame, value: str, group: str, prior_scale: float = 0.707, ci_level: float = 0.95, labels: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    def close(r):
        a, b = two(dicts(r["g"]), labels)
        w = two_sample_from(a, b, False, 0.05, ci_level)
        return out("Bayesian two-sample t-test", jzs_bf(w["statistic"], a["n"] * b["n"] / (a["n"] + b["n"]), prior_scale), w["mean_diff"], w["se"], (w["ci_lower"], w["ci_upper"]), ci_level)

    return finish(group_stats(_only(df, group, labels), value, group, by), by, close, OUT)


def bayesian_proportion(df: DataFrame, success: str, prior_a: float = 1.0, prior_b: float = 1.0, ci_level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    stats = df.filter(F.col(success).isNotNull()).groupBy(*by).agg(F.sum(F.col(success).cast("int")).alias("k"), F.count("*").alias("n"))

    def close(r):
        a, b = prior_a + int(r["k"]), prior_b + int(r["n"]) - int(r["k"])
        low, prior = S.betainc(a, b, 0.5), S.betainc(prior_a, prior_b, 0.5)
        odds = (1 - low) / low / ((1 - prior) / prior) if low > 0 and prior > 0 else 1.0
        return out("Bayesian proportion", odds, a / (a + b), math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))), (S.beta_ppf((1 - ci_level) / 2, a, b), S.beta_ppf((1 + ci_level) / 2, a, b)), ci_level)

    return finish(stats, by, close, OUT)


def bayesian_correlation(df: DataFrame, x: str, y: str, ci_level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    def close(r):
        n, _, s = unpack_gram(r, 2)
        need(n >= 4, "at least 4 pairs are needed")
        rho = s[0, 1] / math.sqrt(s[0, 0] * s[1, 1])
        t = rho * math.sqrt((n - 2) / max(1 - rho * rho, 1e-300))
        return out("Bayesian correlation", jzs_bf(t, n), rho, (1 - rho * rho) / math.sqrt(n - 1), fisher_z(rho, n, ci_level), ci_level)

    return finish(gram(df, [x, y], by), by, close, OUT)


def bic_factor(n: int, rss_full: float, rss_null: float, k: int) -> float:
    if rss_null <= 0 or rss_full <= 0:
        return 1e200 if rss_full <= 0 < rss_null else 1.0
    e = -0.5 * (n * math.log(rss_full / rss_null) + k * math.log(n))
    return min(1e200, max(1e-10, math.exp(min(e, 460.0))))


def bayesian_anova(df: DataFrame, value: str, group: str, ci_level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    def close(r):
        a = anova_parts(dicts(r["g"]))
        eta = a["ss_between"] / a["ss_total"] if a["ss_total"] > 0 else 0.0
        return out("Bayesian ANOVA", bic_factor(a["n"], a["ss_within"], a["ss_total"], a["df_between"]), eta, None, (None, None), ci_level)

    return finish(group_stats(df, value, group, by), by, close, OUT)


def bayesian_regression(df: DataFrame, y: str, features: Sequence[str], ci_level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    def close(r):
        n, mean, s = unpack_gram(r, len(features) + 1)
        m = ols_from(n, mean, s, range(len(features)))
        return out("Bayesian regression", bic_factor(n, m["sse"], m["sst"], len(features)), m["r2"], None, (None, None), ci_level, coefficients=[float(c) for c in m["coef"]])

    return finish(gram(df, [*features, y], by), by, close, OUT + ", coefficients array<double>")


def bayesian_ab(df: DataFrame, value: str, group: str, prior_scale: float = 0.707, ci_level: float = 0.95, labels: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """P(B > A) under normal posteriors, uplift of B over A."""

    def close(r):
        a, b = two(dicts(r["g"]), labels)
        se = math.sqrt(var0(a) / a["n"] + var0(b) / b["n"])
        diff, z = b["mean"] - a["mean"], S.norm_ppf(0.5 + ci_level / 2)
        w = two_sample_from(b, a, False, 0.05, ci_level)
        bf = jzs_bf(w["statistic"], a["n"] * b["n"] / (a["n"] + b["n"]), prior_scale)
        return out("Bayesian A/B", bf, diff, se, (diff - z * se, diff + z * se), ci_level, p_b_better=S.norm_cdf(diff / se) if se > 0 else 0.5, uplift=diff / a["mean"] if a["mean"] else None)

    return finish(group_stats(_only(df, group, labels), value, group, by), by, close, OUT + ", p_b_better double, uplift double")
