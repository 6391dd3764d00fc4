"""Ordered series: autocorrelation, decomposition, anomalies, segmentation, stationarity, causality, forecasts.

Positions come from stats.ordered(). Lags and trailing frames are taken in blocks of positions that carry a
short context from the block before, so a long series is never one task; only the sequential fitters
(segmentation, BOCPD, ARIMA, regimes) take a series whole, one task per series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import special as S
from quillon.operators.parametric import need
from quillon.operators.regression import ols_from
from quillon.plans.stats import BLOCK, clean, finish, frame, gram, ordered, running, unpack_gram

def positioned(df: DataFrame, values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """pos and the values as doubles, rows with missing values left out."""
    return ordered(clean(df, values, order), order).select("pos", *values)


def blocked(rows: DataFrame, before: int, after: int = 0) -> DataFrame:
    """Rows with a block number, repeated as context (`ctx`) in the blocks that look back (or ahead) to them."""
    size = max(BLOCK, before, after)
    b = F.floor(F.col("pos") / size)
    at = F.pmod(F.col("pos"), F.lit(size))
    copies = F.array(F.struct(b.alias("block"), F.lit(False).alias("ctx")))
    if before:
        copies = F.concat(copies, F.when(at >= size - before, F.array(F.struct((b + 1).alias("block"), F.lit(True).alias("ctx")))).otherwise(F.array()))
    if after:
        copies = F.concat(copies, F.when((at < after) & (b > 0), F.array(F.struct((b - 1).alias("block"), F.lit(True).alias("ctx")))).otherwise(F.array()))
    return rows.withColumn("_c", F.explode(copies)).select("*", "_c.block", "_c.ctx").drop("_c")


def with_lags(rows: DataFrame, value: str, lags: Sequence[int], prefix: str = "lag") -> DataFrame:
    w = Window.partitionBy("block").orderBy("pos")
    out = blocked(rows, max(lags))
    for k in lags:
        out = out.withColumn(f"{prefix}{k}", F.lag(value, k).over(w))
    return out.filter(~F.col("ctx")).drop("block", "ctx")


def acf_pacf(df: DataFrame, value: str, order: Sequence[str], n_lags: int = 20, ljung_box_lag: int | None = None) -> DataFrame:
    """A row per lag: acf, pacf, significance, with the bound, Ljung-Box p and suggested orders beside them."""
    rows = positioned(df, [value], order)
    m = rows.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).first()
    n = m["n"]
    need(n >= 10, "at least 10 observations are needed")
    n_lags = min(n_lags, n // 2 - 1)
    d = rows.withColumn("_d", F.col(value) - F.lit(m["mean"]))
    lagged = with_lags(d, "_d", range(1, n_lags + 1))
    s = lagged.agg(F.sum(F.col("_d") * F.col("_d")).alias("s0"), *(F.sum(F.col("_d") * F.col(f"lag{k}")).alias(f"s{k}") for k in range(1, n_lags + 1)))
    lb = min(ljung_box_lag or min(10, n // 5), n_lags)

    def close(r):
        acf = [1.0] + [r[f"s{k}"] / r["s0"] for k in range(1, n_lags + 1)]
        pacf, phi = [1.0], np.zeros(0)
        for k in range(1, n_lags + 1):
            top = acf[k] - sum(phi[j] * acf[k - 1 - j] for j in range(k - 1))
            a = top / (1 - sum(phi[j] * acf[j + 1] for j in range(k - 1)))
            phi = np.r_[phi - a * phi[::-1], a]
            pacf.append(float(a))
        bound = 1.96 / math.sqrt(n)
        sig = [[k for k in range(1, n_lags + 1) if abs(v[k]) > bound] for v in (acf, pacf)]
        q = n * (n + 2) * sum(acf[k] ** 2 / (n - k) for k in range(1, lb + 1))
        more = dict(confidence_bound=bound, ljung_box_p=S.chi2_sf(q, lb), suggested_p=min(max(sig[1], default=0), 5), suggested_q=min(max(sig[0], default=0), 5))
        return [dict(lag=k, acf=acf[k], pacf=pacf[k], significant_acf=k in sig[0], significant_pacf=k in sig[1]) | more for k in range(n_lags + 1)]

    return finish(s, (), close, "lag long, acf double, pacf double, significant_acf boolean, significant_pacf boolean, confidence_bound double, ljung_box_p double, suggested_p long, suggested_q long")


def cross_correlation(df: DataFrame, x: str, y: str, order: Sequence[str], max_lag: int = 20) -> DataFrame:
    """Mean product of standardised values over the overlap at each lag; at lag k > 0 x leads y."""
    rows = positioned(df, [x, y], order)
    m = rows.agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy")).first()
    n = m["n"]
    max_lag = min(max_lag, n // 2 - 1)
    z = rows.select("pos", ((F.col(x) - m["mx"]) / (m["sx"] or 1.0)).alias("zx"), ((F.col(y) - m["my"]) / (m["sy"] or 1.0)).alias("zy"))
    w = Window.partitionBy("block").orderBy("pos")
    b = blocked(z, max_lag)
    lags = range(1, max_lag + 1)
    for k in lags:
        b = b.withColumn(f"x{k}", F.lag("zx", k).over(w)).withColumn(f"y{k}", F.lag("zy", k).over(w))
    s = b.filter(~F.col("ctx")).agg(F.avg(F.col("zx") * F.col("zy")).alias("c0"), *(F.avg(F.col(f"x{k}") * F.col("zy")).alias(f"p{k}") for k in lags), *(F.avg(F.col("zx") * F.col(f"y{k}")).alias(f"n{k}") for k in lags))

    def close(r):
        v = {0: r["c0"]} | {k: r[f"p{k}"] for k in lags} | {-k: r[f"n{k}"] for k in lags}
        bound, peak = 2 / math.sqrt(n), max(v, key=lambda k: abs(v[k]))
        says = "x and y move together" if peak == 0 else f"x leads y by {peak}" if peak > 0 else f"y leads x by {-peak}"
        return [dict(lag=k, ccf=v[k], significant=abs(v[k]) > bound, confidence_bound=bound, peak_lag=peak, peak_value=v[peak], interpretation=says) for k in sorted(v)]

    return finish(s, (), close, "lag long, ccf double, significant boolean, confidence_bound double, peak_lag long, peak_value double, interpretation string")


def classical_decompose(df: DataFrame, value: str, order: Sequence[str], period: int = 12, model: str = "additive") -> DataFrame:
    """pos, observed, trend (centred moving average), seasonal (centred periodic means), residual."""
    rows = positioned(df, [value], order)
    half = period // 2
    w = Window.partitionBy("block").orderBy("pos").rowsBetween(-half, half)
    b = blocked(rows, half, half)
    total, n = F.sum(value).over(w), F.count("*").over(w)
    if period % 2 == 0:
        ends = Window.partitionBy("block").orderBy("pos")
        total = total - (F.lag(value, half).over(ends) + F.lead(value, half).over(ends)) / 2
    t = b.withColumn("trend", F.when(n == 2 * half + 1, total / period)).filter(~F.col("ctx"))
    detrended = F.col(value) / F.col("trend") if model == "multiplicative" else F.col(value) - F.col("trend")
    t = t.withColumn("_s", detrended).withColumn("_k", F.pmod("pos", F.lit(period)))
    means = t.groupBy("_k").agg(F.avg("_s").alias("_m"))
    overall = means.agg(F.avg("_m").alias("_g"))
    centred = means.crossJoin(F.broadcast(overall)).select("_k", (F.col("_m") / F.col("_g") if model == "multiplicative" else F.col("_m") - F.col("_g")).alias("seasonal"))
    out = t.join(F.broadcast(centred), "_k")  # `period` rows
    rest = F.col(value) / (F.col("trend") * F.col("seasonal")) if model == "multiplicative" else F.col(value) - F.col("trend") - F.col("seasonal")
    return out.select("pos", F.col(value).alias("observed"), "trend", "seasonal", rest.alias("residual"))


def decomposition_summary(decomposed: DataFrame) -> DataFrame:
    s = decomposed.agg(F.var_pop("trend").alias("t"), F.var_pop("seasonal").alias("s"), F.var_pop("residual").alias("r"), F.min_by("trend", F.when(F.col("trend").isNotNull(), F.col("pos"))).alias("a"), F.max_by("trend", F.when(F.col("trend").isNotNull(), F.col("pos"))).alias("b"))

    def close(x):
        strength = lambda v: max(0.0, 1 - x["r"] / (v + x["r"])) if v + x["r"] > 0 else 0.0
        change = x["b"] - x["a"]
        flat = abs(change) < 0.01 * abs(x["a"]) if x["a"] else abs(change) < 0.01
        return dict(seasonal_strength=strength(x["s"]), trend_strength=strength(x["t"]), trend_direction="flat" if flat else "upward" if change > 0 else "downward", trend_change=change)

    return finish(s, (), close, "seasonal_strength double, trend_strength double, trend_direction string, trend_change double")


def anomaly_scores(df: DataFrame, value: str, order: Sequence[str], window: int = 20, threshold: float = 3.0, method: str = "adaptive") -> DataFrame:
    """pos, value, score, is_anomaly. adaptive: against the `window` points before; the first three score 0."""
    rows = positioned(df, [value], order)
    if method == "zscore":
        m = rows.agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
        sd = F.when(F.col("_sd") < 1e-15, 1.0).otherwise(F.col("_sd"))
        out = rows.crossJoin(F.broadcast(m)).withColumn("score", F.abs(F.col(value) - F.col("_mu")) / sd)
    else:
        w = Window.partitionBy("block").orderBy("pos").rowsBetween(-window, -1)
        b = blocked(rows, window).withColumn("_mu", F.avg(value).over(w)).withColumn("_sd", F.stddev_samp(value).over(w)).filter(~F.col("ctx"))
        sd = F.when(F.col("_sd") >= 1e-15, F.col("_sd")).when(F.abs("_mu") > 0, F.abs("_mu") * 0.01).otherwise(1.0)
        out = b.withColumn("score", F.when(F.col("pos") < 3, 0.0).otherwise(F.abs(F.col(value) - F.col("_mu")) / sd))
    return out.select("pos", F.col(value).alias("value"), "score", (F.col("score") > threshold).alias("is_anomaly"))


def per_series(df: DataFrame, values: Sequence[str], order: Sequence[str], by: Sequence[str], fn, schema: str) -> DataFrame:
    """fn(matrix of the series in order) -> list of dicts, one task per series."""
    rows = clean(df, values, order, by).withColumn("_one", F.lit(0))
    keys = list(by) or ["_one"]
    head = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)
    names = [p.strip().split(" ")[0] for p in schema.split(",")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        made = pd.DataFrame(fn(pdf[list(values)].to_numpy(float)), columns=names)
        for i, b in enumerate(by):
            made.insert(i, b, key[i])
        return made

    return rows.groupBy(*keys).applyInPandas(run, f"{head}, {schema}" if head else schema)


def best_split(s1: np.ndarray, s2: np.ndarray, a: int, b: int, least: int) -> tuple[int, float]:
    """The split of [a, b) that takes most from the sum of squares, from prefix sums."""
    if b - a < 2 * least:
        return -1, 0.0
    k = np.arange(a + least, b - least + 1)
    sse = lambda i, j: s2[j] - s2[i] - (s1[j] - s1[i]) ** 2 / (j - i)
    gain = sse(np.array([a]), np.array([b])) - sse(np.full(len(k), a), k) - sse(k, np.full(len(k), b))
    i = int(gain.argmax())
    return (int(k[i]), float(gain[i])) if gain[i] > 0 else (-1, 0.0)


def segment(x: np.ndarray, penalty: float, least: int) -> list[int]:
    s1, s2 = np.r_[0.0, np.cumsum(x - x.mean())], np.r_[0.0, np.cumsum((x - x.mean()) ** 2)]
    found, work = [], [(0, len(x))]
    while work:
        a, b = work.pop()
        k, gain = best_split(s1, s2, a, b, least)
        if k >= 0 and gain > penalty:
            found.append(k)
            work += [(a, k), (k, b)]
    return sorted(found)


CHANGE = "index long, confidence double, mean_before double, mean_after double, magnitude double"


def change_rows(x: np.ndarray, points: Sequence[int], confidence: Sequence[float] | None = None) -> list[dict]:
    out = []
    for i, p in enumerate(points):
        a, b = x[max(0, p - 10) : p].mean() if p else 0.0, x[p : p + 10].mean()
        out.append(dict(index=p, confidence=None if confidence is None else confidence[i], mean_before=a, mean_after=b, magnitude=abs(b - a)))
    return out


def pelt(df: DataFrame, value: str, order: Sequence[str], penalty: str | float = "bic", min_size: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Mean shifts by binary segmentation on prefix sums; penalty ln(n) * variance, the variance from the differences' MAD."""

    def fn(m: np.ndarray) -> list[dict]:
        x = m[:, 0]
        if len(x) < 2 * min_size:
            return []
        d = np.diff(x)
        sigma = np.median(np.abs(d - np.median(d))) / 0.6745
        var = sigma**2 if sigma > 0 else x.var()
        cost = {"bic": math.log(len(x)) * var, "aic": 2 * var}.get(penalty, penalty)
        return change_rows(x, segment(x, float(cost), min_size))

    return per_series(df, [value], order, by, fn, CHANGE)


def bocpd_run(x: np.ndarray, hazard: float, mu: float | None, kappa: float, alpha: float, beta: float, cap: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(P(run length 0), most likely run length) per point, Normal-Gamma, vectorised over run lengths."""
    mu = float(x[:20].mean()) if mu is None else mu
    m, k, a, b = (np.array([v], float) for v in (mu, kappa, alpha, beta))
    prob, p0, mode = np.ones(1), np.zeros(len(x)), np.zeros(len(x), int)
    lg = np.vectorize(math.lgamma)
    for t, v in enumerate(x):
        df, scale = 2 * a, b * (k + 1) / (a * k)
        like = np.exp(lg((df + 1) / 2) - lg(df / 2) - 0.5 * np.log(df * math.pi * scale) - (df + 1) / 2 * np.log1p((v - m) ** 2 / (df * scale)))
        grow, change = prob * like * (1 - hazard), (prob * like * hazard).sum()
        prob = np.r_[change, grow][: cap + 1]
        prob = prob / prob.sum() if prob.sum() > 0 else np.r_[1.0, np.zeros(len(prob) - 1)]
        m, k, a, b = np.r_[mu, (k * m + v) / (k + 1)], np.r_[kappa, k + 1], np.r_[alpha, a + 0.5], np.r_[beta, b + k * (v - m) ** 2 / (2 * (k + 1))]
        m, k, a, b = (z[: cap + 1] for z in (m, k, a, b))
        p0[t], mode[t] = prob[0], int(prob.argmax())
    return p0, mode


def bocpd(df: DataFrame, value: str, order: Sequence[str], hazard_rate: float = 1 / 200, mu_prior: float | None = None, kappa_prior: float = 1.0, alpha_prior: float = 1.0, beta_prior: float = 1.0, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """A row per point: P(run length 0) (always the hazard rate under this model, so `detected` follows the threshold), the likeliest run length, and run_drop where it falls by more than half."""

    def fn(m: np.ndarray) -> list[dict]:
        p0, mode = bocpd_run(m[:, 0], hazard_rate, mu_prior, kappa_prior, alpha_prior, beta_prior)
        return [dict(pos=t, value=v, p_change=p0[t], detected=bool(t > 0 and p0[t] > threshold), map_run_length=int(mode[t]), run_drop=bool(t > 0 and mode[t] < mode[t - 1] / 2)) for t, v in enumerate(m[:, 0])]

    return per_series(df, [value], order, by, fn, "pos long, value double, p_change double, detected boolean, map_run_length long, run_drop boolean")


def lagged_gram(rows: DataFrame, target: str, columns: Sequence[str]) -> tuple:
    return unpack_gram(gram(rows, [*columns, target]).first().asDict(), len(columns) + 1)


def granger_causality(df: DataFrame, x: str, y: str, order: Sequence[str], max_lag: int = 4, alpha: float = 0.05) -> DataFrame:
    """Per lag the F-test of x's past in y's regression; each lag's rows are those with that much past."""
    rows = positioned(df, [x, y], order)
    lags = range(1, max_lag + 1)
    w = Window.partitionBy("block").orderBy("pos")
    b = blocked(rows, max_lag)
    for k in lags:
        b = b.withColumn(f"_y{k}", F.lag(y, k).over(w)).withColumn(f"_x{k}", F.lag(x, k).over(w))
    full = b.filter(~F.col("ctx"))
    out = []
    for k in lags:
        cols = [f"_y{i}" for i in range(1, k + 1)] + [f"_x{i}" for i in range(1, k + 1)]
        n, mean, s = lagged_gram(full, y, cols)
        u, r = ols_from(n, mean, s, range(2 * k)), ols_from(n, mean, s, range(k))
        d2 = n - 2 * k - 1
        f = (r["sse"] - u["sse"]) / k / (u["sse"] / d2) if d2 > 0 and u["sse"] > 0 else math.nan
        out.append(dict(lag=k, f_statistic=f, p_value=S.f_sf(f, k, d2), df1=k, df2=d2))
    best = min(out, key=lambda r: r["p_value"])
    return frame(df, [r | dict(significant=r["p_value"] < alpha, is_best=r is best) for r in out], "lag long, f_statistic double, p_value double, df1 long, df2 long, significant boolean, is_best boolean")


def detect_regimes(df: DataFrame, value: str, order: Sequence[str], n_regimes: int = 2, min_segment: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Half-overlapping windows described by mean, deviation and slope, clustered by seeded k-means, as runs of one label."""

    def fn(m: np.ndarray) -> list[dict]:
        x = m[:, 0]
        n = len(x)
        size = max(min_segment, n // 20)
        starts = list(range(0, n - size + 1, max(1, size // 2)))
        need(len(starts) >= n_regimes, "the series is too short")
        t = np.arange(size) - (size - 1) / 2
        feats = np.array([(x[s : s + size].mean(), x[s : s + size].std(), (t @ x[s : s + size]) / (t @ t)) for s in starts])
        span = np.where(np.ptp(feats, 0) > 0, np.ptp(feats, 0), 1.0)
        z = (feats - feats.min(0)) / span
        rng = np.random.RandomState(42)
        centre = z[rng.choice(len(z), n_regimes, replace=False)]
        for _ in range(100):
            lab = ((z[:, None] - centre[None]) ** 2).sum(-1).argmin(1)
            new = np.array([z[lab == k].mean(0) if (lab == k).any() else centre[k] for k in range(n_regimes)])
            if np.allclose(new, centre):
                break
            centre = new
        sd, names = x.std(), {}
        for k in range(n_regimes):
            f = feats[lab == k]
            if not len(f):
                names[k] = "stable"
            elif abs(f[:, 2].mean()) > 0.1 * sd:
                names[k] = "trending_up" if f[:, 2].mean() > 0 else "trending_down"
            else:
                names[k] = "volatile" if f[:, 1].mean() > 0.5 * sd else "stable"
        point = np.full(n, -1)
        for s, k in zip(starts, lab, strict=True):
            point[s : s + size] = k
        cuts = [0, *(np.flatnonzero(point[1:] != point[:-1]) + 1), n]
        return [dict(start=a, end=b, mean=x[a:b].mean(), std=x[a:b].std(), label=names.get(int(point[a]), "stable"), regime=int(point[a])) for a, b in zip(cuts, cuts[1:], strict=False)]

    return per_series(df, [value], order, by, fn, "start long, end long, mean double, std double, label string, regime long")


STATION = "test_name string, statistic double, p_value double, is_stationary boolean, lags long, n long, critical_1 double, critical_5 double, critical_10 double"


def adf_from(n_total: int, source: DataFrame, value: str, alpha: float) -> dict:
    """Augmented Dickey-Fuller with constant; lag by AIC on a common sample, one Gram scan at the largest lag and one at the chosen."""
    most = min(math.ceil(12 * (n_total / 100) ** 0.25), n_total // 2 - 2)
    w = Window.partitionBy("block").orderBy("pos")

    def rows(k: int) -> DataFrame:
        b = blocked(source, k + 1).withColumn("_l", F.lag(value, 1).over(w)).withColumn("_d", F.col(value) - F.col("_l"))
        for i in range(1, k + 1):
            b = b.withColumn(f"_d{i}", F.lag("_d", i).over(w))
        return b.filter(~F.col("ctx"))

    cols = ["_l", *(f"_d{i}" for i in range(1, most + 1))]
    n, mean, s = lagged_gram(rows(most), "_d", cols)
    aic = {}
    for k in range(most + 1):
        m = ols_from(n, mean, s, range(k + 1))
        aic[k] = n * math.log(max(m["sse"], 1e-300) / n) + 2 * m["p"]
    k = min(aic, key=aic.get)
    n, mean, s = lagged_gram(rows(k), "_d", cols[: k + 1])
    m = ols_from(n, mean, s, range(k + 1))
    tau = m["coef"][1] / math.sqrt(m["cov"][1, 1] * m["mse"]) if m["mse"] > 0 else -math.inf
    crit = {q: sum(c / n**i for i, c in enumerate(v)) for q, v in S.ADF_CRITICAL.items()}
    p = S.adf_p(tau)
    return dict(test_name="ADF", statistic=tau, p_value=p, is_stationary=p < alpha, lags=k, n=n, critical_1=crit["1%"], critical_5=crit["5%"], critical_10=crit["10%"])


def adf_test(df: DataFrame, value: str, order: Sequence[str], alpha: float = 0.05) -> DataFrame:
    rows = positioned(df, [value], order)
    n = rows.count()
    need(n >= 10, "at least 10 observations are needed")
    return frame(df, adf_from(n, rows, value, alpha), STATION)


def kpss_test(df: DataFrame, value: str, order: Sequence[str], regression: str = "c", alpha: float = 0.05) -> DataFrame:
    """Automatic bandwidth (Hobijn et al.); p interpolated in the table, clipped to [0.01, 0.1]."""
    rows = positioned(df, [value], order)
    n = rows.count()
    if regression == "ct":
        r = rows.agg(F.regr_slope(value, F.col("pos").cast("double")).alias("b"), F.regr_intercept(value, F.col("pos").cast("double")).alias("a")).first()
        e = rows.withColumn("_e", F.col(value) - (F.lit(r["a"]) + F.lit(r["b"]) * F.col("pos")))
    else:
        e = rows.withColumn("_e", F.col(value) - F.lit(rows.agg(F.avg(value)).first()[0]))
    cover = int(n ** (2 / 9))
    most = max(cover, 1)
    g = with_lags(e, "_e", range(1, most + 1)).agg(F.sum(F.col("_e") * F.col("_e")).alias("g0"), *(F.sum(F.col("_e") * F.col(f"lag{k}")).alias(f"g{k}") for k in range(1, most + 1))).first()
    s0, s1 = g["g0"] / n, 0.0
    for k in range(1, cover + 1):
        v = g[f"g{k}"] / (n / 2)
        s0, s1 = s0 + v, s1 + k * v
    band = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1) if s0 else 0
    long = g["g0"]
    if band:
        h = with_lags(e, "_e", range(1, band + 1)).agg(*(F.sum(F.col("_e") * F.col(f"lag{k}")).alias(f"g{k}") for k in range(1, band + 1))).first()
        long += 2 * sum((1 - k / (band + 1)) * h[f"g{k}"] for k in range(1, band + 1))
    eta = running(e, {"c": F.col("_e")}).agg(F.sum(F.col("c") * F.col("c"))).first()[0] / n**2
    stat = eta / (long / n) if long > 0 else 0.0
    p = float(np.interp(stat, S.KPSS_TABLE[regression], S.KPSS_P))
    c = S.KPSS_TABLE[regression]
    return frame(df, dict(test_name="KPSS", statistic=stat, p_value=p, is_stationary=p >= alpha, lags=band, n=n, critical_1=c[3], critical_5=c[1], critical_10=c[0]), STATION)


def auto_diff_order(df: DataFrame, value: str, order: Sequence[str], max_d: int = 2, alpha: float = 0.05) -> DataFrame:
    rows, out = positioned(df, [value], order), []
    for d in range(max_d + 1):
        n = rows.count()
        if n < 10:
            break
        out.append(adf_from(n, rows, value, alpha) | dict(d=d))
        if out[-1]["is_stationary"]:
            break
        rows = with_lags(rows, value, [1]).filter("lag1 IS NOT NULL").select((F.col("pos") - 1).alias("pos"), (F.col(value) - F.col("lag1")).alias(value))
    return frame(df, [r | dict(n_diffs_needed=out[-1]["d"]) for r in out], STATION + ", d long, n_diffs_needed long")


def poly_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.convolve(a, b)


def arma_fit(w: np.ndarray, p: int, q: int, P: int, Q: int, m: int, mean: bool) -> dict:
    """Exact Gaussian likelihood by a Kalman filter (concentrated variance), quasi-Newton with difference gradients."""
    k = p + q + P + Q + mean

    def polys(v: np.ndarray):
        ar = poly_mul(np.r_[1, -v[:p]], np.r_[1, *(-v[p + q + i] if (j := (s + 1) % m) == 0 else 0 for i in range(P) for s in range(m))] if P else np.ones(1))
        ma = poly_mul(np.r_[1, v[p : p + q]], np.r_[1, *(v[p + q + P + i] if (s + 1) % m == 0 else 0 for i in range(Q) for s in range(m))] if Q else np.ones(1))
        return -ar[1:], ma[1:]

    def filt(v: np.ndarray):
        ar, ma = polys(v)
        r = max(len(ar), len(ma) + 1)
        phi, theta = np.r_[ar, np.zeros(r - len(ar))], np.r_[1, ma, np.zeros(r - 1 - len(ma))]
        if len(ar) and np.abs(np.roots(np.r_[1, -ar])).max(initial=0) > 0.9995:
            return None
        T = np.zeros((r, r))
        T[:, 0] = phi
        T[:-1, 1:] += np.eye(r - 1)
        RR = np.outer(theta, theta)
        if r <= 6:
            V = np.linalg.solve(np.eye(r * r) - np.kron(T, T), RR.ravel()).reshape(r, r)
        else:  # doubling
            V, A = RR.copy(), T.copy()
            for _ in range(40):
                step = A @ V @ A.T
                V, A = V + step, A @ A
                if np.abs(step).max() < 1e-12 * np.abs(V).max():
                    break
        x, y = np.zeros(r), w - (v[-1] if mean else 0.0)
        e, f, steady = np.empty(len(y)), np.empty(len(y)), False
        for t in range(len(y)):
            if not steady:
                F0 = V[0, 0]
                K = T @ V[:, 0] / F0
                new = T @ V @ T.T + RR - np.outer(K, K) * F0
                steady = abs(new[0, 0] - F0) < 1e-12 and np.abs(new - V).max() < 1e-10
                V = new
            e[t], f[t] = y[t] - x[0], F0
            x = T @ x + K * e[t]
        s2 = float((e * e / f).mean())
        ll = -0.5 * (len(y) * (math.log(2 * math.pi * s2) + 1) + np.log(f).sum())
        return ll, e, s2, (T, x, V, theta)

    def cost(v: np.ndarray) -> float:
        got = filt(v)
        return 1e10 if got is None or got[0] != got[0] else -got[0]

    v = np.r_[np.full(p, 0.1), np.full(q, 0.1), np.full(P, 0.1), np.full(Q, 0.1), [w.mean()] * mean]
    scale = np.r_[np.ones(k - mean), [max(w.std(), 1e-6)] * mean] if k else np.zeros(0)
    H, c, g = np.eye(k), cost(v), None
    grad = lambda z: np.array([(cost(z + h) - cost(z - h)) / (2e-5) for h in np.eye(k) * 1e-5 * scale[:, None]]) if k else np.zeros(0)
    g = grad(v)
    for _ in range(100 if k else 0):
        step = -(H @ g)
        if g @ step > 0:
            H, step = np.eye(k), -g
        a = min(1.0, 0.5 / max(np.abs(step).max(), 1e-12))
        while a > 1e-8 and not cost(v + a * step * scale) < c + 1e-4 * a * (g @ step):
            a /= 2
        if a <= 1e-8:
            break
        new = v + a * step * scale
        c2, g2 = cost(new), grad(new)
        s, d = a * step, g2 - g
        if s @ d > 1e-12:
            rho = 1 / (s @ d)
            M = np.eye(k) - rho * np.outer(s, d)
            H = M @ H @ M.T + rho * np.outer(s, s)
        done = abs(c - c2) < 1e-9 * max(1.0, abs(c))
        v, c, g = new, c2, g2
        if done:
            break
    ll, e, s2, state = filt(v)
    return dict(v=v, ll=ll, e=e, s2=s2, state=state, k=k)


def forecast_series(x: np.ndarray, order, seasonal, steps: int, conf: float) -> list[dict]:
    (p, d, q), (P, D, Q, m) = order, seasonal
    w, heads = x.copy(), []
    for lag in [1] * d + [m] * D:
        heads.append((lag, w[-lag:]))
        w = w[lag:] - w[:-lag]
    mean = d + D == 0
    fit = arma_fit(w, p, q, P, Q, m, mean)
    T, state, V, theta = fit["state"]
    mu = fit["v"][-1] if mean else 0.0
    pred, z = [], state
    for _ in range(steps):
        pred.append(z[0] + mu)
        z = T @ z
    psi = [theta[0]]
    z = theta.copy()
    for _ in range(steps - 1):
        z = T @ z
        psi.append(z[0])
    out, psi = np.array(pred), np.array(psi)
    for lag, tail in reversed(heads):
        full = np.r_[tail, np.zeros(steps)]
        for i in range(steps):
            full[lag + i] = full[i] + out[i]
        out = full[lag:]
        for i in range(lag, steps):
            psi[i] += psi[i - lag]
    half = S.norm_ppf(0.5 + conf / 2) * np.sqrt(fit["s2"] * np.cumsum(psi**2))
    n, k = len(w), fit["k"] + 1
    e = fit["e"] - fit["e"].mean()
    lb = min(10, n // 5) or 1
    r = [float(e[j:] @ e[:-j] / (e @ e)) for j in range(1, lb + 1)]
    ljung = S.chi2_sf(n * (n + 2) * sum(a * a / (n - j) for j, a in enumerate(r, 1)), lb)
    names = [f"ar{i + 1}" for i in range(p)] + [f"ma{i + 1}" for i in range(q)] + [f"sar{i + 1}" for i in range(P)] + [f"sma{i + 1}" for i in range(Q)] + ["mean"] * mean
    more = dict(aic=-2 * fit["ll"] + 2 * k, bic=-2 * fit["ll"] + k * math.log(n), log_likelihood=fit["ll"], sigma2=fit["s2"], coefficients=[float(c) for c in fit["v"]], coefficient_names=names, ljung_box_p=ljung)
    return [dict(step=i + 1, predicted=o, ci_lower=o - h, ci_upper=o + h) | more for i, (o, h) in enumerate(zip(out, half, strict=True))]


FORECAST = "step long, predicted double, ci_lower double, ci_upper double, aic double, bic double, log_likelihood double, sigma2 double, coefficients array<double>, coefficient_names array<string>, ljung_box_p double"


def arima(df: DataFrame, value: str, order_by: Sequence[str], order: tuple[int, int, int] = (1, 1, 1), forecast_steps: int = 10, conf: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Exact likelihood on the differenced series; a row per forecast step with the fit beside it."""
    return sarima(df, value, order_by, order, (0, 0, 0, 1), forecast_steps, conf, by)


def sarima(df: DataFrame, value: str, order_by: Sequence[str], order: tuple[int, int, int] = (1, 1, 1), seasonal_order: tuple[int, int, int, int] = (1, 1, 1, 12), forecast_steps: int = 24, conf: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    return per_series(df, [value], order_by, by, lambda m: forecast_series(m[:, 0], order, seasonal_order, forecast_steps, conf), FORECAST)
