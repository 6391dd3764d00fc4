"""Description, bootstrap, tolerance, multi-vari, components, multivariate tests, meta-analysis."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import special as S
from quillon.operators.parametric import need
from quillon.plans.stats import clean, dicts, finish, finite, frame, gram, group_stats, num, unpack_gram, value_table


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One grouped aggregate for the moments and exact percentiles, a second pass for the outlier count."""
    x = F.when(finite(value), num(value))
    q = F.percentile(x, [0.25, 0.5, 0.75])
    base = df.select(*by, num(value).alias(value)).groupBy(*by).agg(F.count(x).alias("n"), (F.count("*") - F.count(x)).alias("n_missing"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.var_samp(x).alias("variance"), q.alias("q"), F.min(x).alias("min"), F.max(x).alias("max"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"), F.mode(x).alias("mode"))
    iqr = F.col("q")[2] - F.col("q")[0]
    lim = base.select(*by, (F.col("q")[0] - 1.5 * iqr).alias("_lo"), (F.col("q")[2] + 1.5 * iqr).alias("_hi"))
    rows = clean(df, [value], by=by)
    both = rows.join(F.broadcast(lim), list(by)) if by else rows.crossJoin(F.broadcast(lim))
    outside = both.groupBy(*by).agg(F.sum(((F.col(value) < F.col("_lo")) | (F.col(value) > F.col("_hi"))).cast("long")).alias("n_outliers"))
    full = base.join(outside, list(by), "left") if by else base.crossJoin(F.broadcast(outside))
    skewed = F.when(F.abs("skewness") < 0.5, "approximately symmetric").when(F.col("skewness") > 0, "right-skewed").otherwise("left-skewed")
    tails = F.when(F.col("kurtosis") > 1, ", heavy-tailed").when(F.col("kurtosis") < -1, ", light-tailed").otherwise("")
    q1, q2, q3 = F.col("q")[0], F.col("q")[1], F.col("q")[2]
    return full.select(*by, "n", "n_missing", "mean", "std", (F.col("std") / F.sqrt("n")).alias("se_mean"), "variance", q2.alias("median"), "mode", q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"), "min", "max", (F.col("max") - F.col("min")).alias("range"), "skewness", "kurtosis", F.when(F.col("mean") != 0, 100 * F.col("std") / F.abs("mean")).alias("cv"), "n_outliers", F.concat(skewed, tails).alias("shape_description"))


CHUNK = 4096  # places of the sorted sample that are drawn together
BLOCK = 500  # replicates that share a random stream


def bootstrap_ci(df: DataFrame, value: str, statistic: str = "mean", ci_level: float = 0.95, n_bootstrap: int = 10_000, seed: int = 42) -> DataFrame:
    """Percentile bootstrap, one form at every size: each replicate draws n of all n values with replacement.

    The sorted sample is cut into chunks of CHUNK places (a value with its count spans several where need be). How
    many of a replicate's draws fall into a chunk comes from binomial splits down a tree over the chunks, whose
    streams every task can repeat; inside a chunk places are drawn evenly, so the replicates are exactly multinomial.
    Each statistic is a mean of the replicate's ranks from lo to hi (or of squares), which chunks add up by themselves.
    """
    need(statistic in ("mean", "median", "std", "trimmed_mean"), f"unknown statistic {statistic}")
    rows = clean(df, [value]).select((F.col(value) + F.lit(0.0)).alias(value))  # an expression: value_table joins with itself
    n, centre = rows.agg(F.count("*"), F.avg(value)).first()
    need(n >= 2, "at least 2 observations are needed")
    cut = int(0.1 * n)
    lo, hi = {"median": ((n - 1) // 2, n // 2 + 1), "trimmed_mean": (cut, n - cut)}.get(statistic, (0, n))
    size, block = CHUNK, BLOCK
    chunks, blocks = -(-n // size), -(-n_bootstrap // block)
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    parts = min(blocks, -(-4 * slots // chunks))  # replicates are dealt out too while chunks are few
    t = value_table(rows, value).select(F.col(value).alias("x"), "cnt", "before", F.explode(F.sequence(F.floor(F.col("before") / size), F.floor((F.col("before") + F.col("cnt") - 1) / size))).alias("c"))
    held = t.select("c", "x", (F.least(F.col("before") + F.col("cnt"), (F.col("c") + 1) * size) - F.greatest("before", F.col("c") * size)).alias("k"))
    held = held.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("x", "k"))).alias("v")).select("c", F.col("v.x").alias("x"), F.col("v.k").alias("k"))
    tasks = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(max(1, min(chunks * parts, 4 * slots), chunks // 256))

    def share(c: int, b: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Of block b's m replicates: draws before chunk c, draws in it."""
        first, last, before, count = 0, chunks, np.zeros(m, np.int64), np.full(m, n, np.int64)
        while last - first > 1:
            mid = (first + last) // 2
            left = np.random.default_rng([seed, 0, b, first, last]).binomial(count, (mid - first) * size / (min(last * size, n) - first * size))
            if c < mid:
                last, count = mid, left
            else:
                first, before, count = mid, before + left, count - left
        return before, count

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for part in frames:
            for r in part.itertuples(index=False):
                x = np.repeat(np.asarray(r.x, float), np.asarray(r.k, np.int64)) - centre
                powers = np.stack([x, x * x])
                if r.part == 0:  # the sample itself, as replicate -1
                    at = np.arange(len(x)) + r.c * size
                    total[-1] = total.get(-1, 0) + powers[:, (at >= lo) & (at < hi)].sum(1)[:, None]
                for b in range(r.part, blocks, parts):
                    m = min(block, n_bootstrap - b * block)
                    before, count = share(r.c, b, m)
                    sums = total.setdefault(b, np.zeros((2, m)))
                    count = np.where((before < hi) & (before + count > lo), count, 0)  # the others add nothing
                    live = np.flatnonzero(count)
                    if not len(live):
                        continue
                    drawn = np.random.default_rng([seed, 1, b, r.c]).integers(0, len(x), count.sum())
                    w = np.bincount(np.repeat(np.arange(len(live)) * len(x), count[live]) + drawn, minlength=len(live) * len(x)).reshape(len(live), len(x))
                    edge = np.flatnonzero((before[live] < lo) | (before[live] + count[live] > hi))
                    run_ = w[edge].cumsum(1) + before[live][edge, None]
                    w[edge] = np.clip(run_, lo, hi) - np.clip(run_ - w[edge], lo, hi)
                    sums[:, live] += powers @ w.T
        for b, sums in total.items():
            yield pd.DataFrame({"b": b * block + np.arange(sums.shape[1]), "s1": sums[0], "s2": sums[1]})

    per = tasks.mapInPandas(run, "b long, s1 double, s2 double").groupBy("b").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    if statistic == "std":
        stat = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1))
    else:
        stat = F.col("s1") / (hi - lo) + F.lit(centre)
    low, high = (1 - ci_level) / 2, (1 + ci_level) / 2
    stats = per.select("b", stat.alias("s")).agg(F.percentile(F.expr("if(b >= 0, s, null)"), [low, high]).alias("q"), F.max(F.expr("if(b < 0, s, null)")).alias("e"))
    return finish(stats, (), lambda r: dict(statistic=statistic, estimate=r["e"], ci_lower=r["q"][0], ci_upper=r["q"][1], ci_level=ci_level, n_bootstrap=n_bootstrap, method="percentile"), "statistic string, estimate double, ci_lower double, ci_upper double, ci_level double, n_bootstrap long, method string")


def tolerance_interval(df: DataFrame, value: str, coverage: float = 0.95, confidence: float = 0.95, method: str = "normal", by: Sequence[str] = ()) -> DataFrame:
    lo, hi = (1 - coverage) / 2, (1 + coverage) / 2
    stats = clean(df, [value], by=by).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.percentile(value, [lo, hi]).alias("q"))

    def close(r):
        if method != "normal":
            return dict(lower=r["q"][0], upper=r["q"][1], coverage=coverage, confidence=confidence, k_factor=None, method="nonparametric")
        k = S.norm_ppf(hi) * math.sqrt((r["n"] - 1) / S.chi2_ppf(1 - confidence, r["n"] - 1)) * math.sqrt(1 + 1 / r["n"])
        return dict(lower=r["mean"] - k * r["sd"], upper=r["mean"] + k * r["sd"], coverage=coverage, confidence=confidence, k_factor=k, method="normal")

    return finish(stats, by, close, "lower double, upper double, coverage double, confidence double, k_factor double, method string")


def multi_vari(df: DataFrame, response: str, factors: Sequence[str]) -> DataFrame:
    """Between mean square per factor as a share of the total variance (shares may exceed 100)."""
    rows = clean(df, [response], factors)
    whole = rows.agg(F.var_samp(response).alias("v"), F.avg(response).alias("m"), F.count("*").alias("n")).first()
    out, used = [], 0.0
    for f in factors:
        g = dicts(group_stats(rows, response, f).first()["g"])
        ss = sum(x["n"] * (x["mean"] - whole["m"]) ** 2 for x in g)
        v = ss / (len(g) - 1) if len(g) > 1 else 0.0
        used += v
        out.append(dict(factor=f, variance=v, pct_contribution=100 * v / whole["v"] if whole["v"] else 0.0, n_levels=len(g)))
    within = max(0.0, whole["v"] - used)
    out.append(dict(factor="Within", variance=within, pct_contribution=100 * within / whole["v"] if whole["v"] else 0.0))
    top = max(out[:-1], key=lambda r: r["variance"])["factor"] if factors else None
    return frame(df, [r | dict(total_variance=whole["v"], grand_mean=whole["m"], dominant=r["factor"] == top) for r in out], "factor string, variance double, pct_contribution double, n_levels long, total_variance double, grand_mean double, dominant boolean")


def eigen(df: DataFrame, columns: Sequence[str], standardize: bool) -> tuple:
    n, mean, s = unpack_gram(gram(df, columns).first().asDict(), len(columns))
    cov = s / (n - 1)
    sd = np.sqrt(np.diag(cov)) if standardize else np.ones(len(columns))
    sd = np.where(sd > 0, sd, 1.0)
    val, vec = np.linalg.eigh(cov / np.outer(sd, sd))
    order = np.argsort(-val)
    val, vec = np.maximum(val[order], 0.0), vec[:, order]
    vec = vec * np.where(vec[np.abs(vec).argmax(0), range(len(val))] < 0, -1, 1)  # largest entry positive
    return n, mean, sd, val, vec


def pca(df: DataFrame, columns: Sequence[str], n_components: int | None = None, standardize: bool = True) -> DataFrame:
    n, _, _, val, vec = eigen(df, columns, standardize)
    share = val / val.sum() if val.sum() > 0 else val
    run = np.cumsum(share)
    k = min(n_components or len(columns), len(columns))
    return frame(df, [dict(component=i + 1, eigenvalue=val[i], variance_explained=share[i], cumulative_variance=run[i], loadings=[float(x) for x in vec[:, i] * math.sqrt(val[i])], n=n, p=len(columns)) for i in range(k)], "component long, eigenvalue double, variance_explained double, cumulative_variance double, loadings array<double>, n long, p long")


def pca_scores(df: DataFrame, columns: Sequence[str], n_components: int = 2, standardize: bool = True) -> DataFrame:
    _, mean, sd, _, vec = eigen(df, columns, standardize)
    rows = clean(df, columns, [c for c in df.columns if c not in columns])
    for k in range(n_components):
        score = F.lit(0.0)
        for i, c in enumerate(columns):
            score = score + (F.col(c) - F.lit(float(mean[i]))) / F.lit(float(sd[i])) * F.lit(float(vec[i, k]))
        rows = rows.withColumn(f"pc{k + 1}", score)
    return rows


def hotelling_t2_one_sample(df: DataFrame, columns: Sequence[str], mu: Sequence[float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    p = len(columns)

    def close(r):
        n, mean, s = unpack_gram(r, p)
        need(n > p, "more observations than variables are needed")
        d = mean - np.zeros(p) if mu is None else mean - np.asarray(mu, float)
        t2 = float(n * d @ np.linalg.pinv(s / (n - 1)) @ d)
        f = (n - p) / (p * (n - 1)) * t2
        return dict(t2_statistic=t2, f_statistic=f, p_value=S.f_sf(f, p, n - p), df1=p, df2=n - p)

    return finish(gram(df, columns, by), by, close, "t2_statistic double, f_statistic double, p_value double, df1 double, df2 double")


def one_way_manova(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    per = gram(df, columns, [group])
    p = len(columns)
    stats = per.groupBy().agg(F.collect_list(F.struct(*[c for c in per.columns if c != group])).alias("g"))

    def close(r):
        parts = [unpack_gram(x, p) for x in dicts(r["g"])]
        n, k = sum(x[0] for x in parts), len(parts)
        grand = sum(x[0] * x[1] for x in parts) / n
        W, B = sum(x[2] for x in parts), sum(x[0] * np.outer(x[1] - grand, x[1] - grand) for x in parts)
        lam = float(np.linalg.det(W) / np.linalg.det(W + B))
        pillai = float(np.trace(B @ np.linalg.pinv(W + B)))
        h, e = k - 1, n - k
        d1 = p * h
        den = p * p + h * h - 5
        t = math.sqrt((p * p * h * h - 4) / den) if den > 0 and p * p * h * h > 4 else 1.0
        d2 = (e + h - (p + h + 1) / 2) * t - p * h / 2 + 1
        f = 1e6 if lam < 1e-15 else (1 - lam ** (1 / t)) / lam ** (1 / t) * d2 / d1
        return dict(wilks_lambda=lam, f_statistic=f, p_value=S.f_sf(f, d1, d2), df1=d1, df2=d2, pillai_trace=pillai)

    return finish(stats, (), close, "wilks_lambda double, f_statistic double, p_value double, df1 double, df2 double, pillai_trace double")


def meta_analysis(df: DataFrame, effect: str, se: str, study: str, model: str = "random", ci_level: float = 0.95) -> DataFrame:
    """Pooled row (study null) and one row per study."""
    rows = clean(df, [effect, se], [study])
    w = F.lit(1.0) / F.pow(se, F.lit(2.0))
    s = rows.agg(F.count("*").alias("k"), F.sum(w).alias("w"), F.sum(w * F.col(effect)).alias("wy"), F.sum(w * F.pow(effect, F.lit(2.0))).alias("wyy"), F.sum(w * w).alias("w2"))

    def close(r):
        k = int(r["k"])
        q = max(0.0, r["wyy"] - r["wy"] ** 2 / r["w"])
        c = r["w"] - r["w2"] / r["w"]
        tau2 = max(0.0, (q - (k - 1)) / c) if model == "random" and c > 0 else 0.0
        return dict(k=k, q=q, tau2=tau2)

    base = finish(s, (), close, "k long, q double, tau2 double")
    z = S.norm_ppf(0.5 + ci_level / 2)
    full = rows.crossJoin(F.broadcast(base)).withColumn("w", F.lit(1.0) / (F.pow(se, F.lit(2.0)) + F.col("tau2")))
    pooled = full.groupBy("k", "q", "tau2").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col(effect)).alias("swy"))

    def total(r):
        e, s_ = r["swy"] / r["sw"], math.sqrt(1 / r["sw"])
        d = r["k"] - 1
        return dict(study=None, effect=e, se=s_, weight=1.0, ci_lower=e - z * s_, ci_upper=e + z * s_, model=model, pooled_z=e / s_, pooled_p=2 * S.norm_sf(abs(e / s_)), q_statistic=r["q"], q_p_value=S.chi2_sf(r["q"], d) if d else 1.0, i_squared=max(0.0, (r["q"] - d) / r["q"]) * 100 if r["q"] > 0 else 0.0, tau_squared=r["tau2"], k=r["k"])

    head = finish(pooled, (), total, "study string, effect double, se double, weight double, ci_lower double, ci_upper double, model string, pooled_z double, pooled_p double, q_statistic double, q_p_value double, i_squared double, tau_squared double, k long")
    each = full.crossJoin(F.broadcast(pooled.select("sw"))).select(F.col(study).cast("string").alias("study"), F.col(effect).alias("effect"), F.col(se).alias("se"), (F.col("w") / F.col("sw")).alias("weight"), (F.col(effect) - z * F.col(se)).alias("ci_lower"), (F.col(effect) + z * F.col(se)).alias("ci_upper"))
    return head.unionByName(each, allowMissingColumns=True)
