"""Assumption checks, distribution fits, transforms, samples and chart specifications."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import special as S
from quillon.operators.parametric import anova_parts
from quillon.plans.blocks import percentiles
from quillon.plans.stats import clean, dicts, finish, frame, group_stats, moments, value_table

CHECK = "name string, test_name string, statistic double, p_value double, passed boolean, detail string, suggestion string"
SHAPIRO_MAX = 5000


def normality_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, sd, and from the value table the Anderson-Darling and Kolmogorov-Smirnov sums against the fitted normal."""
    m = moments(df, value, by)
    t = value_table(df, value, by=by)
    joined = t.join(m.select(*by, "n", "mean", F.sqrt("var").alias("sd")), list(by)) if by else t.crossJoin(F.broadcast(m.select("n", "mean", F.sqrt("var").alias("sd"))))
    z = (F.col(value) - F.col("mean")) / F.col("sd")
    erf = lambda x: F.expr(f"cast(java_method('org.apache.commons.math3.special.Erf', 'erfc', {x}) as double)")
    rows = joined.filter("sd > 0").withColumn("_z", z / F.lit(math.sqrt(2))).withColumn("_zn", -F.col("_z"))
    rows = rows.withColumn("_up", erf("_z") / 2).withColumn("_lo", erf("_zn") / 2)
    first = F.pow(F.col("before") + F.col("cnt"), 2) - F.pow(F.col("before"), 2)  # sum of 2i - 1 over the tie
    n, after = F.col("n"), F.col("n") - F.col("before") - F.col("cnt")
    last = F.pow(after + F.col("cnt"), 2) - F.pow(after, 2)
    tiny = 1e-300
    ad = F.sum(first * F.log(F.greatest(F.col("_lo"), F.lit(tiny))) + last * F.log(F.greatest(F.col("_up"), F.lit(tiny))))
    ks = F.max(F.greatest((F.col("before") + F.col("cnt")) / n - F.col("_lo"), F.col("_lo") - F.col("before") / n))
    sums = rows.groupBy(*by).agg(ad.alias("ad"), ks.alias("ks"))
    return m.join(sums, list(by), "left") if by else m.crossJoin(F.broadcast(sums))


def ad_statistic(r: dict) -> float:
    return -r["n"] - r["ad"] / r["n"] if r["ad"] is not None and r["ad"] == r["ad"] else math.nan


def ad_critical(n: int) -> float:
    return round(0.787 / (1 + 4 / n - 25 / n**2), 3)


def check_normality(df: DataFrame, value: str, label: str = "Data", alpha: float = 0.05, method: str = "auto", by: Sequence[str] = ()) -> DataFrame:
    """auto: Shapiro-Wilk up to 5000 values, else Anderson-Darling at 5 %."""
    stats = normality_stats(df, value, by)
    if method in ("auto", "shapiro"):
        sizes = clean(df, [value], by=by).groupBy(*by).agg(F.count("*").alias("_n"))
        small = clean(df, [value], by=by)
        small = small.join(sizes.filter(f"_n <= {SHAPIRO_MAX}"), list(by)) if by else small.crossJoin(F.broadcast(sizes)).filter(f"_n <= {SHAPIRO_MAX}")
        few = small.groupBy(*by).agg(F.collect_list(value).alias("x"))  # at most SHAPIRO_MAX values a group
        stats = stats.join(few, list(by), "left") if by else stats.crossJoin(F.broadcast(few))

    def close(r):
        n = int(r["n"])
        head = dict(name=f"{label}: normality")
        if n < 3:
            return head | dict(test_name="insufficient_data", passed=True, detail=f"n={n}")
        if method == "ks":
            p = S.ks_sf(r["ks"], n)
            return head | dict(test_name="Kolmogorov-Smirnov", statistic=r["ks"], p_value=p, passed=p > alpha, detail=f"D={r['ks']:.4f}")
        if method == "shapiro" or (method == "auto" and n <= SHAPIRO_MAX):
            w, p = S.shapiro(np.array(r["x"]))
            return head | dict(test_name="Shapiro-Wilk", statistic=w, p_value=p, passed=p > alpha, detail=f"W={w:.4f}", suggestion=None if p > alpha else "Consider a rank test or a transformation")
        a = ad_statistic(r)
        return head | dict(test_name="Anderson-Darling", statistic=a, passed=a < ad_critical(n), detail=f"A2={a:.4f}, 5% critical value {ad_critical(n)}")

    return finish(stats, by, close, CHECK)


def check_equal_variance(df: DataFrame, value: str, group: str, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    rows = clean(df, [value], [group], by)
    med = rows.groupBy(*by, group).agg(F.median(value).alias("_med"))
    z = rows.join(med, [*by, group]).withColumn("_z", F.abs(F.col(value) - F.col("_med")))
    spread = F.var_samp(value).alias("raw_var")
    per = z.groupBy(*by, group).agg(F.count("*").alias("n"), F.avg("_z").alias("mean"), F.var_samp("_z").alias("var"), spread)
    stats = per.groupBy(*by).agg(F.collect_list(F.struct("n", "mean", "var", "raw_var")).alias("g"))

    def close(r):
        g = dicts(r["g"])
        if len(g) < 2 or min(x["n"] for x in g) < 2:
            return dict(name="Equal variance", test_name="insufficient_data", passed=True)
        a = anova_parts(g)
        v = [x["raw_var"] for x in g]
        return dict(name="Equal variance", test_name="Levene", statistic=a["f"], p_value=a["p"], passed=a["p"] > alpha, detail=f"variance ratio {max(v) / min(v) if min(v) > 0 else math.inf:.2f}", suggestion=None if a["p"] > alpha else "Use Welch's test")

    return finish(stats, by, close, CHECK)


def check_outliers(df: DataFrame, value: str, label: str = "Data", method: str = "iqr", threshold: float = 1.5, by: Sequence[str] = ()) -> DataFrame:
    """Passes if fewer than a tenth lie outside the fences (or beyond `threshold` population deviations)."""
    rows = clean(df, [value], by=by)
    if method == "zscore":
        k = 3.0 if threshold == 1.5 else threshold
        lim = rows.groupBy(*by).agg((F.avg(value) - k * F.stddev_pop(value)).alias("lo"), (F.avg(value) + k * F.stddev_pop(value)).alias("hi"))
    else:
        q = F.percentile(value, [0.25, 0.75])
        lim = rows.groupBy(*by).agg(q.alias("q")).withColumn("iqr", F.col("q")[1] - F.col("q")[0])
        lim = lim.select(*by, (F.col("q")[0] - threshold * F.col("iqr")).alias("lo"), (F.col("q")[1] + threshold * F.col("iqr")).alias("hi"))
    both = rows.join(lim, list(by)) if by else rows.crossJoin(F.broadcast(lim))
    stats = both.groupBy(*by).agg(F.count("*").alias("n"), F.sum(((F.col(value) < F.col("lo")) | (F.col(value) > F.col("hi"))).cast("long")).alias("k"))

    def close(r):
        n, k = int(r["n"]), int(r["k"] or 0)
        if n < 4:
            return dict(name=f"{label}: outliers", test_name=method, passed=True, detail="insufficient data")
        return dict(name=f"{label}: outliers", test_name=method, statistic=k, passed=k / n < 0.1, detail=f"{k} of {n} flagged")

    return finish(stats, by, close, CHECK)


FIT = "name string, params array<double>, ks_statistic double, ks_p_value double, aic double, bic double, log_likelihood double"
FAMILIES = ("normal", "lognormal", "weibull", "exponential", "gamma", "uniform")
CDF = {
    "normal": "1 - cast(java_method('org.apache.commons.math3.special.Erf', 'erfc', z / sqrt(2.0D)) as double) / 2",
    "lognormal": "CASE WHEN z <= 0 THEN 0D ELSE 1 - cast(java_method('org.apache.commons.math3.special.Erf', 'erfc', ln(CASE WHEN z > 0 THEN z ELSE 1D END) / s / sqrt(2.0D)) as double) / 2 END",
    "weibull": "CASE WHEN z <= 0 THEN 0D ELSE 1 - exp(-pow(z, s)) END",
    "exponential": "CASE WHEN z <= 0 THEN 0D ELSE 1 - exp(-z) END",
    "gamma": "CASE WHEN z <= 0 THEN 0D ELSE cast(java_method('org.apache.commons.math3.special.Gamma', 'regularizedGammaP', s, CASE WHEN z > 0 THEN z ELSE 1D END) as double) END",
    "uniform": "least(1D, greatest(0D, z))",
}


def _sums(rows: DataFrame, value: str, locs: list[float], shapes: list[float] | None = None) -> list[dict]:
    """For each location (and Weibull shape): sums of ln(x - loc), its square, (x - loc)^k and (x - loc)^k ln(x - loc), in one pass."""
    aggs = []
    for i, loc in enumerate(locs):
        x = F.col(value) - F.lit(float(loc))
        aggs += [F.avg(F.log(x)).alias(f"l{i}"), F.var_pop(F.log(x)).alias(f"v{i}")]
        if shapes is not None:
            xk = F.pow(x, F.lit(float(shapes[i])))
            aggs += [F.avg(xk).alias(f"p{i}"), F.avg(xk * F.log(x)).alias(f"q{i}"), F.avg(xk * F.log(x) * F.log(x)).alias(f"r{i}")]
    got = rows.agg(*aggs).first().asDict()
    return [{k[0]: v for k, v in got.items() if k[1:] == str(i)} for i in range(len(locs))]


def _weibull_shapes(rows: DataFrame, value: str, locs: list[float]) -> tuple[list[float], list[dict]]:
    shapes = [1.2] * len(locs)
    for _ in range(12):
        sums = _sums(rows, value, locs, shapes)
        step = []
        for k, s in zip(shapes, sums, strict=True):
            g = s["q"] / s["p"] - 1 / k - s["l"]
            d = s["r"] / s["p"] - (s["q"] / s["p"]) ** 2 + 1 / k**2
            step.append(max(k / 3, min(3 * k, k - g / d)))
        done = max(abs(a - b) / b for a, b in zip(step, shapes, strict=True)) < 1e-9
        shapes = step
        if done:
            break
    return shapes, _sums(rows, value, locs, shapes)


def _digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def _gamma_shape(log_ratio: float) -> float:
    """Shape with ln(a) - digamma(a) = ln(mean) - mean ln."""
    return S.invert(lambda a: -(math.log(a) - _digamma(a)), -log_ratio, 1e-8, 10.0)


def fit_family(rows: DataFrame, value: str, family: str, m: dict) -> dict:
    """(shape..., location, scale) and log-likelihood; three-parameter families profile the location on a refined grid below the minimum."""
    n, mean, sd, low, high = m["n"], m["mean"], math.sqrt(m["var"] * (m["n"] - 1) / m["n"]), m["min"], m["max"]
    if family == "normal":
        return dict(params=[mean, sd], ll=-n / 2 * (math.log(2 * math.pi * sd * sd) + 1), loc=mean, scale=sd, shape=1.0, k=2)
    if family == "uniform":
        return dict(params=[low, high - low], ll=-n * math.log(high - low), loc=low, scale=high - low, shape=1.0, k=2)
    if family == "exponential":
        return dict(params=[low, mean - low], ll=-n * (math.log(mean - low) + 1), loc=low, scale=mean - low, shape=1.0, k=2)
    width, best = high - low, None
    gaps = [width * 10.0**e for e in np.linspace(-4, 1, 9)]
    for _ in range(4):
        locs = [low - g for g in gaps]
        shapes, sums = (None, None)
        if family == "weibull":
            shapes, sums = _weibull_shapes(rows, value, locs)
        else:
            sums = _sums(rows, value, locs)
        for i, (loc, s) in enumerate(zip(locs, sums, strict=True)):
            if family == "lognormal":
                sigma = math.sqrt(max(s["v"], 1e-300))
                made = dict(params=[sigma, loc, math.exp(s["l"])], ll=-n * (s["l"] + math.log(sigma) + 0.5 * math.log(2 * math.pi) + 0.5), loc=loc, scale=math.exp(s["l"]), shape=sigma)
            elif family == "weibull":
                k, scale = shapes[i], s["p"] ** (1 / shapes[i])
                made = dict(params=[k, loc, scale], ll=n * (math.log(k) - k * math.log(scale) + (k - 1) * s["l"] - 1), loc=loc, scale=scale, shape=k)
            else:
                a = _gamma_shape(max(math.log(mean - loc) - s["l"], 1e-9))
                b = (mean - loc) / a
                made = dict(params=[a, loc, b], ll=n * ((a - 1) * s["l"] - a - a * math.log(b) - math.lgamma(a)), loc=loc, scale=b, shape=a)
            if best is None or made["ll"] > best["ll"]:
                best = made | dict(k=3, gap=gaps[i])
        at = gaps.index(best["gap"]) if best["gap"] in gaps else len(gaps) // 2
        lo, hi = gaps[max(at - 1, 0)], gaps[min(at + 1, len(gaps) - 1)]
        gaps = [float(g) for g in np.exp(np.linspace(math.log(lo), math.log(hi), 9))]
    return best


def fit_distribution(df: DataFrame, value: str, dist_name: str = "normal") -> DataFrame:
    rows = clean(df, [value]).cache()
    m = moments(rows, value, ()).first().asDict()
    if dist_name not in FAMILIES:
        raise ValueError(f"unknown distribution {dist_name}")
    out = frame(df, _fit_row(rows, value, dist_name, m), FIT)
    rows.unpersist()
    return out


def _fit_row(rows: DataFrame, value: str, name: str, m: dict) -> dict:
    f = fit_family(rows, value, name, m)
    t = value_table(rows, value).withColumn("z", (F.col(value) - f["loc"]) / f["scale"]).withColumn("s", F.lit(float(f["shape"])))
    t = t.withColumn("f", F.expr(CDF[name]))
    n = m["n"]
    d = t.agg(F.max(F.greatest((F.col("before") + F.col("cnt")) / n - F.col("f"), F.col("f") - F.col("before") / n))).first()[0]
    return dict(name=name, params=[float(p) for p in f["params"]], ks_statistic=d, ks_p_value=S.ks_sf(d, n), aic=2 * f["k"] - 2 * f["ll"], bic=f["k"] * math.log(n) - 2 * f["ll"], log_likelihood=f["ll"])


def fit_best(df: DataFrame, value: str) -> DataFrame:
    """All six families by ascending AIC; families that cannot be fitted are left out."""
    rows = clean(df, [value]).cache()
    m = moments(rows, value, ()).first().asDict()
    out = []
    for name in FAMILIES:
        try:
            out.append(_fit_row(rows, value, name, m))
        except (ValueError, ZeroDivisionError, OverflowError):
            continue
    rows.unpersist()
    return frame(df, sorted(out, key=lambda r: r["aic"]), FIT)


def box_cox_lambda(df: DataFrame, value: str) -> tuple[float, float]:
    """(shift, lambda): golden search on the profile likelihood, 17 candidates a pass."""
    rows = clean(df, [value])
    low, n = rows.agg(F.min(value), F.count("*")).first()
    shift = abs(low) + 1 if low <= 0 else 0.0
    x = F.log(F.col(value) + F.lit(shift))
    lo, hi = -5.0, 5.0
    for _ in range(8):
        grid = np.linspace(lo, hi, 17)
        aggs = [F.var_pop(F.when(F.lit(abs(g) < 1e-12), x).otherwise((F.exp(F.lit(float(g)) * x) - 1) / F.lit(float(g) if abs(g) > 1e-12 else 1.0))).alias(f"v{i}") for i, g in enumerate(grid)]
        r = rows.agg(F.avg(x).alias("l"), *aggs).first().asDict()
        ll = [-0.5 * n * math.log(max(r[f"v{i}"], 1e-300)) + (g - 1) * n * r["l"] for i, g in enumerate(grid)]
        b = int(np.argmax(ll))
        lo, hi = grid[max(b - 1, 0)], grid[min(b + 1, 16)]
    return shift, float((lo + hi) / 2)


def box_cox(df: DataFrame, value: str) -> DataFrame:
    """df with columns transformed and lambda."""
    shift, lam = box_cox_lambda(df, value)
    x = F.col(value).cast("double") + F.lit(shift)
    return df.withColumn("transformed", F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)).withColumn("lambda", F.lit(lam))


def johnson_transform(df: DataFrame, value: str) -> DataFrame:
    """Johnson SU by quantile matching refined on the likelihood: transformed = gamma + delta * asinh((x - xi) / lambda); Box-Cox ("SL") if SU cannot be fitted."""
    z = 0.524
    probs = [S.norm_cdf(k * z) for k in (-3, -1, 1, 3)]
    a, b, c, d = percentiles(clean(df, [value]), probs)[1]
    m, n_, p = d - c, b - a, c - b
    if p <= 0 or m / p * n_ / p <= 1.0001:
        return box_cox(df, value).withColumn("family", F.lit("SL")).drop("lambda")
    mp, np_ = m / p, n_ / p
    delta = 2 * z / math.acosh((mp + np_) / 2)
    gamma = delta * math.asinh((np_ - mp) / (2 * math.sqrt(mp * np_ - 1)))
    lam = 2 * p * math.sqrt(mp * np_ - 1) / ((mp + np_ - 2) * math.sqrt(mp + np_ + 2))
    xi = (b + c) / 2 + p * (np_ - mp) / (2 * (mp + np_ - 2))
    return df.withColumn("transformed", F.lit(gamma) + F.lit(delta) * F.asinh((F.col(value) - F.lit(xi)) / F.lit(lam))).withColumn("family", F.lit("SU"))


def seeded_rng(seed: int = 42) -> np.random.Generator:
    return np.random.default_rng(seed)


def _sample(spark: SparkSession, draw) -> DataFrame:
    import pandas as pd

    values = draw
    return spark.createDataFrame(pd.DataFrame({"pos": np.arange(len(values)), "value": np.asarray(values, float)}))


def sample_normal(spark: SparkSession, mean: float = 0, std: float = 1, n: int = 100, seed: int | None = None) -> DataFrame:
    return _sample(spark, np.random.default_rng(seed).normal(mean, std, n))


def sample_exponential(spark: SparkSession, mean: float = 1, n: int = 100, seed: int | None = None) -> DataFrame:
    return _sample(spark, np.random.default_rng(seed).exponential(mean, n))


def sample_weibull(spark: SparkSession, shape: float = 2, scale: float = 1, n: int = 100, seed: int | None = None) -> DataFrame:
    return _sample(spark, np.random.default_rng(seed).weibull(shape, n) * scale)


def sample_uniform(spark: SparkSession, low: float = 0, high: float = 1, n: int = 100, seed: int | None = None) -> DataFrame:
    return _sample(spark, np.random.default_rng(seed).uniform(low, high, n))


def sample_poisson(spark: SparkSession, lam: float = 5, n: int = 100, seed: int | None = None) -> DataFrame:
    return _sample(spark, np.random.default_rng(seed).poisson(lam, n))


def box_spec(df: DataFrame, value: str, group: str, title: str = "Group Comparison") -> dict:
    """Box plot: quartiles and 1.5 IQR whiskers of every group."""
    rows = clean(df, [value], [group])
    q = rows.groupBy(group).agg(F.percentile(value, [0.25, 0.5, 0.75]).alias("q"), F.count("*").alias("n"))
    lim = rows.join(q, group).withColumn("iqr", F.col("q")[2] - F.col("q")[0])
    inside = (F.col(value) >= F.col("q")[0] - 1.5 * F.col("iqr")) & (F.col(value) <= F.col("q")[2] + 1.5 * F.col("iqr"))
    per = lim.groupBy(group).agg(F.first("q").alias("q"), F.min(F.when(inside, F.col(value))).alias("lo"), F.max(F.when(inside, F.col(value))).alias("hi"), F.sum((~inside).cast("long")).alias("out"), F.first("n").alias("n")).orderBy(group)
    traces = [dict(name=str(r[group]), q1=r["q"][0], median=r["q"][1], q3=r["q"][2], whisker_low=r["lo"], whisker_high=r["hi"], n_outliers=r["out"], n=r["n"]) for r in per.collect()]
    return dict(title=title, chart_type="box_plot", traces=traces)


def qq_spec(df: DataFrame, value: str, title: str = "Normal Q-Q", points: int = 200) -> dict:
    """Ordered values against normal quantiles at Blom positions, at most `points` of them (evenly by rank)."""

    def blom(n: int) -> list[float]:
        return [float((i - 0.375) / (n + 0.25)) for i in np.unique(np.linspace(1, n, min(n, points)).round().astype(int))] if n >= 3 else []

    n, ys = percentiles(clean(df, [value]), lambda n: [min(max(p, 0.0), 1.0) for p in blom(n)])
    if n < 3:
        return {}
    return dict(title=title, chart_type="qq_plot", traces=[dict(x=[S.norm_ppf(p) for p in blom(n)], y=ys)])


def histogram_spec(df: DataFrame, value: str, title: str = "Distribution") -> dict:
    rows = clean(df, [value])
    n, lo, hi = rows.agg(F.count("*"), F.min(value), F.max(value)).first()
    if not n:
        return {}
    bins = min(20, max(5, n // 2))
    width = (hi - lo) / bins or 1.0
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) / width))
    counts = {r["b"]: r["count"] for r in rows.groupBy(at.alias("b")).count().collect()}
    return dict(title=title, chart_type="histogram", traces=[dict(x=[lo + (i + 0.5) * width for i in range(bins)], y=[counts.get(i, 0) for i in range(bins)])])


def box_views(df: DataFrame, value: str, group: str, title: str = "Group Comparison") -> list[dict]:
    box = box_spec(df, value, group, title)
    return [box] + [qq_spec(df.filter(F.col(group).cast("string") == t["name"]), value, f"Q-Q: {t['name']}") for t in box["traces"] if t["n"] >= 3]


def histogram_views(df: DataFrame, value: str, title: str = "Distribution") -> list[dict]:
    return [s for s in (histogram_spec(df, value, title), qq_spec(df, value)) if s]


def sample_views(df: DataFrame, value: str, group: str | None = None, title: str = "Distribution") -> list[dict]:
    if df.isEmpty():
        return []
    if group is not None and df.select(group).distinct().count() >= 2:
        return box_views(df, value, group, title)
    return histogram_views(df, value, title)


def cohens_d_one_sample(df: DataFrame, value: str, mu: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """(mean - mu) / sd; null where the deviation is zero or fewer than 2 values are there."""
    d = F.when(F.stddev_samp(value) > 0, (F.avg(value) - F.lit(mu)) / F.stddev_samp(value))
    return clean(df, [value], by=by).groupBy(*by).agg(d.alias("cohens_d"))


def cohens_d_two_sample(df: DataFrame, value: str, group: str, pooled: bool = True, by: Sequence[str] = ()) -> DataFrame:
    from quillon.functions.effects import pooled_sd

    def close(r):
        a, b = dicts(r["g"])
        sd = pooled_sd(a["n"], a["var"], b["n"], b["var"]) if pooled else math.sqrt((a["var"] + b["var"]) / 2)
        return dict(cohens_d=(a["mean"] - b["mean"]) / sd if sd > 0 else 0.0)

    return finish(group_stats(df, value, group, by), by, close, "cohens_d double")


def cohens_d_paired(df: DataFrame, x1: str, x2: str, by: Sequence[str] = ()) -> DataFrame:
    """mean / sd of the differences; without spread 0, or infinite with the mean's sign."""
    rows = clean(df, [x1, x2], by=by).withColumn("_d", F.col(x1) - F.col(x2))
    m, s = F.avg("_d"), F.stddev_samp("_d")
    return rows.groupBy(*by).agg(F.when(s > 0, m / s).when(m == 0, 0.0).otherwise(F.signum(m) * F.lit(math.inf)).alias("cohens_d"))
