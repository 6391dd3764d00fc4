"""Survival curves, log-rank, Cox regression and lifetime distributions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import special as S
from quillon.operators.parametric import need
from quillon.operators.regression import solve
from quillon.plans.pairs import pair_order
from quillon.plans.stats import clean, cumulate, finish, frame, num, ordered, value_table

CURVE = "time double, at_risk long, events long, censored long, survival double, se double, ci_lower double, ci_upper double"


def event_table(df: DataFrame, time: str, event: str | None, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct time: events d, censored c; a missing event column means that all failed."""
    e = F.lit(1) if event is None else F.coalesce(F.col(event).cast("int"), F.lit(0))
    rows = df.select(*by, num(time).alias("time"), e.alias("_e")).filter(F.col("time").isNotNull() & ~F.isnan("time"))
    return rows.groupBy(*by, "time").agg(F.sum("_e").alias("events"), F.sum(1 - F.col("_e")).alias("censored"))


def kaplan_meier(df: DataFrame, time: str, event: str | None = None, ci_level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """The curve, one row per event time, preceded by time 0; Greenwood errors, plain limits clipped to [0, 1].

    Running sums go over distinct times (one row each); without `by` they are two-level, so no task holds them all.
    """
    t = event_table(df, time, event, by)
    here = (F.col("events") + F.col("censored")).cast("double")
    totals = t.groupBy(*by).agg(F.sum(here).alias("n_total"))
    rows = t.join(F.broadcast(totals), list(by)) if by else ordered(t.crossJoin(F.broadcast(totals)), ["time"])
    at = cumulate(rows, by, "time", {"_seen": here}).withColumn("_risk", F.col("n_total") - F.col("_seen") + here)
    d, n = F.col("events"), F.col("_risk")
    sums = {"_log": F.when(d < n, F.log1p(-d / n)).otherwise(0.0), "_green": F.when(n > d, d / (n * (n - d))).otherwise(0.0), "_dead": F.when(d == n, 1.0).otherwise(0.0)}
    at = cumulate(at, by, "time", sums).withColumn("at_risk", n.cast("long"))
    z = S.norm_ppf(0.5 + ci_level / 2)
    alive, green = F.when(F.col("_dead") > 0, 0.0).otherwise(F.exp("_log")), F.col("_green")
    out = at.withColumn("survival", alive).withColumn("se", F.col("survival") * F.sqrt(green)).filter("events > 0")
    out = out.withColumn("ci_lower", F.greatest(F.lit(0.0), F.col("survival") - z * F.col("se"))).withColumn("ci_upper", F.least(F.lit(1.0), F.col("survival") + z * F.col("se")))
    cols = [*by, "time", "at_risk", "events", "censored", "survival", "se", "ci_lower", "ci_upper"]
    zero = t.groupBy(*by).agg(F.sum(F.col("events") + F.col("censored")).alias("at_risk")).select(*by, F.lit(0.0).alias("time"), "at_risk", F.lit(0).cast("long").alias("events"), F.lit(0).cast("long").alias("censored"), F.lit(1.0).alias("survival"), F.lit(0.0).alias("se"), F.lit(1.0).alias("ci_lower"), F.lit(1.0).alias("ci_upper"))
    return zero.unionByName(out.select(*cols))


def survival_summary(df: DataFrame, time: str, event: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """median_survival (first S <= 0.5), mean_survival (area to the last event time), counts."""
    curve = kaplan_meier(df, time, event, by=by)
    w = Window.partitionBy(*by, F.lit(0)).orderBy("time")
    area = F.lead("time").over(w) - F.col("time")
    s = curve.withColumn("_a", area * F.col("survival")).groupBy(*by).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median_survival"), F.sum("_a").alias("mean_survival"))
    n = event_table(df, time, event, by).groupBy(*by).agg(F.sum("events").alias("n_events"), F.sum("censored").alias("n_censored")).withColumn("n_total", F.col("n_events") + F.col("n_censored"))
    return s.join(n, list(by)) if by else s.crossJoin(F.broadcast(n))


def log_rank_test(df: DataFrame, time: str, event: str | None, group: str, compat: bool = False) -> DataFrame:
    """Two groups. compat keeps subjects censored between event times at risk, as the older engine did."""
    t = event_table(df, time, event, [group])
    labels = [r[0] for r in t.select(F.col(group).cast("string")).distinct().orderBy(group).collect()]
    need(len(labels) == 2, "two groups are needed")
    one = F.col(group).cast("string") == labels[0]
    per = t.groupBy("time").agg(F.sum("events").alias("d"), F.sum(F.when(one, F.col("events")).otherwise(0)).alias("d1"), F.sum(F.col("events") + F.col("censored")).alias("x"), F.sum(F.when(one, F.col("events") + F.col("censored")).otherwise(0)).alias("x1"))
    if compat:
        per = per.filter("d > 0")
    totals = t.agg(F.sum(F.col("events") + F.col("censored")).alias("N"), F.sum(F.when(one, F.col("events") + F.col("censored")).otherwise(0)).alias("N1"))
    run = cumulate(ordered(per, ["time"]), (), "time", {"_x": F.col("x").cast("double"), "_x1": F.col("x1").cast("double")})
    r = run.crossJoin(F.broadcast(totals)).withColumn("n", F.col("N") - F.col("_x") + F.col("x")).withColumn("n1", F.col("N1") - F.col("_x1") + F.col("x1")).filter("d > 0 AND n > 0")
    d, n, share = F.col("d").cast("double"), F.col("n"), F.col("n1") / F.col("n")  # doubles: the products pass a long
    s = r.agg(F.sum("d1").alias("o1"), F.sum(d * share).alias("e1"), F.sum("d").alias("o"), F.sum(F.when(n > 1, share * (1 - share) * d * (n - d) / (n - 1)).otherwise(0.0)).alias("v"))

    def close(x):
        chi = (x["o1"] - x["e1"]) ** 2 / x["v"] if x["v"] else 0.0
        return dict(chi_square=chi, p_value=S.chi2_sf(chi, 1), df=1, observed=[float(x["o1"]), float(x["o"] - x["o1"])], expected=[float(x["e1"]), float(x["o"] - x["e1"])], groups=labels)

    return finish(s, (), close, "chi_square double, p_value double, df long, observed array<double>, expected array<double>, groups array<string>")


def cox_ph(df: DataFrame, time: str, event: str, covariates: Sequence[str], max_iter: int = 30) -> DataFrame:
    """Breslow partial likelihood by Newton steps. Rows are first summed by time; risk-set sums are running sums over distinct times.

    concordance is Harrell's: of the pairs where the earlier time is an event, the share with the higher risk there (equal risks: half).
    """
    rows = clean(df, [time, *covariates], [event]).withColumn("_e", F.coalesce(F.col(event).cast("int"), F.lit(0))).cache()
    st = rows.agg(F.count("*").alias("n"), F.sum("_e").alias("d"), *(f(c).alias(f"{t}{i}") for i, c in enumerate(covariates) for t, f in (("m", F.avg), ("s", F.stddev_pop)))).first().asDict()
    p = len(covariates)
    mean, sd = np.array([st[f"m{i}"] for i in range(p)]), np.array([st[f"s{i}"] or 1.0 for i in range(p)])
    x = [(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(covariates, mean, sd, strict=True)]
    beta, ll, info = np.zeros(p), -math.inf, np.eye(p)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    for _ in range(max_iter):
        score = sum((F.lit(float(b)) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))
        per = rows.select(time, "_e", F.exp(score).alias("r"), score.alias("xb"), *(c.alias(f"x{i}") for i, c in enumerate(x)))
        per = per.groupBy(time).agg(F.sum("_e").alias("d"), F.sum(F.col("_e") * F.col("xb")).alias("dxb"), F.sum("r").alias("r0"), *(F.sum(F.col("_e") * F.col(f"x{i}")).alias(f"d{i}") for i in range(p)), *(F.sum(F.col("r") * F.col(f"x{i}")).alias(f"r{i + 1}") for i in range(p)), *(F.sum(F.col("r") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"r_{i}_{j}") for i, j in pairs))
        per = ordered(per.withColumn("_back", -F.col(time)), ["_back"])
        risk = cumulate(per, (), "_back", {"risk": F.col("r0")} | {f"s{i}": F.col(f"r{i + 1}") for i in range(p)} | {f"s_{i}_{j}": F.col(f"r_{i}_{j}") for i, j in pairs}).filter("d > 0")
        a = lambda i: F.col(f"s{i}") / F.col("risk")
        got = risk.agg(F.sum(F.col("dxb") - F.col("d") * F.log("risk")).alias("ll"), *(F.sum(F.col(f"d{i}") - F.col("d") * a(i)).alias(f"u{i}") for i in range(p)), *(F.sum(F.col("d") * (F.col(f"s_{i}_{j}") / F.col("risk") - a(i) * a(j))).alias(f"h{i}_{j}") for i, j in pairs)).first().asDict()
        info = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        if abs(got["ll"] - ll) < 1e-10 * abs(got["ll"]):
            ll = got["ll"]
            break
        ll = got["ll"]
        beta = beta + solve(info, np.array([got[f"u{i}"] for i in range(p)]))[0]
    score = sum((F.lit(float(b)) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))
    order = pair_order(rows.withColumn("_score", score), time, "_score", F.col("_e"), F.lit(1))
    comparable = sum(order.values())
    concordance = (order["more"] + order["tie"] / 2) / comparable if comparable else None
    rows.unpersist()
    se = np.sqrt(np.diag(np.linalg.pinv(info))) / sd
    b = beta / sd
    out = [dict(term=c, coefficient=v, hazard_ratio=math.exp(min(v, 700)), std_error=e, z_statistic=v / e, p_value=2 * S.norm_sf(abs(v / e)), concordance=concordance, log_likelihood=ll, n=st["n"], n_events=st["d"]) for c, v, e in zip(covariates, b, se, strict=True)]
    return frame(df, out, "term string, coefficient double, hazard_ratio double, std_error double, z_statistic double, p_value double, concordance double, log_likelihood double, n long, n_events long")


WEIBULL = "shape double, scale double, location double, b10_life double, mean_life double, median_life double, ks_statistic double, ks_p_value double, failure_mode string, n long"


def weibull_fit(df: DataFrame, time: str, censored: str | None = None) -> DataFrame:
    """Two-parameter maximum likelihood, right censoring optional; flags stay beside their times."""
    rows = clean(df, [time], [censored] if censored else []).filter(F.col(time) > 0).cache()
    c = F.coalesce(F.col(censored).cast("int"), F.lit(0)) if censored else F.lit(0)
    rows = rows.withColumn("_f", 1 - c)
    n, d, lf = rows.agg(F.count("*"), F.sum("_f"), F.avg(F.when(F.col("_f") == 1, F.log(time)))).first()
    need(n >= 3 and d >= 3, "at least 3 failure times are needed")
    k, x = 1.2, F.col(time)
    for _ in range(60):
        xk = F.pow(x, F.lit(float(k)))
        p, q, r = rows.agg(F.sum(xk), F.sum(xk * F.log(x)), F.sum(xk * F.log(x) * F.log(x))).first()
        g, h = q / p - 1 / k - lf, r / p - (q / p) ** 2 + 1 / k**2
        new = max(k / 3, min(3 * k, k - g / h))
        done = abs(new - k) < 1e-11 * k
        k = new
        if done:
            break
    scale = (rows.agg(F.sum(F.pow(x, F.lit(float(k))))).first()[0] / d) ** (1 / k)
    t = value_table(rows, time).withColumn("f", 1 - F.exp(-F.pow(x / F.lit(scale), F.lit(float(k)))))
    ks = t.agg(F.max(F.greatest((F.col("before") + F.col("cnt")) / n - F.col("f"), F.col("f") - F.col("before") / n))).first()[0]
    rows.unpersist()
    mode = "infant_mortality" if k < 1 else "random" if abs(k - 1) < 0.1 else "wear_out"
    return frame(df, dict(shape=k, scale=scale, location=0.0, b10_life=scale * (-math.log(0.9)) ** (1 / k), mean_life=scale * math.gamma(1 + 1 / k), median_life=scale * math.log(2) ** (1 / k), ks_statistic=ks, ks_p_value=S.ks_sf(ks, n), failure_mode=mode, n=n), WEIBULL)


def _upper_normal(z: Column) -> Column:
    """1 - Phi(z) by a complementary error function inside the plan."""
    return F.call_function("java_method", F.lit("org.apache.commons.math3.special.Erf"), F.lit("erfc"), (z / F.lit(math.sqrt(2))).cast("double")).cast("double") / 2


def reliability_function(df: DataFrame, time: str, shape: float, scale: float, distribution: str = "weibull") -> DataFrame:
    """df with column reliability: R(t)."""
    t = num(time)
    made = {"weibull": F.exp(-F.pow(t / scale, F.lit(float(shape)))), "exponential": F.exp(-t / scale), "lognormal": F.when(t <= 0, 1.0).otherwise(_upper_normal((F.log(F.greatest(t, F.lit(1e-300))) - math.log(scale)) / shape))}
    need(distribution in made, f"unknown distribution {distribution}")
    return df.withColumn("reliability", made[distribution])


def hazard_function(df: DataFrame, time: str, shape: float, scale: float, distribution: str = "weibull") -> DataFrame:
    t = num(time)
    z = (F.log(F.greatest(t, F.lit(1e-300))) - math.log(scale)) / shape
    dens = F.exp(-z * z / 2) / (t * (shape * math.sqrt(2 * math.pi)))
    made = {"weibull": F.lit(shape / scale) * F.pow(t / scale, F.lit(float(shape - 1))), "exponential": F.lit(1 / scale), "lognormal": F.when(t <= 0, 0.0).otherwise(dens / F.greatest(_upper_normal(z), F.lit(1e-300)))}
    need(distribution in made, f"unknown distribution {distribution}")
    return df.withColumn("hazard", made[distribution])


LIFE = "distribution string, parameters map<string,double>, mttf double, b10 double, n long"


def exponential_fit(df: DataFrame, time: str, by: Sequence[str] = ()) -> DataFrame:
    s = clean(df, [time], by=by).filter(F.col(time) > 0).groupBy(*by).agg(F.avg(time).alias("m"), F.count("*").alias("n"))
    return s.select(*by, F.lit("exponential").alias("distribution"), F.create_map(F.lit("rate"), 1 / F.col("m"), F.lit("mean"), F.col("m")).alias("parameters"), F.col("m").alias("mttf"), (F.col("m") * -math.log(0.9)).alias("b10"), "n")


def lognormal_fit(df: DataFrame, time: str, by: Sequence[str] = ()) -> DataFrame:
    s = clean(df, [time], by=by).filter(F.col(time) > 0).groupBy(*by).agg(F.avg(F.log(time)).alias("mu"), F.stddev_pop(F.log(time)).alias("sigma"), F.count("*").alias("n"))
    return s.select(*by, F.lit("lognormal").alias("distribution"), F.create_map(F.lit("mu"), F.col("mu"), F.lit("sigma"), F.col("sigma"), F.lit("median"), F.exp("mu")).alias("parameters"), F.exp(F.col("mu") + F.col("sigma") * F.col("sigma") / 2).alias("mttf"), F.exp(F.col("mu") + S.norm_ppf(0.1) * F.col("sigma")).alias("b10"), "n")
