"""Acceptance sampling, analysis of means, capability, desirability, loss and decision economics, variance components."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import special as S
from quillon.operators.core import ad_critical, ad_statistic, normality_stats
from quillon.operators.parametric import anova_parts, need
from quillon.plans.blocks import percentiles
from quillon.plans.stats import clean, dicts, finish, group_stats, num

PLAN = "plan_type string, sample_size long, acceptance_number long, k_value double, aql double, ltpd double, aoql double, producer_risk double, consumer_risk double, oc array<struct<defect_rate:double,p_accept:double>>"


def attribute_plan(spark: SparkSession, aql: float = 0.01, ltpd: float = 0.05, producer_risk: float = 0.05, consumer_risk: float = 0.1, lot_size: int = 1000) -> DataFrame:
    """Smallest (n, c), c < 50, by the binomial; OC by the hypergeometric with one defective at least."""
    n, c = lot_size, 0
    top = min(lot_size + 1, 5000)
    for k in range(50):
        # P(accept | ltpd) falls with n: the first n low enough there is the only candidate to meet the other risk
        a, b = k + 1, top
        while a < b:
            m = (a + b) // 2
            a, b = (a, m) if S.binom_cdf(k, m, ltpd) <= consumer_risk else (m + 1, b)
        if a < min(n, top) and S.binom_cdf(k, a, aql) >= 1 - producer_risk:
            n, c = a, k
    oc, aoql = [], None
    for p in np.linspace(0, min(0.2, ltpd * 3), 50):
        bad = max(1, int(p * lot_size))
        if n < lot_size:
            pa = sum(S.hypergeom_pmf(i, lot_size, bad, n) for i in range(c + 1))
            aoql = max(aoql or 0.0, pa * p * (lot_size - n) / lot_size)
        else:
            pa = S.binom_cdf(c, n, max(p, 1e-10))
        oc.append((float(p), float(pa)))
    return spark.createDataFrame([("attribute", n, c, None, aql, ltpd, None if aoql is None else float(aoql), 1 - S.binom_cdf(c, n, aql), S.binom_cdf(c, n, ltpd), oc)], PLAN)


def variable_plan(spark: SparkSession, aql: float = 0.01, ltpd: float = 0.05, producer_risk: float = 0.05, consumer_risk: float = 0.1) -> DataFrame:
    z = [S.norm_ppf(1 - x) for x in (aql, ltpd, producer_risk, consumer_risk)]
    n = max(2, math.ceil(((z[2] + z[3]) / (z[0] - z[1])) ** 2))
    k = z[0] - z[2] / math.sqrt(n)
    oc = [(float(p), S.norm_cdf((S.norm_ppf(1 - p) - k) * math.sqrt(n))) for p in np.linspace(0.001, min(0.2, ltpd * 3), 50)]
    return spark.createDataFrame([("variable", n, None, k, aql, ltpd, None, producer_risk, consumer_risk, oc)], PLAN)


def anom(df: DataFrame, value: str, group: str, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Decision limits with a Bonferroni t in place of the h table."""

    def close(r):
        g = dicts(r["g"])
        a = anova_parts(g)
        n, k = a["n"], a["k"]
        h = S.t_ppf(1 - alpha / (2 * k), a["df_within"])
        out = []
        for x in g:
            half = h * math.sqrt(a["ms_within"] * (1 - x["n"] / n) / x["n"])
            lo, hi = a["grand"] - half, a["grand"] + half
            out.append(dict(name=x["label"], mean=x["mean"], n=x["n"], exceeds_upper=x["mean"] > hi, exceeds_lower=x["mean"] < lo, grand_mean=a["grand"], lower_limit=lo, upper_limit=hi, mse=a["ms_within"], h_critical=h))
        return out

    return finish(group_stats(df, value, group, by), by, close, "name string, mean double, n long, exceeds_upper boolean, exceeds_lower boolean, grand_mean double, lower_limit double, upper_limit double, mse double, h_critical double")


def attribute_capability(df: DataFrame, defects: str, units: str | None = None, opportunities: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Sums of the defect and unit columns; every row is one unit if no column is named."""
    stats = df.groupBy(*by).agg(F.sum(num(defects)).alias("d"), (F.sum(num(units)) if units else F.count("*")).cast("double").alias("u"))

    def close(r):
        dpu = r["d"] / r["u"] if r["u"] else 0.0
        dpo = dpu / opportunities
        z = S.norm_ppf(1 - dpo) if 0 < dpo < 1 else (6.0 if dpo <= 0 else 0.0)
        return dict(defects=r["d"], units=r["u"], opportunities=opportunities, dpu=dpu, dpo=dpo, dpmo=dpo * 1e6, yield_pct=100 * (1 - dpo), z_bench=z, sigma_short_term=z + 1.5)

    return finish(stats, by, close, "defects double, units double, opportunities long, dpu double, dpo double, dpmo double, yield_pct double, z_bench double, sigma_short_term double")


def nonnormal_capability(df: DataFrame, value: str, lsl: float | None = None, usl: float | None = None) -> DataFrame:
    need(lsl is not None or usl is not None, "a specification limit is needed")
    rows = clean(df, [value])
    out = (F.lit(False) if lsl is None else F.col(value) < lsl) | (F.lit(False) if usl is None else F.col(value) > usl)
    found = percentiles(rows, [0.00135, 0.5, 0.99865])[1]
    q = rows.agg(F.avg(out.cast("double")).alias("out")).withColumn("q", F.array(*map(F.lit, found)))

    def close(r):
        lo, med, hi = r["q"]
        sides = ([(usl - med) / (hi - med)] if usl is not None and hi > med else []) + ([(med - lsl) / (med - lo)] if lsl is not None and med > lo else [])
        a = ad_statistic(r)
        return dict(cnp=(usl - lsl) / (hi - lo) if usl is not None and lsl is not None and hi > lo else None, cnpk=min(sides) if sides else None, median=med, p_low=lo, p_high=hi, ppm_out=r["out"] * 1e6, is_normal=a < ad_critical(int(r["n"])), normality_p=a, ad_statistic=a)

    return finish(q.crossJoin(F.broadcast(normality_stats(rows, value))), (), close, "cnp double, cnpk double, median double, p_low double, p_high double, ppm_out double, is_normal boolean, normality_p double, ad_statistic double")


def desirability(x: Column, goal: str = "target", target: float | None = None, lower: float | None = None, upper: float | None = None, shape: float = 1.0) -> Column:
    """0..1 by goal: target (0 at the bounds), maximize (lower to target), minimize (target to upper)."""
    t = lambda v: F.pow(v, F.lit(float(shape)))
    if goal == "maximize":
        top = target if target is not None else upper
        return F.when(x <= lower, 0.0).when(x >= top, 1.0).otherwise(t((x - lower) / (top - lower)))
    if goal == "minimize":
        low = target if target is not None else lower
        return F.when(x >= upper, 0.0).when(x <= low, 1.0).otherwise(t((upper - x) / (upper - low)))
    return F.when((x < lower) | (x > upper), 0.0).when(x <= target, F.lit(1.0) if target == lower else t((x - lower) / (target - lower))).otherwise(F.lit(1.0) if target == upper else t((upper - x) / (upper - target)))


def derringer_suich(df: DataFrame, responses: list[dict]) -> DataFrame:
    """df with d_<name> per response and composite_d, the importance-weighted geometric mean (0 if any is 0).

    A response: name, goal, target, lower, upper, weight (importance), shape.
    """
    out, total = df, sum(float(r.get("weight", 1.0)) for r in responses)
    logs, zero = F.lit(0.0), F.lit(False)
    for r in responses:
        d = f"d_{r['name']}"
        out = out.withColumn(d, desirability(num(r["name"]), r.get("goal", "target"), r.get("target"), r.get("lower"), r.get("upper"), r.get("shape", 1.0)))
        logs = logs + F.lit(float(r.get("weight", 1.0))) * F.log(F.greatest(F.col(d), F.lit(1e-300)))
        zero = zero | (F.col(d) <= 0)
    return out.withColumn("composite_d", F.when(zero, 0.0).otherwise(F.exp(logs / total))).withColumn("all_satisfied", ~zero)


class TaguchiLoss:
    """Quadratic loss: nib (nominal is best), stb (smaller), ltb (larger), asymmetric."""

    def __init__(self, loss_type: str = "nib", target: float = 0.0, delta0: float = 1.0, cost_at_limit: float = 100.0, k_low: float | None = None, k_high: float | None = None):
        need(loss_type in ("nib", "stb", "ltb", "asymmetric"), f"unknown loss {loss_type}")
        self.loss_type, self.target, self.delta0, self.cost_at_limit = loss_type, target, delta0, cost_at_limit
        self.k = cost_at_limit / delta0**2
        self.k_low, self.k_high = (self.k if k_low is None else k_low), (self.k if k_high is None else k_high)

    def loss(self, y: Column) -> Column:
        d = y - F.lit(self.target)
        if self.loss_type == "stb":
            return F.lit(self.k) * y * y
        if self.loss_type == "ltb":
            return F.when(y == 0, F.lit(math.inf)).otherwise(F.lit(self.k) / (y * y))
        if self.loss_type == "asymmetric":
            return F.when(d < 0, F.lit(self.k_low)).otherwise(F.lit(self.k_high)) * d * d
        return F.lit(self.k) * d * d

    def expected_loss(self, df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
        """From mean and sample variance; ltb by its second-order form."""
        k, target, kind = self.k, self.target, self.loss_type

        def close(r):
            m, v = r["mean"], r["variance"]
            d = m - target
            if kind == "stb":
                e = k * (v + m * m)
            elif kind == "ltb":
                e = k * (1 / m**2 + 3 * v / m**4) if abs(m) > 1e-8 else math.inf
            elif kind == "asymmetric":  # the two halves of a normal law about the target
                sd = math.sqrt(v)
                z = -d / sd if sd > 1e-12 else math.inf
                low, dens = S.norm_cdf(z), math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
                e = self.k_low * ((v + d * d) * low - sd * d * dens) + self.k_high * ((v + d * d) * (1 - low) + sd * d * dens)
            else:
                e = k * (v + d * d)
            return dict(expected_loss=e, mean=m, variance=v)

        stats = clean(df, [value], by=by).groupBy(*by).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))
        return finish(stats, by, close, "expected_loss double, mean double, variance double")

    def to_dict(self) -> dict:
        return dict(loss_type=self.loss_type, target=self.target, delta0=self.delta0, cost_at_limit=self.cost_at_limit, k=self.k, k_low=self.k_low, k_high=self.k_high)


def _cheapest(costs: dict[str, Column]) -> Column:
    least = F.least(*costs.values())
    out = None
    for name, c in costs.items():
        out = F.when(c == least, name) if out is None else out.when(c == least, name)
    return out


class ProcessDecision:
    """Continue, investigate or adjust by expected cost at a probability of shift."""

    def __init__(self, c_miss: float = 500.0, c_fa: float = 100.0, c_inv: float = 80.0, c_over: float = 120.0, c_adj: float = 150.0):
        self.c = dict(c_miss=c_miss, c_fa=c_fa, c_inv=c_inv, c_over=c_over, c_adj=c_adj)

    def expected_costs(self, p: Column) -> dict[str, Column]:
        c, q = self.c, F.lit(1.0) - p
        return {"Continue": p * c["c_miss"], "Investigate": q * c["c_fa"] + p * c["c_inv"], "Adjust": q * c["c_over"] + p * c["c_adj"]}

    def optimal_action(self, df: DataFrame, p: str) -> DataFrame:
        costs = self.expected_costs(num(p))
        out = df
        for name, c in costs.items():
            out = out.withColumn(f"cost_{name.lower()}", c)
        return out.withColumn("action", _cheapest(costs))

    def thresholds(self) -> dict[str, float]:
        c = self.c
        ci, ca = c["c_fa"] + c["c_miss"] - c["c_inv"], c["c_over"] + c["c_miss"] - c["c_adj"]
        ia = (c["c_over"] - c["c_fa"]) + (c["c_inv"] - c["c_adj"])
        return dict(continue_vs_investigate=c["c_fa"] / ci if ci > 0 else 0.5, continue_vs_adjust=c["c_over"] / ca if ca > 0 else 0.5, investigate_vs_adjust=(c["c_over"] - c["c_fa"]) / ia if abs(ia) > 1e-10 else 0.5)

    def sweep(self, spark: SparkSession, n: int = 200) -> DataFrame:
        return self.optimal_action(spark.range(n).select((F.col("id") / F.lit(n - 1)).alias("p_shift")), "p_shift")


class AcceptanceDecision:
    """Accept, reject or screen a lot by expected cost at a defect rate."""

    def __init__(self, lot_size: int = 1000, c_external: float = 50.0, c_internal: float = 5.0, c_inspection: float = 0.5, c_reject_lot: float = 200.0):
        self.lot_size, self.c_external, self.c_internal, self.c_inspection, self.c_reject_lot = lot_size, c_external, c_internal, c_inspection, c_reject_lot

    def expected_costs(self, p: Column) -> dict[str, Column]:
        n = float(self.lot_size)
        return {"accept": p * n * self.c_external, "reject": F.lit(float(self.c_reject_lot)), "screen": F.lit(n * self.c_inspection) + p * n * self.c_internal}

    def optimal_action(self, df: DataFrame, p: str) -> DataFrame:
        costs = self.expected_costs(num(p))
        out = df
        for name, c in costs.items():
            out = out.withColumn(f"cost_{name}", c)
        return out.withColumn("action", _cheapest(costs))

    def breakeven(self) -> float:
        return self.c_inspection / (self.c_external - self.c_internal)

    def sweep(self, spark: SparkSession, n: int = 101, top: float = 0.2) -> DataFrame:
        return self.optimal_action(spark.range(n).select((F.col("id") * F.lit(top / (n - 1))).alias("defect_rate")), "defect_rate")


class CostOfQuality:
    """Prevention, appraisal and failure costs."""

    def __init__(self, prevention: float = 0.0, appraisal: float = 0.0, internal_failure: float = 0.0, external_failure: float = 0.0, revenue: float = 1.0):
        self.prevention, self.appraisal, self.internal_failure, self.external_failure, self.revenue = prevention, appraisal, internal_failure, external_failure, revenue

    @property
    def conformance_cost(self) -> float:
        return self.prevention + self.appraisal

    @property
    def nonconformance_cost(self) -> float:
        return self.internal_failure + self.external_failure

    @property
    def total(self) -> float:
        return self.conformance_cost + self.nonconformance_cost

    def summary(self) -> dict:
        t = self.total
        pct = lambda x: 100 * x / t if t > 0 else 0.0
        return dict(prevention=self.prevention, appraisal=self.appraisal, internal_failure=self.internal_failure, external_failure=self.external_failure, total_coq=t, conformance=self.conformance_cost, nonconformance=self.nonconformance_cost, coq_pct_revenue=100 * t / self.revenue if self.revenue > 0 else 0.0, conformance_ratio=pct(self.conformance_cost), nonconformance_ratio=pct(self.nonconformance_cost), prevention_pct=pct(self.prevention), appraisal_pct=pct(self.appraisal), int_failure_pct=pct(self.internal_failure), ext_failure_pct=pct(self.external_failure))

    def optimal_prevention_model(self, spark: SparkSession, n: int = 50) -> DataFrame:
        """Failure cost halves with each further base prevention; 0.1 to 5 times the base."""
        base, rest = max(self.prevention, 1.0), self.nonconformance_cost
        x = F.lit(0.1) + F.col("id") * F.lit(4.9 / (n - 1))
        grid = spark.range(n).select((x * F.lit(base)).alias("prevention"), (F.lit(rest) * F.exp(-F.lit(math.log(2)) * (x - 1))).alias("failure"))
        return grid.withColumn("total", F.col("prevention") + F.col("failure") + F.lit(float(self.appraisal)))


def one_way_random(df: DataFrame, value: str, group: str, factor_name: str = "Factor", by: Sequence[str] = ()) -> DataFrame:
    def close(r):
        g = dicts(r["g"])
        a = anova_parts(g)
        n0 = (a["n"] - sum(x["n"] ** 2 for x in g) / a["n"]) / (a["k"] - 1)
        between, within = max(0.0, (a["ms_between"] - a["ms_within"]) / n0), a["ms_within"]
        total = between + within
        return [dict(source=s, variance=v, pct_contribution=100 * v / total if total else 0.0, std_dev=math.sqrt(v), total_variance=total, icc=between / total if total else 0.0) for s, v in ((factor_name, between), ("Within", within))]

    return finish(group_stats(df, value, group, by), by, close, "source string, variance double, pct_contribution double, std_dev double, total_variance double, icc double")
