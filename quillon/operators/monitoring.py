"""Drift: ADWIN cut, Page-Hinkley, population stability. Conformal prediction."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.parametric import need
from quillon.operators.timeseries import positioned, running
from quillon.plans.blocks import percentiles
from quillon.plans.stats import clean, finish, frame, num, value_table

# The detectors' constants.
PSI_BINS, PSI_EPSILON, ADWIN_DELTA, PH_DELTA, PH_LAMBDA = 10, 1e-4, 0.002, 0.005, 50.0


def adwin_detect(df: DataFrame, value: str, order: Sequence[str], delta: float = ADWIN_DELTA) -> DataFrame:
    """The cut whose means differ most beyond the Hoeffding bound, on the min-max scaled stream."""
    rows = positioned(df, [value], order)
    st = rows.agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum(value).alias("s")).first()
    n, span = st["n"], (st["hi"] or 0.0) - (st["lo"] or 0.0)
    schema = "detected boolean, change_idx long, mean_before double, mean_after double, shift_magnitude double, window_length long, epsilon double"
    if n < 20 or span < 1e-12:
        return frame(df, dict(detected=False, window_length=n), schema)
    least = max(10, n // 20)
    cum = running(rows, {"c": (F.col(value) - F.lit(st["lo"])) / F.lit(span)})
    total = (st["s"] - n * st["lo"]) / span
    t = F.col("pos") + 1  # values before the cut
    diff = F.abs(F.col("c") / t - (F.lit(total) - F.col("c")) / (F.lit(n) - t))
    eps = F.sqrt(F.lit(0.5 * math.log(4 * n / delta)) / F.least(t, F.lit(n) - t))
    cuts = cum.filter((t >= least) & (t < n - least)).select(t.alias("t"), (diff - eps).alias("e"), eps.alias("eps"), "c")
    best = cuts.groupBy().agg(F.max_by(F.struct("t", "e", "eps", "c"), F.struct("e", -F.col("t"))).alias("b"))

    def close(r):
        b = r["b"]
        b = b.asDict() if hasattr(b, "asDict") else b
        if b is None or b["e"] <= 0:
            return dict(detected=False, mean_before=round(st["s"] / n, 6), window_length=n)
        before = b["c"] / b["t"] * span + st["lo"]
        after = (total - b["c"]) / (n - b["t"]) * span + st["lo"]
        return dict(detected=True, change_idx=b["t"], mean_before=round(before, 6), mean_after=round(after, 6), shift_magnitude=round(after - before, 6), window_length=n, epsilon=round(b["eps"], 6))

    return finish(best, (), close, schema)


def page_hinkley_detect(df: DataFrame, value: str, order: Sequence[str], direction: str = "up", ph_delta: float = PH_DELTA, ph_lambda: float = PH_LAMBDA) -> DataFrame:
    """Standardised by the whole stream; nested running sums, and a running minimum two-level over blocks."""
    from pyspark.sql import Window

    from quillon.operators.timeseries import BLOCK

    rows = positioned(df, [value], order)
    st = rows.agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).first()
    z = rows.select("pos", ((F.col(value) - F.lit(st["m"])) / F.lit((st["s"] or 0.0) + 1e-12)).alias("z"))
    r = running(z, {"s": F.col("z")}).withColumn("rm", F.col("s") / (F.col("pos") + 1))
    step = (F.col("z") - F.col("rm") if direction == "up" else F.col("rm") - F.col("z")) - F.lit(ph_delta)
    c = running(r.select("pos", step.alias("d")), {"c": F.col("d")}).select("pos", "c").withColumn("b", F.floor(F.col("pos") / BLOCK))
    low = c.groupBy("b").agg(F.min("c").alias("m"))
    offs = low.select("b", F.least(F.lit(0.0), F.min("m").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).alias("o"))
    w = Window.partitionBy("b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    full = c.join(offs, "b").withColumn("mn", F.least(F.min("c").over(w), F.coalesce("o", F.lit(0.0)), F.lit(0.0)))
    alarm = F.col("c") - F.col("mn") > ph_lambda
    s = full.agg(F.min_by(F.struct("pos", "c", "mn"), F.when(alarm, F.col("pos"))).alias("hit"), F.max_by(F.struct("pos", "c", "mn"), "pos").alias("last"), F.count("*").alias("n"))

    def close(x):
        plain = lambda v: v.asDict() if hasattr(v, "asDict") else v
        hit, last = plain(x["hit"]), plain(x["last"])
        use = hit or last
        if x["n"] < 20:  # too few to judge
            return dict(detected=False, direction=direction, cumulative_value=0.0, delta=ph_delta, lambda_=ph_lambda)
        return dict(detected=hit is not None, direction=direction, change_idx=hit["pos"] if hit else None, cumulative_value=round(use["c"], 4), min_cumulative=round(use["mn"], 4), delta=ph_delta, lambda_=ph_lambda)

    return finish(s, (), close, "detected boolean, direction string, change_idx long, cumulative_value double, min_cumulative double, delta double, lambda_ double")


def compute_psi(reference: DataFrame, current: DataFrame, value: str, n_bins: int = PSI_BINS) -> DataFrame:
    """A row per bin with its terms and the total; values outside the reference's range count only in the denominator."""
    ref, cur = clean(reference, [value]), clean(current, [value])
    edges = sorted(set(percentiles(ref, [i / n_bins for i in range(n_bins + 1)])[1]))
    if len(edges) < 3:
        lo, hi = ref.agg(F.min(value), F.max(value)).first()
        edges = list(np.linspace(lo, hi, n_bins + 1))
    k = len(edges) - 1
    inside = (F.col(value) >= edges[0]) & (F.col(value) <= edges[-1])
    at = F.least(F.lit(k - 1), F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(value))) - 1)
    count = lambda d, name: d.withColumn("bin", F.when(inside, at)).groupBy("bin").agg(F.count("*").alias(name))
    both = count(ref, "r").join(count(cur, "c"), "bin", "full")
    stats = both.agg(F.collect_list(F.struct(F.coalesce("bin", F.lit(-1)).alias("bin"), F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("c", F.lit(0)).alias("c"))).alias("bins"), F.sum("r").alias("nr"), F.sum("c").alias("nc"))

    def close(x):
        r, c = np.zeros(k), np.zeros(k)
        extra = 0
        for b in x["bins"]:
            b = b.asDict() if hasattr(b, "asDict") else b
            if b["bin"] >= 0:
                r[b["bin"]], c[b["bin"]] = b["r"], b["c"]
            else:
                extra = b["c"]
        out = [c.sum() + extra, r.sum()]
        rp, cp = r / out[1] + PSI_EPSILON, c / out[0] + PSI_EPSILON
        rp, cp = rp / rp.sum(), cp / cp.sum()
        term = (cp - rp) * np.log(cp / rp)
        psi = float(term.sum())
        return [dict(bin=i, bin_low=edges[i], bin_high=edges[i + 1], ref_prop=rp[i], cur_prop=cp[i], psi_contribution=term[i], psi=psi, severity=psi_severity(psi)) for i in range(k)]

    # a null bin does not join its counterpart; both land on -1 and the current one carries the count
    return finish(stats, (), close, "bin long, bin_low double, bin_high double, ref_prop double, cur_prop double, psi_contribution double, psi double, severity string")


def psi_severity(psi: float) -> str:
    for bound, word in ((0.10, "none"), (0.20, "minor"), (0.25, "moderate")):
        if psi < bound:
            return word
    return "major"


def conformal_qhat(scores: DataFrame, score: str, alpha: float) -> float:
    """The ceil((n + 1)(1 - alpha))-th smallest score, read off the value table."""
    t = value_table(scores, score)
    n = clean(scores, [score]).count()
    need(bool(n), "no calibration scores")
    k = min(max(math.ceil((n + 1) * (1 - alpha)) - 1, 0), n - 1)
    return float(t.filter((F.col("before") <= k) & (F.col("before") + F.col("cnt") > k)).first()[score])


class ConformalRegressor:
    """Split conformal intervals: prediction plus and minus the calibrated quantile of absolute residuals."""

    def __init__(self) -> None:
        self.qhats: dict[str, float] = {}
        self.n_cal = 0

    def calibrate(self, df: DataFrame, y: str, prediction: str, alphas: Sequence[float] = (0.1, 0.05)) -> ConformalRegressor:
        rows = clean(df, [y, prediction]).select(F.abs(F.col(y) - F.col(prediction)).alias("_s")).cache()
        self.n_cal = rows.count()
        self.qhats = {str(a): conformal_qhat(rows, "_s", a) for a in alphas}
        rows.unpersist()
        return self

    def predict_interval(self, df: DataFrame, prediction: str, alpha: float = 0.1) -> DataFrame:
        need(str(alpha) in self.qhats, f"not calibrated for alpha {alpha}")
        q = F.lit(self.qhats[str(alpha)])
        return df.withColumn("lower", num(prediction) - q).withColumn("upper", num(prediction) + q)

    def get_state(self) -> dict:
        return dict(qhats=dict(self.qhats), n_cal=self.n_cal)

    @classmethod
    def from_state(cls, state: dict):
        out = cls()
        out.qhats, out.n_cal = dict(state["qhats"]), state["n_cal"]
        return out


class ConformalClassifier(ConformalRegressor):
    """Sets of classes whose probability is at least 1 - q; probabilities are an array column, classes its positions."""

    def calibrate(self, df: DataFrame, y: str, probabilities: str, alphas: Sequence[float] = (0.1, 0.05)) -> ConformalClassifier:
        rows = df.select((1 - F.get(probabilities, F.col(y).cast("int"))).alias("_s")).filter("_s IS NOT NULL").cache()
        self.n_cal = rows.count()
        self.qhats = {str(a): conformal_qhat(rows, "_s", a) for a in alphas}
        rows.unpersist()
        return self

    def predict_sets(self, df: DataFrame, probabilities: str, alpha: float = 0.1) -> DataFrame:
        need(str(alpha) in self.qhats, f"not calibrated for alpha {alpha}")
        at_least = F.lit(1 - self.qhats[str(alpha)])
        sets: Column = F.filter(F.sequence(F.lit(0), F.size(probabilities) - 1), lambda i: F.get(F.col(probabilities), i) >= at_least)
        return df.withColumn("prediction_set", sets)


def compute_conformal(model, calibration: DataFrame, y: str, task_type: str, alphas: Sequence[float] = (0.1, 0.05), prediction: str = "prediction", probability: str = "probability"):
    """Calibrate on what a Spark ML model (transform) gives for held-out rows."""
    scored = model.transform(calibration)
    if task_type == "classification":
        if scored.schema[probability].dataType.typeName() != "array":
            from pyspark.ml.functions import vector_to_array

            scored = scored.withColumn(probability, vector_to_array(probability))
        return ConformalClassifier().calibrate(scored, y, probability, alphas)
    return ConformalRegressor().calibrate(scored, y, prediction, alphas)
