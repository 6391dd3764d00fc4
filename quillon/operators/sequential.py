"""Anytime-valid inference: e-processes and confidence sequences as columns over an ordered stream."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.parametric import need
from quillon.operators.timeseries import positioned, running
from quillon.plans.stats import clean, ordered

E_CAP = 1e15


def gaussian_columns(t: Column, s: Column, total: Column, sigma: float, rho: float, alpha: float) -> dict[str, Column]:
    s2, r2 = sigma * sigma, rho * rho
    log_e = -0.5 * F.log1p(t * (r2 / s2)) + r2 * s * s / (2 * s2 * (s2 + t * r2))
    width = F.lit(sigma) / t * F.sqrt(2 * (s2 + t * r2) / r2 * (math.log(1 / alpha) + 0.5 * F.log1p(t * (r2 / s2))))
    return shared_columns(t, total, log_e, width, alpha)


def self_normalized_columns(t: Column, s: Column, total: Column, squares: Column, rho: float, min_obs: int, alpha: float) -> dict[str, Column]:
    r2 = rho * rho
    v = F.greatest(squares - total * total / t, F.lit(1e-10))
    log_e = F.when(t < min_obs, 0.0).otherwise(-0.5 * F.log1p(t * r2 / v) + r2 * s * s / (2 * v * (v / t + r2)))
    width = F.sqrt(2 * (v / t) * (v / t + r2) / r2 * (math.log(1 / alpha) + 0.5 * F.log1p(t * r2 / v))) / F.sqrt(t)
    return shared_columns(t, total, log_e, F.when(t >= min_obs, width), alpha)


def shared_columns(t: Column, total: Column, log_e: Column, width: Column, alpha: float) -> dict[str, Column]:
    return {"t": t.cast("long"), "x_bar": total / t, "log_e": log_e, "e_value": F.when(log_e > 34, E_CAP).otherwise(F.least(F.lit(E_CAP), F.exp(log_e))), "decision": log_e >= math.log(1 / alpha), "cs_lower": total / t - width, "cs_upper": total / t + width}


class GaussianMeanEProcess:
    """Known-sigma mixture e-process against mean mu0."""

    def __init__(self, mu0: float = 0.0, sigma: float = 1.0, rho: float = 1.0):
        need(sigma > 0 and rho > 0, "sigma and rho must be positive")
        self.mu0, self.sigma, self.rho = mu0, sigma, rho

    def history(self, df: DataFrame, value: str, order: Sequence[str], alpha: float = 0.05) -> DataFrame:
        """One row per observation: t, x_bar, log_e, e_value, decision, cs_lower, cs_upper."""
        r = running(positioned(df, [value], order), {"s": F.col(value) - F.lit(self.mu0), "total": F.col(value)})
        return r.select(*(c.alias(n) for n, c in gaussian_columns((F.col("pos") + 1).cast("double"), F.col("s"), F.col("total"), self.sigma, self.rho, alpha).items()))

    def summary(self, df: DataFrame, value: str, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
        """The state after all observations; order does not matter to it, so one aggregate gives it."""
        s = clean(df, [value], by=by).groupBy(*by).agg(F.count("*").cast("double").alias("t"), F.sum(F.col(value) - F.lit(self.mu0)).alias("s"), F.sum(value).alias("total"))
        return s.select(*by, *(c.alias(n) for n, c in gaussian_columns(F.col("t"), F.col("s"), F.col("total"), self.sigma, self.rho, alpha).items()))


class SelfNormalizedMeanEProcess:
    """Unknown variance; no evidence before min_obs observations."""

    def __init__(self, mu0: float = 0.0, rho: float = 1.0, min_obs: int = 5):
        need(rho > 0, "rho must be positive")
        self.mu0, self.rho, self.min_obs = mu0, rho, min_obs

    def _columns(self, alpha: float) -> list[Column]:
        made = self_normalized_columns(F.col("t"), F.col("s"), F.col("total"), F.col("squares"), self.rho, self.min_obs, alpha)
        return [c.alias(n) for n, c in made.items()]

    def history(self, df: DataFrame, value: str, order: Sequence[str], alpha: float = 0.05) -> DataFrame:
        r = running(positioned(df, [value], order), {"s": F.col(value) - F.lit(self.mu0), "total": F.col(value), "squares": F.col(value) * F.col(value)})
        return r.withColumn("t", (F.col("pos") + 1).cast("double")).select(*self._columns(alpha))

    def summary(self, df: DataFrame, value: str, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
        s = clean(df, [value], by=by).groupBy(*by).agg(F.count("*").cast("double").alias("t"), F.sum(F.col(value) - F.lit(self.mu0)).alias("s"), F.sum(value).alias("total"), F.sum(F.col(value) * F.col(value)).alias("squares"))
        return s.select(*by, *self._columns(alpha))


class TwoSampleEProcess:
    """First-in-first-out pairs of arms A and B feed a self-normalised e-process on their differences."""

    def __init__(self, rho: float = 0.5, min_pairs: int = 5):
        self.inner = SelfNormalizedMeanEProcess(0.0, rho, min_pairs)

    def pairs(self, df: DataFrame, value: str, group: str, order: Sequence[str], labels: tuple[str, str]) -> DataFrame:
        rows = clean(df, [value], [group, *order])
        arm = lambda x, name: ordered(rows.filter(F.col(group).cast("string") == x), order).select("pos", F.col(value).alias(name))
        return arm(labels[0], "xa").join(arm(labels[1], "xb"), "pos").withColumn("d", F.col("xa") - F.col("xb"))

    def history(self, df: DataFrame, value: str, group: str, order: Sequence[str], labels: tuple[str, str], alpha: float = 0.05) -> DataFrame:
        return self.inner.history(self.pairs(df, value, group, order, labels), "d", ["pos"], alpha)

    def summary(self, df: DataFrame, value: str, group: str, order: Sequence[str], labels: tuple[str, str], alpha: float = 0.05) -> DataFrame:
        return self.inner.summary(self.pairs(df, value, group, order, labels), "d", alpha)
