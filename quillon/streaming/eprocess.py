"""Streaming e-processes and Page-Hinkley: a few numbers of state per key, updated per micro-batch."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def self_normalized_stream(df: DataFrame, key: str, value: str, mu0: float = 0.0, rho: float = 1.0, min_obs: int = 5, alpha: float = 0.05) -> DataFrame:
    """Per key and micro-batch the state after it: t, x_bar, log_e, decision. Evidence depends on sums only, so order inside a batch is free."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, s, total, squares = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        for f in frames:
            x = f[value].astype(float)
            t, s, total, squares = t + len(x), s + float((x - mu0).sum()), total + float(x.sum()), squares + float((x * x).sum())
        state.update((t, s, total, squares))
        log_e = 0.0
        if t >= min_obs:
            v = max(squares - total * total / t, 1e-10)
            log_e = -0.5 * math.log1p(t * rho**2 / v) + rho**2 * s * s / (2 * v * (v / t + rho**2))
        yield pd.DataFrame({key: [k[0]], "t": [t], "x_bar": [total / t if t else None], "log_e": [log_e], "decision": [log_e >= math.log(1 / alpha)]})

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull() & ~F.isnan(value))
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, t long, x_bar double, log_e double, decision boolean", "t long, s double, total double, squares double", "update", "NoTimeout")


def page_hinkley_stream(df: DataFrame, key: str, value: str, order: str, mean: float, std: float, ph_delta: float = 0.005, ph_lambda: float = 50.0) -> DataFrame:
    """Against a fixed baseline (mean, std), as a stream has no whole to standardise by; values of a micro-batch are taken in `order`."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, run, cum, low, hit = state.get if state.exists else (0, 0.0, 0.0, 0.0, -1)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        for x in rows[value].astype(float):
            z = (x - mean) / (std + 1e-12)
            t, run = t + 1, run + z
            cum += z - run / t - ph_delta
            low = min(low, cum)
            if hit < 0 and cum - low > ph_lambda:
                hit = t - 1
        state.update((t, run, cum, low, hit))
        yield pd.DataFrame({key: [k[0]], "t": [t], "cumulative_value": [cum], "detected": [hit >= 0], "change_idx": [hit]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, order, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, t long, cumulative_value double, detected boolean, change_idx long", "t long, run double, cum double, low double, hit long", "update", "NoTimeout")
