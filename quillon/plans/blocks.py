"""Rows held as numpy blocks for many passes over few columns, exact medians of what is computed from them, and percentiles.

An exact percentile of Spark keeps all different values in one task's hash map. Here the values are counted between
edges that a sample suggests, the edges are moved until few values are left between the two that enclose the middle, and
only those come to the driver. The sample decides how many passes that takes, never the result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

ROWS = 8192  # rows of a block
STEPS = 256  # edges of a pass
SAMPLE = 20_000  # rows, or values, that edges are chosen from
MOST = 500_000  # values that the driver takes

Values = Callable[[np.ndarray], np.ndarray]


def blocks(rows: DataFrame) -> DataFrame:
    """The double columns of rows, without nulls, as cached matrices of a column a line."""
    width = len(rows.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.vstack([c.to_numpy(zero_copy_only=False) for c in b.columns]) if b.num_rows else np.empty((width, 0))
            made = [np.ascontiguousarray(x[:, i : i + ROWS]).tobytes() for i in range(0, b.num_rows, ROWS)]
            yield pa.record_batch([pa.array(made, pa.binary())], ["block"])

    return rows.mapInArrow(cut, "block binary").cache()


def gather(held: DataFrame, fn: Callable[[Iterator[pa.Buffer]], object]) -> list:
    """What fn makes of each partition's binary values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (v.as_buffer() for b in batches for v in b.column(0))
        yield pa.record_batch([pa.array([pickle.dumps(fn(each))], pa.binary())], ["made"])

    return [pickle.loads(r["made"]) for r in held.mapInArrow(run, "made binary").collect()]


def fold(held: DataFrame, width: int, fn: Callable[[Iterator[np.ndarray]], object]) -> list:
    """What fn makes of each partition's blocks."""
    return gather(held, lambda each: fn(np.frombuffer(v).reshape(width, -1) for v in each))


def sample_rows(held: DataFrame, width: int, n: int, most: int = SAMPLE) -> np.ndarray:
    """About `most` of the n rows, evenly over each partition."""
    step = max(1, n // most)

    def take(each: Iterator[np.ndarray]) -> np.ndarray:
        skip, some = int(np.random.default_rng(TaskContext.get().partitionId()).integers(step)), [np.empty((width, 0))]
        for x in each:
            some.append(x[:, skip::step])
            skip = (skip - x.shape[1]) % step
        return np.hstack(some)

    return np.hstack([np.empty((width, 0)), *fold(held, width, take)])


def places(v: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Even numbers between the sorted edges, odd ones at an edge."""
    at = np.searchsorted(edges, v)
    return 2 * at + (edges[np.minimum(at, len(edges) - 1)] == v)


def block_median(held: DataFrame, width: int, n: int, values: Values, guess: np.ndarray, most: int = MOST) -> float:
    """The exact median of values(block) over all n rows; guess holds values of a sample, in any order."""
    ranks = sorted({(n - 1) // 2, n // 2})
    q = 0.5 + np.linspace(-1, 1, STEPS) * min(0.5, 3.0 / np.sqrt(max(len(guess), 1)))
    edges = np.unique(np.quantile(guess, q, method="nearest")) if len(guess) else np.array([0.0])
    while True:

        def count(each: Iterator[np.ndarray]) -> np.ndarray:
            total = np.zeros(2 * len(edges) + 1, np.int64)
            for x in each:
                v = values(x)
                under, over = v < edges[0], v > edges[-1]
                total[0] += under.sum()
                total[-1] += over.sum()
                total += np.bincount(places(v[~(under | over)], edges), minlength=len(total))
            return total

        total = sum(fold(held, width, count))
        run = np.cumsum(total)
        at = [int(np.searchsorted(run, k, "right")) for k in ranks]
        open_ = sorted({a for a in at if a % 2 == 0})
        left = int(sum(total[a] for a in open_))

        def within(v: np.ndarray) -> np.ndarray:
            low = edges[open_[0] // 2 - 1] if open_[0] else -np.inf
            high = edges[open_[-1] // 2] if open_[-1] // 2 < len(edges) else np.inf
            v = v[(v >= low) & (v <= high)]
            return v[np.isin(places(v, edges), open_)]

        if left <= most:
            inside = np.sort(np.concatenate(fold(held, width, lambda each: np.concatenate([np.empty(0), *(within(values(x)) for x in each)])))) if open_ else np.empty(0)
            base, found = 0, {}
            for a in open_:
                found[a] = inside[base : base + total[a]]
                base += total[a]
            return float(np.mean([edges[a // 2] if a % 2 else found[a][k - run[a] + total[a]] for k, a in zip(ranks, at, strict=True)]))
        step = max(1, left // SAMPLE)

        def some(each: Iterator[np.ndarray]) -> np.ndarray:
            rng = np.random.default_rng(TaskContext.get().partitionId())
            return np.concatenate([np.empty(0), *(v[rng.random(len(v)) * step < 1] for v in (within(values(x)) for x in each))])

        drawn = np.concatenate(fold(held, width, some))
        bounds = [edges[i] for a in open_ for i in (a // 2 - 1, a // 2) if 0 <= i < len(edges)]
        edges = np.unique(np.concatenate([bounds, np.quantile(drawn, np.linspace(0, 1, STEPS), method="nearest")])) if len(drawn) else edges


def percentiles(rows: DataFrame, probs: Sequence[float] | Callable[[int], Sequence[float]], most: int = MOST) -> tuple[int, list[float]]:
    """The number of values in the one column of rows, and their exact percentiles as Spark's percentile interpolates them.

    probs may depend on the number. Many values are counted in bins between edges; only the bins that hold wanted ranks are sorted, each in its own task.
    """
    held = blocks(rows)
    n = sum(fold(held, 1, lambda each: sum(x.shape[1] for x in each)))
    if not n:
        held.unpersist()
        return 0, []
    position = [(n - 1) * p for p in (probs(n) if callable(probs) else probs)]
    if not position:
        held.unpersist()
        return n, []
    ranks = np.unique([f(p) for p in position for f in (np.floor, np.ceil)]).astype(np.int64)
    if n <= most:
        at = dict(zip(ranks.tolist(), np.sort(np.concatenate([np.empty(0), *fold(held, 1, lambda each: np.concatenate([np.empty(0), *(x[0] for x in each)]))]))[ranks].tolist(), strict=True))
    else:
        edges = np.unique(np.quantile(sample_rows(held, 1, n, 2 * SAMPLE)[0], np.linspace(0, 1, 16 * STEPS), method="nearest"))
        size = 2 * len(edges) + 1
        total = sum(fold(held, 1, lambda each: sum((np.bincount(places(x[0], edges), minlength=size) for x in each), np.zeros(size, np.int64))))
        run = np.cumsum(total)
        bins = np.searchsorted(run, ranks, "right")
        at = {int(k): float(edges[b // 2]) for k, b in zip(ranks, bins, strict=True) if b % 2}
        inner: dict[int, list[int]] = {}
        for k, b in zip(ranks, bins, strict=True):
            if b % 2 == 0:
                inner.setdefault(int(b), []).append(int(k))
        wanted, before = np.isin(np.arange(size), list(inner)), run - total

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for value in batch.column(0):
                    v = np.frombuffer(value.as_buffer())
                    b = places(v, edges)
                    keep = wanted[b]
                    yield pa.record_batch([pa.array(b[keep]), pa.array(v[keep])], ["bin", "v"])

        def pick(pdf: pd.DataFrame) -> pd.DataFrame:
            b, v = int(pdf["bin"].iloc[0]), np.sort(pdf["v"].to_numpy())
            return pd.DataFrame({"k": inner[b], "v": v[[k - int(before[b]) for k in inner[b]]]})

        at |= {r["k"]: r["v"] for r in held.mapInArrow(spread, "bin long, v double").groupBy("bin").applyInPandas(pick, "k long, v double").collect()}
    held.unpersist()
    out = []
    for p in position:
        low, high = at[int(np.floor(p))], at[int(np.ceil(p))]
        out.append(low if low == high else (np.ceil(p) - p) * low + (p - np.floor(p)) * high)
    return n, [float(v) for v in out]
