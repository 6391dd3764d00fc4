"""Order statistics of all differences x - y of two samples, without forming the pairs.

Both samples are cut into bins at quantiles, whose extremes enclose the wanted rank between two differences. Each range of
x then meets only the y whose differences with it may lie there, so counts at any thresholds between are local to
the ranges. A random sample of the pairs that are left proposes thresholds, exact counts at these narrow the bracket, and
the last few pairs are formed. The sample decides how many passes that takes, never the result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.blocks import blocks, fold, gather, places

BINS = 255  # edges of the first cut
RANGE = 50_000  # different x that a range aims at
DRAWN = 2_000  # pairs that a range draws a pass


def firsts(x: np.ndarray, y: np.ndarray, d: float) -> np.ndarray:
    """For each x the first place in rising y where x - y, as rounded, is at most d."""
    at = np.searchsorted(y, x - d)
    m = len(y)
    ok = ((at == 0) | (x - y[np.maximum(at, 1) - 1] > d)) & ((at == m) | (x - y[np.minimum(at, m - 1)] <= d))
    bad = np.flatnonzero(~ok)  # x - d was rounded across a value
    low, high, xb = np.zeros(len(bad), np.int64), np.full(len(bad), m), x[bad]
    while (low < high).any():
        mid = (low + high) // 2
        go = low < high
        hit = go & (xb - y[np.minimum(mid, m - 1)] <= d)
        low, high = np.where(go & ~hit, mid + 1, low), np.where(hit, mid, high)
    at[bad] = low
    return at


class Differences:
    """a and b: value v, w (rows with it); each value once. low < the differences of ranks k1 to k2 <= high."""

    def __init__(self, a: DataFrame, b: DataFrame, edges: tuple[list[float], list[float]], k1: int, k2: int):
        both = a.select("v", F.col("w").cast("double"), F.lit(1.0).alias("own")).union(b.select("v", F.col("w").cast("double"), F.lit(0.0)))
        held = blocks(both)
        cut = [np.unique(np.asarray(e, float)) for e in edges]

        def bins(each: Iterator[np.ndarray]) -> list:
            out = [np.tile(np.array([[np.inf], [-np.inf], [0.0], [0.0]]), 2 * len(e) + 1) for e in cut]
            for v, w, own in each:
                for side, o in enumerate(out):
                    at = own == 1.0 - side
                    j = places(v[at], cut[side])
                    np.minimum.at(o[0], j, v[at])
                    np.maximum.at(o[1], j, v[at])
                    o[2] += np.bincount(j, w[at], o.shape[1])
                    o[3] += np.bincount(j, minlength=o.shape[1])
            return out

        made = fold(held, 3, bins)
        (amin, amax, aw, an), (bmin, bmax, bw, _) = ([f([m[side][i] for m in made], axis=0) for i, f in enumerate((np.min, np.max, np.sum, np.sum))] for side in (0, 1))
        fa, fb = np.flatnonzero(aw), np.flatnonzero(bw)  # bins with rows
        weight = np.multiply.outer(aw[fa].astype(np.int64), bw[fb].astype(np.int64)).ravel()

        def nth(d: np.ndarray, k: int) -> float:
            order = np.argsort(d, axis=None)
            return float(d.ravel()[order[np.searchsorted(np.cumsum(weight[order]), k)]])

        self.low = float(np.nextafter(nth(np.subtract.outer(amin[fa], bmax[fb]), k1), -np.inf))
        self.high = float(nth(np.subtract.outer(amax[fa], bmin[fb]), k2))
        parts = int(min(2 * BINS, max(8, an.sum() // RANGE)))
        run = np.cumsum(an)
        of = np.minimum(((run - an / 2) * parts / run[-1]).astype(np.int64), parts - 1)  # the range of each bin of x
        ids = np.unique(of[fa])
        xmin, xmax = (np.array([f(v[fa][of[fa] == i]) for i in ids]) for f, v in ((np.min, amin), (np.max, amax)))
        all_under = np.subtract.outer(xmax, bmin) <= self.low  # whole bins of y whose differences are counted at once
        needs = ~all_under & (np.subtract.outer(xmin, bmax) <= self.high) & (bw > 0)
        above = {int(i): int(bw[u & (bw > 0)].astype(np.int64).sum()) for i, u in zip(ids, all_under, strict=True)}
        met = [ids[needs[:, j]] for j in range(len(bw))]  # the ranges that a bin of y goes to
        times = np.array([len(m) for m in met])
        flat, start = np.concatenate(met), np.cumsum(times) - times

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for value in batch.column(0):
                    v, w, own = np.frombuffer(value.as_buffer()).reshape(3, -1)
                    at = own == 1.0
                    j = places(v[~at], cut[1])
                    rep = np.repeat(np.arange(len(j)), times[j])
                    place = np.arange(len(rep)) - np.repeat(np.cumsum(times[j]) - times[j], times[j])
                    r = np.r_[of[places(v[at], cut[0])], flat[start[j][rep] + place]]
                    cols = [r, np.r_[v[at], v[~at][rep]], np.r_[w[at], w[~at][rep]], np.arange(len(r)) < at.sum()]
                    yield pa.record_batch([pa.array(c) for c in cols], ["range", "v", "w", "own"])

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("v")
            own, i = pdf["own"].to_numpy(bool), int(pdf["range"].iloc[0])
            v, w = pdf["v"].to_numpy(), pdf["w"].to_numpy().astype(np.int64)
            return pd.DataFrame({"block": [pickle.dumps((i, above[i], v[own], w[own], v[~own], np.r_[0, np.cumsum(w[~own])]))]})

        self.held = held.mapInArrow(deal, "range long, v double, w double, own boolean").repartition(parts, "range").groupBy("range").applyInPandas(pack, "block binary").cache()
        self.first = held

    def each(self, fn) -> list:
        """fn of each range: its number, the weight of y counted at once, x, weights of x, rising y and their running weights."""
        return [r for part in gather(self.held, lambda blobs: [fn(*pickle.loads(b)) for b in blobs]) for r in part]

    def counts(self, at: list[float]) -> list[int]:
        """Pairs with x - y <= d for each d in at, between the first low and high."""

        def count(i, base, x, wx, y, cy):
            return [int((wx * (base + cy[-1] - (cy[firsts(x, y, d)] if len(y) else 0))).sum()) for d in at]

        return [sum(c) for c in zip(*self.each(count), strict=True)]

    def survey(self, low: float, high: float, turn: int) -> tuple[int, int, int, np.ndarray, np.ndarray]:
        """Pairs at or under low; pairs in (low, high]; different ones; differences drawn from these, with weights."""

        def look(i, base, x, wx, y, cy):
            if not len(y):
                return int((wx * base).sum()), 0, 0, np.empty(0)
            first, last = firsts(x, y, high), firsts(x, y, low)
            per = wx * (cy[last] - cy[first])
            run = np.cumsum(per)
            total, rng = int(run[-1]), np.random.default_rng([turn, i])
            d = np.empty(0)
            if total:
                ix = np.searchsorted(run, rng.integers(0, total, DRAWN), "right")
                d = x[ix] - y[np.searchsorted(cy, rng.integers(cy[first[ix]], cy[last[ix]]), "right") - 1]
            return int((wx * (base + cy[-1] - cy[last])).sum()), total, int((last - first).sum()), d

        found = self.each(look)
        weights = [np.full(len(f[3]), f[1] / max(len(f[3]), 1)) for f in found]
        return sum(f[0] for f in found), sum(f[1] for f in found), sum(f[2] for f in found), np.concatenate([f[3] for f in found]), np.concatenate(weights)

    def within(self, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """The different differences in (low, high], rising, with their numbers."""

        def form(i, base, x, wx, y, cy):
            if not len(y):
                return np.empty(0), np.empty(0, np.int64)
            first, last = firsts(x, y, high), firsts(x, y, low)
            k = last - first
            ix = np.repeat(np.arange(len(x)), k)
            iy = np.arange(len(ix)) - np.repeat(np.cumsum(k) - k, k) + first[ix]
            d, at = np.unique(x[ix] - y[iy], return_inverse=True)
            w = np.zeros(len(d), np.int64)
            np.add.at(w, at, wx[ix] * (cy[iy + 1] - cy[iy]))
            return d, w

        found = self.each(form)
        d, w = (np.concatenate([f[s] for f in found]) for s in (0, 1))
        order = np.argsort(d)
        return d[order], w[order]

    def next_over(self, d: float) -> float:
        """The least difference over d, which lies within the first bracket."""

        def least(i, base, x, wx, y, cy):
            at = firsts(x, y, d) if len(y) else np.zeros(len(x), np.int64)
            return float(np.min(x[at > 0] - y[at[at > 0] - 1], initial=np.inf))

        return min(self.each(least))

    def select(self, k1: int, k2: int, most: int, gap: float) -> tuple[float, float]:
        """The differences of ranks k1 and k2 = k1 or k1 + 1; no nearer than `gap` if that is not 0. The driver takes at most `most` of them."""
        low, high, turn = self.low, self.high, 0
        while True:
            under, inside, pairs, drawn, weights = self.survey(low, high, turn)
            if pairs <= most:
                d, w = self.within(low, high)
                run = under + np.cumsum(w)
                one, two = (float(d[np.searchsorted(run, k)]) if k <= under + inside else None for k in (k1, k2))
                return one, self.next_over(high) if two is None else two
            if np.nextafter(low, np.inf) >= high or high - low <= gap:
                return high, high if under + inside >= k2 or high - low <= gap else self.next_over(high)
            order = np.argsort(drawn)
            drawn, run = drawn[order], np.cumsum(weights[order])
            error = np.sqrt((weights**2).sum()) / run[-1]
            steps = error * 4.0 ** np.arange(5)
            aim = (k1 - under - 0.5) / inside + np.r_[-steps, 0, steps]
            some = drawn[np.minimum(np.searchsorted(run, np.clip(aim, 0, 1) * run[-1]), len(drawn) - 1)]
            at = np.unique(np.r_[some, np.nextafter(some, -np.inf)])
            at = [float(v) for v in at if low < v < high]
            for v, c in zip(at, self.counts(at), strict=True):
                if c < k1:
                    low = max(low, v)
                else:
                    high = min(high, v)
            turn += 1

    def close(self) -> None:
        self.held.unpersist()
        self.first.unpersist()
