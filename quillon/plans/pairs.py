"""Counts over pairs of rows ordered two ways (concordance), without forming pairs.

Both values are dealt into blocks at fixed numbers of quantiles. Pairs in different blocks of both are counted from the
grid of block totals, which has a fixed size; pairs that share a block are counted inside it by halving, one task a block.
A value as frequent as a quantile step has a block of its own, where all pairs are ties, so hot values need no task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.stats import EDGES, edges_under

FOUND = "less double, more double, tie double"


def ahead(u: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """Sum of a_i b_j over the pairs with u_i < u_j and v_i < v_j."""
    order = np.lexsort((-v, u))  # equal u in falling v: never counted
    rank, a, b = np.unique(v, return_inverse=True)[1][order], a[order], b[order]
    m, pos, total = len(a), np.arange(len(a)), 0.0
    for s in range(max(m - 1, 0).bit_length()):
        left, block = (pos >> s) % 2 == 0, pos >> (s + 1)
        at = np.argsort(((block * m + rank) << 1) + left)  # by halves' value; at equal values the right half first
        seen = np.cumsum(np.where(left, a, 0.0)[at])
        total += float((np.where(left, 0.0, b)[at] * (seen - np.r_[0.0, seen][block << (s + 1)])).sum())
    return total


def inside(u: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict:
    """Weights of the pairs with u_i < u_j by the order of v."""
    less, more = ahead(u, v, a, b), ahead(u, -v, a, b)
    order = np.argsort(u, kind="stable")
    first = np.searchsorted(u[order], u[order])
    return dict(less=less, more=more, tie=float((b[order] * np.r_[0.0, np.cumsum(a[order])][first]).sum()) - less - more)


def block_of(c: str, edges: Sequence[float] | None) -> Column:
    """Even numbers between the edges, odd ones at an edge."""
    e = sorted(set(edges or []))
    return edges_under(F.col(c), e) + edges_under(F.col(c), e, equal=True)


def between_blocks(grid: pd.DataFrame) -> dict:
    """The pairs decided by block numbers alone; blocks of one value tie."""
    size = 2 * EDGES + 1
    a, b = np.zeros((size, size)), np.zeros((size, size))
    at = grid["bx"].to_numpy(int), grid["by"].to_numpy(int)
    a[at], b[at] = grid["a"].to_numpy(float), grid["b"].to_numpy(float)
    later = np.vstack([b[::-1].cumsum(0)[::-1][1:], np.zeros((1, size))])  # right weights of later x blocks
    up = later[:, ::-1].cumsum(1)[:, ::-1] - later
    down = later.cumsum(1) - later
    return dict(less=float((a * up).sum()), more=float((a * down).sum()), tie=float((a * later)[:, 1::2].sum()))


def pair_order(rows: DataFrame, x: str, y: str, left: Column, right: Column) -> dict:
    """less, more, tie: sums of left_i * right_j over pairs with x_i < x_j where y_i is under, over or equal to y_j.

    x and y are finite doubles. The driver gets quantiles and at most (2 EDGES + 1)^2 block totals.
    """
    points = rows.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.sum(left.cast("double")).alias("a"), F.sum(right.cast("double")).alias("b")).cache()
    steps = [i / (EDGES + 1) for i in range(1, EDGES + 1)]
    edges = points.agg(*(F.percentile_approx(c, steps, 2000).alias(c) for c in ("x", "y"))).first()
    dealt = points.withColumn("bx", block_of("x", edges["x"])).withColumn("by", block_of("y", edges["y"]))
    grid = dealt.groupBy("bx", "by").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()
    in_x = dealt.filter(F.col("bx") % 2 == 0).select(F.lit(0).alias("side"), F.col("bx").alias("block"), F.col("x").alias("u"), F.col("y").alias("v"), "a", "b")
    in_y = dealt.filter(F.col("by") % 2 == 0).groupBy("by", "bx", "y").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    in_y = in_y.select(F.lit(1).alias("side"), F.col("by").alias("block"), F.col("bx").cast("double").alias("u"), F.col("y").alias("v"), "a", "b")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([inside(*(pdf[c].to_numpy(float) for c in ("u", "v", "a", "b")))])

    found = in_x.unionByName(in_y).groupBy("side", "block").applyInPandas(count, FOUND).agg(*(F.sum(c).alias(c) for c in ("less", "more", "tie"))).first()
    points.unpersist()
    far = between_blocks(grid)
    return {c: far[c] + (found[c] or 0.0) for c in far}
