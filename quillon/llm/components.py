"""Connected components of a distributed edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._base import materialize, spread_join

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """Rows (v, c) for every end of edges (a, b): c is the same throughout a component, one of its own ends.

    Each round hooks every vertex to its smallest neighbour, jumps pointers twice, renames the edges and
    drops those inside a component; the edge table shrinks at least by half a round and the hooks of a
    round are aggregated map-side and renamed by spread_join, so a vertex with very many edges is no hot spot.
    """
    left = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    for _ in range(MAX_ROUNDS):
        if left.isEmpty():
            return labels if labels is not None else left.select(F.col("a").alias("v"), F.col("b").alias("c"))
        ends = left.select(F.col("a").alias("v"), F.col("b").alias("u")).union(left.select("b", "a"))
        hook = ends.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("c"))
        hook = materialize(hook)
        for _ in range(2):
            hook = materialize(_follow(hook, hook, "c"), hook)
        labels = hook if labels is None else materialize(_follow(labels, hook, "c"), labels)
        old = left
        for end in ("a", "b"):
            left = materialize(_follow(left, hook, end), *([left] if end == "b" else []))
        left = materialize(left.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), left, old)
    raise RuntimeError("components did not settle")


def _follow(rows: DataFrame, hook: DataFrame, column: str) -> DataFrame:
    """rows with the vertices in `column` replaced by what they hook to."""
    to = hook.select(F.col("v").alias(column), F.col("c").alias("_to"))
    return spread_join(rows, to, column, "left").select(*(F.coalesce("_to", column).alias(c) if c == column else c for c in rows.columns))
