"""Approximate nearest neighbours: a forest of random-projection trees.

Trees are grown on the driver from at most about SAMPLE rows (chosen by a hash of the vector); every split
is the hyperplane between two random points, at the median. Their size is bounded by the sample, so the
forest is broadcast. Every row is then indexed into one leaf per tree. A query walks all trees through one
shared priority queue, nearest margin first, until the leaves taken hold `search_share` of the rows (and
`trees` times k + 1 rows, so that k different ones are among them), counting overlap. Rows of a leaf lie in
chunks of about CHUNK, dealt by a hash, and a chunk's queries in as many parts as keep them under ASKED, so no
task holds a whole leaf of a large table. A chunk ranks its rows by a matrix product, scores those within
rounding of its best k + 1 exactly in double precision, and the chunks' answers are merged per query.

How large a share is needed depends on the vectors: clustered ones reach a recall of 0.9 with a few per cent,
vectors that lie evenly on a sphere of many dimensions only with most of the table (tests/llm/recall.py
measures both).

Equal vectors are folded into one row with their 11 smallest identifiers before indexing (a result never
needs more), so copies cannot make a leaf that no plane can split.

Defined cases: vectors that are null, zero, hold null or non-finite components, or differ in length from
most of the sample, and rows with a null vec_id take no part; repeated identifiers of one vector count once; ties go to the smaller vec_id; fewer
candidates than k give them all; an empty table gives an empty result. Further columns are ignored, whatever
their names; vectors may be of any length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm._base import map_batches, materialize, table

TREES = 4
LEAF = 96  # of sample rows
SAMPLE = 20_000
SEARCH_SHARE = 0.05  # rows of the leaves taken, overlap included, as a share of all rows
SPHERE_SHARE = 1.6  # the same for vectors without clusters, which op2's table holds: about 87 % of different rows
CHUNK = 4096
ASKED = 16_384
K = 10


class Forest:
    """Trees as arrays: per node a plane (normal, threshold) and children; negative children are leaves."""

    def __init__(self, normals: np.ndarray, cuts: np.ndarray, children: np.ndarray, roots: list[int], n_leaves: list[int]):
        self.normals, self.cuts, self.children, self.roots, self.n_leaves = normals, cuts, children, roots, n_leaves

    @classmethod
    def grow(cls, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 11) -> Forest:
        rng = np.random.default_rng(seed)
        normals, cuts, children, roots, n_leaves = [], [], [], [], []
        for _ in range(trees):
            leaves = 0
            slot = [None]  # where the parent wants this node's number
            work = [(np.arange(len(sample)), slot, 0)]
            while work:
                rows, at, side = work.pop()
                plane = cls._plane(sample[rows], rng) if len(rows) > leaf else None
                if plane is None:
                    at[side] = -1 - leaves
                    leaves += 1
                    continue
                normal, cut, right = plane
                pair = [None, None]
                at[side] = len(normals)
                normals.append(normal)
                cuts.append(cut)
                children.append(pair)
                work += [(rows[~right], pair, 0), (rows[right], pair, 1)]
            roots.append(slot[0])
            n_leaves.append(leaves)
        dim = sample.shape[1] if sample.ndim == 2 else 0
        return cls(np.array(normals).reshape(-1, dim), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), roots, n_leaves)

    @staticmethod
    def _plane(points: np.ndarray, rng: np.random.Generator):
        for _ in range(3):
            a, b = points[rng.choice(len(points), 2, replace=False)]
            normal = a - b
            size = np.linalg.norm(normal)
            if size == 0:
                continue
            along = points @ (normal / size)
            cut = float(np.median(along))
            right = along > cut
            if 0 < right.sum() < len(points):
                return normal / size, cut, right
        return None

    def leaves_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree."""
        out = np.zeros((len(points), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            work = [(np.arange(len(points)), root)]
            while work:
                rows, node = work.pop()
                if node < 0:
                    out[rows, t] = -1 - node
                elif len(rows):
                    right = points[rows] @ self.normals[node] > self.cuts[node]
                    work += [(rows[~right], int(self.children[node, 0])), (rows[right], int(self.children[node, 1]))]
        return out

    def search(self, point: np.ndarray, sizes: list[np.ndarray], enough: float) -> list[tuple[int, int]]:
        """(tree, leaf) pairs in the order of the shared queue until they hold `enough` rows; one at least."""
        margins = self.normals @ point - self.cuts if len(self.normals) else self.cuts
        queue = [(-np.inf, t, root) for t, root in enumerate(self.roots)]
        heapq.heapify(queue)
        found, held = [], 0
        while queue and (held < enough or not found):
            worst, t, node = heapq.heappop(queue)
            if node < 0:
                found.append((t, -1 - node))
                held += sizes[t][-1 - node]
                continue
            margin = margins[node]
            near = int(margin > 0)
            heapq.heappush(queue, (worst, t, int(self.children[node, near])))
            heapq.heappush(queue, (max(worst, abs(margin)), t, int(self.children[node, 1 - near])))
        return found


def _matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1 if dim is None else dim)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vec (binary, little-endian doubles) of the vectors that take part."""
    values = F.col(vector_col).cast("array<double>")
    fine = values.isNotNull() & (F.size(values) > 0) & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(values, lambda x: x != 0)
    clean = rows.select(F.col(id_col).cast("long").alias("vec_id"), values.alias("v")).filter(F.col("vec_id").isNotNull() & fine)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [x.values.to_numpy().astype("<f8").tobytes() for x in batch.column("v")]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(vectors, pa.binary())], ["vec_id", "vec"])

    return map_batches(clean, pack, "vec_id long, vec binary")


def fold_equal(rows: DataFrame, most: int = K + 1) -> DataFrame:
    """One row per different vector: vec, its `most` smallest identifiers. Folded in each map task first."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, set[int]] = {}
        for batch in batches:
            for i, vec in zip(batch.column("vec_id").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                own = kept.setdefault(vec, set())
                own.add(i)
                if len(own) > 4 * most:
                    kept[vec] = set(sorted(own)[:most])
            if len(kept) > 50_000:
                yield emit(kept)
                kept = {}
        yield emit(kept)

    def emit(kept: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array([sorted(s)[:most] for s in kept.values()], pa.list_(pa.int64()))], ["vec", "ids"])

    folded = map_batches(rows, local, "vec binary, ids array<long>")
    return folded.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"))


def best_of(x: np.ndarray, first: np.ndarray, q: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the `most` nearest rows of x (ties to the smaller `first`) and their exact distances."""
    out = []
    most = min(most, len(x))
    centre = x.mean(0)
    y = x - centre
    square = (y * y).sum(1)
    step = max(1, (1 << 22) // len(x))
    for at in range(0, len(q), step):
        p = q[at : at + step] - centre
        own = (p * p).sum(1)
        rough = square + own[:, None] - 2 * (p @ y.T)
        bound = np.partition(rough, most - 1, axis=1)[:, most - 1]
        bound += 1e-10 * (square.max() + own)  # far over the rounding of the product
        for i, (row, limit) in enumerate(zip(rough, bound, strict=True)):
            close = np.flatnonzero(row <= limit)
            score = np.sqrt(((q[at + i] - x[close]) ** 2).sum(1))
            order = np.lexsort((first[close], score))[:most]
            out.append((close[order], score[order]))
    return out


def nearest(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, search_share: float = SEARCH_SHARE, trees: int = TREES, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found, its own identifier left out."""
    folded = materialize(fold_equal(usable(rows, id_col, vector_col), k + 1))
    n = folded.count()
    cut = int(min(1.0, sample / max(n, 1)) * (1 << 20)) + 1
    picked = [r["vec"] for r in folded.filter(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < cut).select("vec").collect()]
    lengths = pd.Series([len(v) for v in picked]).mode()
    width = int(lengths.iloc[0]) if len(lengths) else 8
    points = np.array([np.frombuffer(v, "<f8") for v in sorted(picked) if len(v) == width]).reshape(-1, width // 8)
    forest = rows.sparkSession.sparkContext.broadcast(Forest.grow(points, trees))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = forest.value
        for batch in batches:
            leaves = own.leaves_of(_matrix(batch.column("vec")))
            for t in range(leaves.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaves), t)), pa.array(leaves[:, t]), batch.column("salt"), batch.column("vec"), batch.column("ids")], ["tree", "leaf", "salt", "vec", "ids"])

    fits = F.length("vec") == width
    salted = folded.filter(fits).select("vec", "ids", F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(1 << 30)).alias("salt"))
    indexed = map_batches(salted, index, "tree long, leaf long, salt long, vec binary, ids array<long>")
    sizes = [np.zeros(x, np.int64) for x in forest.value.n_leaves]
    for r in indexed.groupBy("tree", "leaf").count().collect():  # as many rows as the forest has leaves
        sizes[r["tree"]][r["leaf"]] = r["count"]
    chunks = [np.maximum(1, -(-s // chunk)) for s in sizes]
    enough = max(search_share * n, trees * (k + 1))
    query = usable(queries, id_col, vector_col).filter(fits).dropDuplicates(["vec_id"])
    shares = max(1, -(-query.count() // ASKED))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = forest.value
        for batch in batches:
            for i, vec, share in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "vec", "share")), strict=True):
                found = [(t, leaf, c) for t, leaf in own.search(np.frombuffer(vec, "<f8"), sizes, enough) for c in range(int(chunks[t][leaf]))]
                t, leaf, part = zip(*found, strict=True)
                m = len(t)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(leaf, pa.int64()), pa.array(part, pa.int64()), pa.array([share] * m, pa.int64()), pa.array([i] * m, pa.int64()), pa.array([vec] * m, pa.binary())], ["tree", "leaf", "part", "share", "query_id", "vec"])

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in index(batches):
            t, leaf = int(batch.column("tree")[0].as_py()) if batch.num_rows else 0, batch.column("leaf").to_numpy()
            part = batch.column("salt").to_numpy() % chunks[t][leaf]
            for share in range(shares):
                yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("leaf"), pa.array(part, pa.int64()), pa.array(np.full(len(leaf), share)), batch.column("vec"), batch.column("ids")], ["tree", "leaf", "part", "share", "vec", "ids"])

    asked = map_batches(query.withColumn("share", F.pmod(F.xxhash64("vec_id"), F.lit(shares))), route, "tree long, leaf long, part long, share long, query_id long, vec binary")
    held = map_batches(salted, chunked, "tree long, leaf long, part long, share long, vec binary, ids array<long>")

    def rerank(key, held: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(ask):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "ids": pd.Series([], dtype=object), "score": pd.Series([], dtype="float64")})
        x = np.frombuffer(b"".join(held["vec"]), "<f8").reshape(len(held), -1)
        q = np.frombuffer(b"".join(ask["vec"]), "<f8").reshape(len(ask), -1)
        ids = held["ids"].to_numpy()
        found = best_of(x, np.array([i[0] for i in ids]), q, k + 1)
        at = np.concatenate([c for c, _ in found])
        return pd.DataFrame({"query_id": np.repeat(ask["query_id"].to_numpy(), [len(c) for c, _ in found]), "ids": ids[at], "score": np.concatenate([s for _, s in found])})

    where = ["tree", "leaf", "part", "share"]
    near = held.groupBy(*where).cogroup(asked.groupBy(*where)).applyInPandas(rerank, "query_id long, ids array<long>, score double")
    each = near.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.col("vec_id") % 100 == 0), search_share=SPHERE_SHARE)
