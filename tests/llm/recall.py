"""Recall of the forest by share of rows visited: python tests/llm/recall.py EMBEDDINGS.parquet, or made vectors without an argument.

Prints, per search share, the share of different rows that a query visits and the share of its 10 nearest
(by brute force) among them.
"""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parents[2]))


def measure(x: np.ndarray, shares: list[float], queries: int = 100, trees: int = 4, sample: int = 20_000) -> list[tuple[float, float, float]]:
    from quillon.llm.neighbours import Forest

    rng = np.random.default_rng(1)
    forest = Forest.grow(x[np.sort(rng.permutation(len(x))[:sample])], trees)
    leaves = forest.leaves_of(x)
    sizes = [np.bincount(leaves[:, t], minlength=n) for t, n in enumerate(forest.n_leaves)]
    out = []
    for share in shares:
        seen, hit = [], []
        for q in range(0, len(x), max(1, len(x) // queries)):
            found = np.zeros(len(x), bool)
            for t, leaf in forest.search(x[q], sizes, max(share * len(x), trees * 11)):
                found |= leaves[:, t] == leaf
            d = ((x - x[q]) ** 2).sum(1)
            d[q] = np.inf
            seen.append(found.mean())
            hit.append(found[np.argsort(d)[:10]].mean())
        out.append((share, float(np.mean(seen)), float(np.mean(hit))))
    return out


def clustered(n: int = 20_000, dim: int = 64, clusters: int = 400, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + 0.1 * rng.normal(size=(n, dim))


if __name__ == "__main__":
    import pyarrow.parquet as pq

    sets = {"clustered": clustered(), "even": np.random.default_rng(3).normal(size=(20_000, 64))}
    if len(sys.argv) > 1:
        rows = pq.read_table(sys.argv[1], columns=["embedding"]).column("embedding").to_pylist()
        sets = {sys.argv[1]: np.unique(np.array([r for r in rows if r and None not in r and any(r)], float), axis=0)}
    for name, x in sets.items():
        for share, seen, hit in measure(x, [0.01, 0.05, 0.1, 0.3, 0.6, 1.0]):
            print(f"{name}: {len(x)} vectors, search share {share}: {seen:.3f} of rows visited, recall {hit:.3f}")
