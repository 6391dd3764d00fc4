"""Best-fit packing after Martello-Toth dominance reduction.

Pieces of one length are interchangeable, so the instance is its histogram of at most CAPACITY counts: one
aggregate brings that to the driver, where the whole packing is planned as patterns (lengths side by side,
number of copies). The reduction first fixes sets that dominate every other way to place their largest
piece (nothing else fits; an exact pair; a single partner where no two fit, or no two that fit together
outweigh it) and shrinks the histogram; best-fit decreasing then places the rest, also by counts. Pieces
find their place by their rank among those of their length, which is counted in two steps over hash buckets
so that no task ever holds a whole length, however common it is.

Defined cases: a null text is empty and still holds the end mark, one token; texts over CAPACITY tokens are
cut, the first piece taking what is left over; repeated rows are packed each; ties in rank go by doc_id and
piece; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm._base import map_batches, materialize, partitions, table, text_slices
from quillon.llm.bpe import broadcast_config, codec

CAPACITY = 1024
END_ID = 2


def reduce_counts(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[list[int], int]], np.ndarray]:
    """Martello-Toth reduction of a histogram: (fixed patterns with copies, counts that remain)."""
    left, fixed = counts.astype(np.int64).copy(), []

    def fix(lengths: list[int], copies: int) -> None:
        fixed.append((lengths, copies))
        for x in lengths:
            left[x] -= copies

    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while left[j]:
                room = capacity - j
                left[j] -= 1
                present = np.flatnonzero(left[: room + 1])
                left[j] += 1
                if not len(present):
                    # at most the last piece of this length has no partner; the others may have each other
                    fix([j], 1 if j <= room else int(left[j]))
                    changed = True
                    continue
                k = int(present[-1])
                small = [x for x in present[:3] for _ in range(min(3, int(left[x]) - (x == j)))][:3]
                pair_fits = len(small) > 1 and small[0] + small[1] <= room
                three_fit = len(small) > 2 and sum(small) <= room
                if not (j + k == capacity or not pair_fits or (not three_fit and k >= _best_pair(present, left, j, room))):
                    break
                copies = int(left[j]) // 2 if j == k else int(min(left[j], left[k]))
                if pair_fits and j + k != capacity:
                    copies = 1  # the ground for this choice may go as pieces leave
                fix([j, k], copies)
                changed = True
    return fixed, left


def _best_pair(present: np.ndarray, left: np.ndarray, j: int, room: int) -> int:
    """Largest sum of two pieces that fit in `room` together."""
    best, low, high = 0, 0, len(present) - 1
    while low <= high:
        total = int(present[low] + present[high])
        if total > room:
            high -= 1
            continue
        if low != high or left[present[low]] - (present[low] == j) > 1:
            best = max(best, total)
        low += 1
    return best


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on a histogram: patterns with copies."""
    open_bins: dict[int, list[tuple[list[int], int]]] = {}
    done = []
    for size in range(capacity, 0, -1):
        todo = int(counts[size])
        for room in sorted(r for r in open_bins if r >= size):
            if not todo:
                break
            each, groups = room // size, open_bins.pop(room)
            while groups:
                lengths, copies = groups.pop()
                full = min(copies, todo // each)
                extra = min(todo - full * each, each - 1) if full < copies else 0
                for fill, n in ((each, full), (extra, 1 if extra else 0)):
                    if n:
                        _keep(open_bins, done, lengths + [size] * fill, n, capacity)
                rest = copies - full - (1 if extra else 0)
                todo -= full * each + extra
                if rest:
                    open_bins.setdefault(room, []).append((lengths, rest))
                if not todo:
                    break
            if groups:
                open_bins.setdefault(room, []).extend(groups)
        each = capacity // size
        for fill, n in ((each, todo // each), (todo % each, 1)):
            if fill and n:
                _keep(open_bins, done, [size] * fill, n, capacity)
    return done + [g for groups in open_bins.values() for g in groups]


def _keep(open_bins: dict, done: list, lengths: list[int], copies: int, capacity: int) -> None:
    room = capacity - sum(lengths)
    (open_bins.setdefault(room, []) if room else done).append((lengths, copies))


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    fixed, left = reduce_counts(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[tuple[list[int], int]], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted: where the pieces of each length go."""
    taken, base, rows = np.zeros(capacity + 1, np.int64), 0, []
    for lengths, copies in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, int(taken[x]), base, offset))
            taken[x] += copies
            offset += x
        base += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def cut_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    config = broadcast_config(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = codec(config.value, quick=True), np.array([END_ID], np.uint32)
        for batch in batches:
            for part in text_slices(batch):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.concatenate((own.encode(text or ""), end)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    rows += [(doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(texts, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = docs.sparkSession
    pieces = materialize(cut_documents(docs, path, capacity))
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    places = slots(plan(counts, capacity), capacity)
    keys = places[:, 0] << 44 | places[:, 1] if len(places) else np.zeros(0, np.int64)

    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(partitions(spark))))
    sizes = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = bucketed.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            where = places[at]
            extra = [pa.array(where[:, 2] + rank - where[:, 1]), pa.array(where[:, 3])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in _PIECE] + extra, [*_PIECE, "sequence_id", "offset"])

    return map_batches(ranked.select(*_PIECE, "rank"), place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
