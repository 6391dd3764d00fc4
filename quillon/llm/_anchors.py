"""Repeats across documents by shared anchors: what suffix-array and recompression dedup have in common.

A rule that looks at a window's content only picks one anchor in every window, so equal windows have equal
anchors. Steps: (1) every document's anchors travel as packed blocks by anchor hash; anchors met once
anywhere are dropped, and documents get the ordinals of the others back; (2) only windows at those anchors
travel on, to the operator's own kernel, which marks windows that have an earlier copy; (3) marks return to
their documents. In (1) and (2) a map task answers what it can among its own rows and passes on one copy of
what is equal, so an anchor that a third of all documents share costs one entry per task.

Hot anchors: (1) also counts. An anchor with over a HOT_SHARE-th of its bucket's occurrences is hot (at most
HOT_SHARE a bucket, so the list is bounded by the number of partitions, and broadcast). Windows at hot
anchors travel one by one under their own hash, so the many different contexts at the edge of a passage that
very many documents share are spread over all buckets, while its inner windows fold to one a task.

Blocks are byte planes of sorted columns, the first as differences, under zstd. Rows are known by uid, a hash
of doc_id and text: equal rows get equal answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._base import U64, map_batches, materialize, mix, partitions, release_freed_memory, text_slices

SPREAD = 2  # buckets per partition; every task writes a row per bucket it has entries for
FLUSH = 1_000_000  # entries a map task gathers before it writes its blocks
HOT_SHARE, HOT_LEAST = 8, 1000
CODEC = pa.Codec("zstd", 1)


def with_uid(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), uid, uid32 (its low half); a null doc_id counts as the largest."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("uid", F.xxhash64("doc_id", "text")).withColumn("uid32", F.col("uid").bitwiseAND(F.lit(0xFFFFFFFF)))


def order_ids(column: pa.Array) -> np.ndarray:
    return column.fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False).astype(np.int64)


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + CODEC.compress(raw, asbytes=True)


def expand(packed: bytes) -> bytes:
    return CODEC.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


def planes(columns: list[np.ndarray]) -> bytes:
    """The columns as byte planes; the first, which is sorted, as differences."""
    out = []
    for i, c in enumerate(columns):
        c = np.ascontiguousarray(c)
        if i == 0:
            c = c.view(f"u{c.itemsize}")
            c = np.r_[c[:1], c[1:] - c[:-1]]
        out.append(c.view(np.uint8).reshape(len(c), -1).T.tobytes())
    return b"".join(out)


def from_planes(raw: bytes, n: int, dtypes: list, at: int = 0) -> tuple[list[np.ndarray], int]:
    """The columns planes() was given, and where they end."""
    out = []
    for i, d in enumerate(dtypes):
        size = np.dtype(d).itemsize
        c = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(f"u{size}")
        out.append((np.cumsum(c, dtype=f"u{size}") if i == 0 else c).view(d))
        at += n * size
    return out, at


def blocks(bucket: np.ndarray, columns: list[np.ndarray], sure: bool) -> Iterator[pa.RecordBatch]:
    """One row per bucket. Rows of `sure` blocks need no meeting."""
    if not len(bucket):
        return
    by = np.lexsort((columns[0], bucket))
    bucket, columns = bucket[by], [c[by] for c in columns]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[starts[1:], len(bucket)]
    packed = [squeeze(planes([c[a:b] for c in columns])) for a, b in zip(starts, ends, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int64)), pa.array([sure] * len(starts), pa.bool_()), pa.array(packed, pa.binary())], ["bucket", "sure", "packed"])


BLOCK_SCHEMA = "bucket long, sure boolean, packed binary"


def unpack(raws: list[bytes], dtypes: list) -> list[np.ndarray]:
    size = sum(np.dtype(d).itemsize for d in dtypes)
    parts: list[list[np.ndarray]] = [[np.zeros(0, d)] for d in dtypes]
    for raw in map(expand, raws):
        for part, c in zip(parts, from_planes(raw, len(raw) // size, dtypes)[0], strict=True):
            part.append(c)
    return [np.concatenate(p) for p in parts]


def repeated_anchors(docs: DataFrame, anchors: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]], hot_least: int = HOT_LEAST) -> tuple[DataFrame, np.ndarray]:
    """Rows (uid32, ordinals), per document packed ordinals (uint32) of anchors that occur more than once; and the sorted hot anchors.

    anchors(text column) gives the hash of every anchor, whether it is known to repeat, and the n+1 offsets by
    document. uid32 is the low half of uid;
    documents that share one get each other's ordinals too, which only adds work.
    """
    parts = partitions(docs.sparkSession)
    buckets = parts * SPREAD
    kinds = [np.uint32, np.uint32, np.uint32, np.uint32]  # low half of the hash, uid32, ordinal, occurrences in this task's run

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_freed_memory()
        held, size = [], 0
        for batch in batches:
            for part in text_slices(batch):
                found, known, ends = anchors(part.column("text"))
                counts = np.diff(ends)
                uid = np.repeat(part.column("uid").to_numpy().view(U64).astype(np.uint32), counts)
                held.append((found, uid, (np.arange(len(found)) - np.repeat(ends[:-1], counts)).astype(np.uint32), known))
                size += len(found)
                if size > FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        found, uid, ordinal, known = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.argsort(found, kind="stable")
        found, uid, ordinal, known = found[by], uid[by], ordinal[by], known[by]
        new = np.r_[True, found[1:] != found[:-1]][: len(found)]
        many = ~new
        many[:-1] |= ~new[1:]
        many |= known
        yield from blocks((mix(uid[many].astype(U64)) % U64(buckets)).astype(np.int64), [uid[many], ordinal[many]], True)
        first = np.flatnonzero(new)
        times = np.diff(np.r_[first, len(found)]).astype(np.uint32)
        low, high = found[first].astype(np.uint32), found[first] >> U64(32)
        yield from blocks(high.astype(np.int64) % buckets, [low, uid[first], ordinal[first], times], False)
        often = times >= np.uint32(8)  # hot anchors are looked for among these; rarer ones count by the tasks they are in
        yield from blocks(high[often].astype(np.int64) % buckets, [found[first][often], times[often]], None)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_freed_memory()
        by_bucket: dict[tuple, list[bytes]] = {}
        for batch in batches:
            for bucket, sure, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sure", "packed")), strict=True):
                by_bucket.setdefault((-1 if sure else bucket, sure), []).append(raw)
        out, hot = [], []
        for bucket, sure in sorted((k for k in by_bucket if k[1] is False), key=lambda k: k[0]):
            found, uid, ordinal, times = unpack(by_bucket.pop((bucket, sure)), kinds)
            by = np.argsort(found, kind="stable")
            found, total = found[by], np.cumsum(times[by], dtype=np.int64)
            same = found[1:] == found[:-1]
            many = np.r_[False, same] | np.r_[same, False] if len(by) > 1 else np.zeros(len(by), bool)
            out.append((uid[by][many], ordinal[by][many]))
            names = unpack(by_bucket.pop((bucket, None), []), [U64, np.uint32])[0]
            if len(names):
                names = np.unique(names)
                low = names.astype(np.uint32)
                ends, starts = np.searchsorted(found, low, side="right"), np.searchsorted(found, low)
                often = total[ends - 1] - np.where(starts > 0, total[np.maximum(starts, 1) - 1], 0)
                hot.append(names[often > max(hot_least, int(total[-1]) // HOT_SHARE)])
        if (-1, True) in by_bucket:
            out.append(unpack(by_bucket.pop((-1, True)), kinds[1:3]))
        if out:
            uid, ordinal = (np.concatenate(c) for c in zip(*out, strict=True))
            yield from blocks((mix(uid.astype(U64)) % U64(parts)).astype(np.int64), [uid, ordinal], False)
        hot = np.concatenate([*hot, np.zeros(0, U64)])
        yield from blocks(np.zeros(len(hot), np.int64), [np.sort(hot)], True)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raws: dict[bool, list[bytes]] = {True: [], False: []}
        for batch in batches:
            for sure, raw in zip(batch.column("sure").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                raws[sure].append(raw)
        uid, ordinal = unpack(raws[False], kinds[1:3])
        yield from per_key(uid, ordinal)
        if raws[True]:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([unpack(raws[True], [U64])[0].tobytes()], pa.binary())], ["uid32", "ordinals"])

    def per_key(uid: np.ndarray, ordinal: np.ndarray) -> Iterator[pa.RecordBatch]:
        both = np.unique(uid.astype(U64) << U64(32) | ordinal)
        uid, ordinal = (both >> U64(32)).astype(np.int64), both.astype(np.uint32)
        starts = np.flatnonzero(np.r_[True, uid[1:] != uid[:-1]][: len(uid)])
        ends = np.r_[starts[1:], len(uid)]
        for at in range(0, len(starts), 5000):
            s, e = starts[at : at + 5000], ends[at : at + 5000]
            yield pa.RecordBatch.from_arrays([pa.array(uid[s]), pa.array([squeeze(planes([ordinal[a:b]])) for a, b in zip(s, e, strict=True)], pa.binary())], ["uid32", "ordinals"])

    sent = map_batches(docs.select("uid", "text"), emit, BLOCK_SCHEMA).repartition(parts, "bucket")
    met = map_batches(sent, meet, BLOCK_SCHEMA).repartition(parts, "bucket")
    found = materialize(map_batches(met, gather, "uid32 long, ordinals binary"))
    hot = [np.frombuffer(r["ordinals"], U64) for r in found.filter("uid32 IS NULL").select("ordinals").collect()]  # HOT_SHARE a bucket at most
    return found.filter("uid32 IS NOT NULL"), np.unique(np.concatenate([*hot, np.zeros(0, U64)]))


def ordinals_of(column: pa.Array) -> list[np.ndarray]:
    return [unpack([raw], [np.uint32])[0].astype(np.int64) for raw in column.to_pylist()]


def is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def attach(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents that have repeated anchors, with their ordinals."""
    return docs.join(found, "uid32").select("doc_id", "uid", "text", "ordinals")


def with_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Every document with its marks, if any. Dealt by uid32 like attach(), so that Spark reuses that exchange of the texts; uids are compared row by row."""
    found = marks.select(F.col("uid").alias("_uid"), F.col("uid").bitwiseAND(F.lit(0xFFFFFFFF)).alias("_uid32"), "marks")
    return docs.join(found, (F.col("uid32") == F.col("_uid32")) & (F.col("uid").bitwiseXOR(F.col("_uid")) == 0), "left").drop("_uid", "_uid32")


def meet_and_return(sent: DataFrame, kernel: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """Rows (uid, marks): packed (uint32 start, uint64 mask) of each document.

    sent: blocks, sure ones holding (uid int64, start uint32, mask uint64), others what `kernel` takes; a
    kernel gets one bucket's blocks and gives the arrays uid, start, mask.
    """
    parts = partitions(sent.sparkSession)
    kinds = [np.int64, np.uint32, np.uint64]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_freed_memory()
        by_bucket: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, sure, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sure", "packed")), strict=True):
                by_bucket.setdefault(-1 if sure else bucket, []).append(raw)
        out = []
        while by_bucket:
            bucket, raws = by_bucket.popitem()
            out.append(unpack(raws, kinds) if bucket < 0 else kernel(raws))
        if out:
            uid, start, mask = (np.concatenate(c) for c in zip(*out, strict=True))
            yield from blocks((mix(uid.view(U64)) % U64(parts)).astype(np.int64), [uid, start, mask], False)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, start, mask = unpack([raw for batch in batches for raw in batch.column("packed").to_pylist()], kinds)
        by = np.lexsort((start, uid))
        uid, start, mask = uid[by], start[by], mask[by]
        starts = np.flatnonzero(np.r_[True, uid[1:] != uid[:-1]][: len(uid)])
        ends = np.r_[starts[1:], len(uid)]
        for at in range(0, len(starts), 5000):
            s, e = starts[at : at + 5000], ends[at : at + 5000]
            yield pa.RecordBatch.from_arrays([pa.array(uid[s]), pa.array([squeeze(planes([start[a:b], mask[a:b]])) for a, b in zip(s, e, strict=True)], pa.binary())], ["uid", "marks"])

    met = map_batches(sent.repartition(parts, "bucket"), meet, BLOCK_SCHEMA).repartition(parts, "bucket")
    return map_batches(met, gather, "uid long, marks binary")


def covered(marks: bytes | None, size: int, window: int) -> np.ndarray:
    """Which of `size` units lie in a marked window."""
    if not marks:
        return np.zeros(size, bool)
    start, mask = unpack([marks], [np.uint32, np.uint64])
    bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, bit = np.nonzero(bits)
    at = start[which].astype(np.int64) + bit
    depth = np.bincount(at, minlength=size + 1) - np.bincount(at + window, minlength=size + 1)
    return np.cumsum(depth)[:size] > 0
