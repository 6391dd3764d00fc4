"""Shared parts of the text operators: Arrow text buffers, numpy hashing, durable intermediates."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
SLICE_BYTES = 1 << 19  # text handled by one numpy pass; a longer single text is a slice of its own

HOT_ROWS = 1000

_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset (tests), one set here, under a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file:///tmp/quillon-checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, *replaced: DataFrame) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: lineage ends in replicated files,
    so a lost executor costs no recomputation of what came before. The files of the materialized tables that
    this one replaces go at once, the others when the driver exits."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove, spark, _written)
    _written.append(path)
    _remove(spark, [x._files for x in replaced if hasattr(x, "_files")])
    out = spark.read.schema(df.schema).parquet(path)
    out._files = path
    return out


def _remove(spark: SparkSession, paths: list[str]) -> None:
    try:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
    except Exception:  # the JVM has gone first; nothing is left to remove the files with
        return


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left join right on `key`, of which right holds one row each. Keys with over HOT_ROWS rows in left, and among
    the 4 a partition that have most, are joined with a broadcast of their few rows of right, so that no task
    gets all rows of a hot key; the others by an exchange. left is read three times: materialize it first."""
    spark = left.sparkSession
    most = left.groupBy(key).count().orderBy(F.desc("count")).limit(4 * partitions(spark)).collect()
    hot = [(r[0],) for r in most if r["count"] > HOT_ROWS and r[0] is not None]
    if not hot:
        return left.join(right, key, how)
    keys = F.broadcast(spark.createDataFrame(hot, f"{key} {left.schema[key].dataType.simpleString()}"))
    few = F.broadcast(right.join(keys, key, "left_semi"))
    return left.join(keys, key, "left_anti").join(right, key, how).unionByName(left.join(keys, key, "left_semi").join(few, key, how))


def partitions(spark: SparkSession, least: int = 8) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def release_freed_memory() -> None:
    """In a worker: have large arrays mapped, and so given back, one by one; freed heap otherwise stays with a reused worker."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 1 << 17)  # M_MMAP_THRESHOLD
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of a batch whose text bytes stay under `most` (or one row)."""
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, ends = 0, np.cumsum(lengths)
    n = batch.num_rows
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated UTF-8 bytes and the n+1 offsets of a string column; null reads as empty."""
    column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer with full avalanche over 64 bits."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407)) | U64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least (base odd)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            p = np.full(size, U64(b))
            p[0] = U64(1)
            made.append(np.multiply.accumulate(p))
        have = (made[0], made[1])
        if n <= SLICE_BYTES + 1:
            _powers[base] = have
    return have


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0xC6A4A7935BD1E995) -> np.ndarray:
    """64-bit hash of values[start:end] for each pair: differences of one running polynomial sum."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, and for each document the range of its words: (hashes, starts-in-bytes, word offsets n+1)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    codes = BYTE_CODE[LOWER[data]] if lower else BYTE_CODE[data]
    return range_hashes(codes, starts, ends), starts, np.searchsorted(starts, offsets)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (windows may cross documents; the caller masks those)."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    starts = np.arange(m)
    return range_hashes(words, starts, starts + k, 0x9FB21C651E98DF25)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ranges start, start+1, ... of the given lengths."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return first + np.arange(total)
