"""Exact deduplication with Patricia-trie owners.

Texts are equal when identical after deleting the characters of [\\x20\\x09-\\x0D]. Two combining levels, so
that a group of copies of any size costs its owner one row per map task: every map task inserts its texts
into a trie of its own and passes on one row per different text; rows then go by (length, content hash) to
an owner, whose trie again holds the full byte strings and at each terminal node the best row, its
identifier and the number of copies. Documents learn their owner's answer by an ordinary join on the
content hash, which Spark splits where a key is hot.

Defined cases: a null text counts as empty; empty texts form one group; rows that repeat a doc_id count as
copies of their text and each comes back; of equal lengths the smallest doc_id stays, and a null doc_id
comes after all others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm._base import map_batches, partitions, table, text_slices

SPACES = b" \t\n\v\f\r"
MEMORY = 64 << 20  # bytes of keys that a trie keeps before it spills a subtree
LAST_ID = (1 << 63) - 1


class PatriciaTrie:
    """Compressed radix trie over byte strings. Terminal values merge through `merge(old, new)`.

    A node is [edge bytes, children by first byte, value or None]; the first `depth` bytes of every key are
    passed over. When the keys held exceed `memory`, the heaviest subtree below the root goes to a temporary
    file and later keys of that subtree follow it there; items() then takes up one spilled subtree at a time
    in a trie that begins one byte deeper.
    """

    def __init__(self, merge, memory: int = MEMORY, depth: int = 0):
        self.merge, self.memory, self.depth = merge, memory, depth
        self.root: list = [b"", {}, None]
        self.held: dict[int, int] = {}
        self.total = 0
        self.spilled: dict[int, object] = {}

    def insert(self, key: bytes, value) -> None:
        if len(key) <= self.depth:
            self.root[2] = value if self.root[2] is None else self.merge(self.root[2], value)
            return
        head = key[self.depth]
        if head in self.spilled:
            pickle.dump((key[self.depth :], value), self.spilled[head])
            return
        self._put(key, value)
        self.held[head] = self.held.get(head, 0) + len(key) + 200
        self.total += len(key) + 200
        if self.total > self.memory:
            self._spill(max(self.held, key=self.held.get))

    def _put(self, key: bytes, value) -> None:
        node, at = self.root, self.depth
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, value]
                return
            edge = child[0]
            if key.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            same = len(os.path.commonprefix([edge, key[at : at + len(edge)]]))
            upper = [edge[:same], {edge[same]: child}, None]
            child[0] = edge[same:]
            node[1][key[at]] = upper
            node, at = upper, at + same
        node[2] = value if node[2] is None else self.merge(node[2], value)

    @staticmethod
    def _walk(node: list) -> Iterator[tuple[bytes, object]]:
        stack = [(node, b"")]
        while stack:
            node, prefix = stack.pop()
            prefix += node[0]
            if node[2] is not None:
                yield prefix, node[2]
            stack.extend((child, prefix) for child in node[1].values())

    def _spill(self, head: int) -> None:
        file = self.spilled[head] = tempfile.TemporaryFile()
        for item in self._walk(self.root[1].pop(head)):
            pickle.dump(item, file)
        self.total -= self.held.pop(head)

    def items(self) -> Iterator[tuple[bytes, object]]:
        """Every key from `depth` on, with its value; temporary files are gone afterwards."""
        yield from self._walk(self.root)
        self.root = [b"", {}, None]
        for head, file in self.spilled.items():
            file.seek(0)
            deeper = PatriciaTrie(self.merge, self.memory, 1)
            while True:
                try:
                    deeper.insert(*pickle.load(file))
                except EOFError:
                    break
            file.close()
            for key, value in deeper.items():
                yield bytes([head]) + key, value


def _better(a: tuple, b: tuple) -> tuple:
    """(code points, doc_id, copies): most code points, then smallest doc_id; copies add up."""
    first = a if (-a[0], a[1]) <= (-b[0], b[1]) else b
    return first[0], first[1], a[2] + b[2]


def _flush(trie: PatriciaTrie) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for key, (points, doc, copies) in trie.items():
        rows.append((len(key), hashlib.sha256(key).hexdigest(), key, points, doc, copies))
        size += len(key)
        if size > 8 << 20:
            yield _owned(rows)
            rows, size = [], 0
    if rows:
        yield _owned(rows)


def _owned(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = ("size", "key_sha256", "content", "points", "owner", "copies")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


_OWNED = "size long, key_sha256 string, content binary, points long, owner long, copies long"


def _combine_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie, size = PatriciaTrie(_better, MEMORY), 0
    for batch in batches:
        for part in text_slices(batch):
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                text = text or ""
                key = text.encode("utf-8", "surrogatepass").translate(None, SPACES)
                trie.insert(key, (len(text), LAST_ID if doc is None else doc, 1))
                size += len(key)
            if size > MEMORY // 2:  # a full trie is passed on; the owners join what it splits
                yield from _flush(trie)
                trie, size = PatriciaTrie(_better, MEMORY), 0
    yield from _flush(trie)


def _combine_owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = PatriciaTrie(_better, MEMORY)
    for batch in batches:
        for key, points, doc, copies in zip(*(batch.column(c).to_pylist() for c in ("content", "points", "owner", "copies")), strict=True):
            trie.insert(key, (points, doc, copies))
    for batch in _flush(trie):
        yield batch.select(["key_sha256", "owner", "copies"])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            keys = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass").translate(None, SPACES)).hexdigest() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(keys, pa.string())], ["doc_id", "text_sha256"])


def owners(docs: DataFrame) -> DataFrame:
    """One row per different normalised text: key_sha256, owner (doc_id that stays), copies."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    local = map_batches(texts, _combine_texts, _OWNED)
    dealt = local.repartition(partitions(docs.sparkSession), "size", "key_sha256").select("content", "points", "owner", "copies")
    return map_batches(dealt, _combine_owned, "key_sha256 string, owner long, copies long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = map_batches(texts, _describe, "doc_id long, text_sha256 string")
    joined = described.join(owners(docs).withColumnRenamed("key_sha256", "text_sha256"), "text_sha256")
    keep = F.when(F.col("owner") != LAST_ID, F.col("owner"))
    return joined.select("doc_id", keep.alias("keep_id"), F.col("copies").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that exact_dedup() keeps, with their columns; of rows with one doc_id and equal texts the longest stays, once."""
    names = docs.columns
    flat = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)))
    own, text = f"_c{names.index('doc_id')}", F.coalesce(F.col(f"_c{names.index('text')}").cast("string"), F.lit(""))
    key = lambda sha, i: F.concat_ws("|", sha, F.coalesce(F.col(i).cast("long").cast("string"), F.lit("none")))  # noqa: E731  one column, so that join and window share an exchange
    rows = flat.withColumn("_key", key(F.sha2(F.regexp_replace(text, "[\\x20\\x09-\\x0D]", ""), 256), own))
    kept = exact_dedup(docs).filter("kept").select(key(F.col("text_sha256"), "doc_id").alias("_key")).distinct()
    rows = rows.join(kept, "_key", "left_semi")
    once = F.row_number().over(Window.partitionBy("_key").orderBy(F.length(text).desc()))
    return rows.withColumn("_nth", once).filter("_nth = 1").select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
