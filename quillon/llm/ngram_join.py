"""N-gram Jaccard join by prefix trees.

A document's set holds its different 5-word shingles (64-bit hashes); documents with equal sets are one node.
Two nodes link when 100 * intersection >= 75 * union, that is when the symmetric difference is at most a
seventh of the two sizes' sum. Steps, each exact (no link can be lost):

1. One pass over all documents finds shingles that are frequent somewhere; the most frequent HEAVY of them
   go to the end of the global order of shingles (any fixed order is right; this one keeps common passages
   out of prefixes).
2. Linked sets share a shingle among their first n - ceil(3n/4) + 1 in that order. Prefixes travel as packed
   blocks by shingle; nodes that meet at a shingle form a candidate group, and equal groups are kept once.
3. In groups, parity bitmaps bound the symmetric difference from below; pairs that pass join candidate
   components.
4. In each component the full sets are put into a prefix tree in globally ordered form; a new set walks the
   tree, sharing the partial overlap of every common path, leaving out subtrees whose length range or
   remaining length cannot reach the threshold, or which it is already linked to. This gives the links.

Groups and components of any size are handled in blocks of bounded size that share a few pivot nodes; what a
block cannot connect to the pivots is compared with every other block. Only spanning links are kept, so a
group of copies costs its size, not its square.

Defined cases: null texts and texts without words have an empty set and link with nothing; fewer than five
words make one shingle; repeated rows count as equal sets; whole texts of any length are taken; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._base import U64, map_batches, materialize, mix, partitions, range_hashes, spread, spread_join, table, text_bytes, text_slices, window_hashes, words_of
from quillon.llm.components import components

SIZE = 5
HEAVY = 1 << 17  # shingles moved to the end of the order; 2 MB
BLOCK = 768  # nodes compared with each other in one task
BLOCK_SHINGLES = 4_000_000
PIVOTS = 8
TOP = U64(1 << 63)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of each document, sorted within it, and the n+1 offsets."""
    data, offsets = text_bytes(column)
    words, _, ends = words_of(data, offsets, lower=True)
    count = np.diff(ends)
    hashes = window_hashes(words, SIZE)
    doc = np.repeat(np.arange(len(count)), count)
    inside = doc[: len(hashes)] == doc[SIZE - 1 :] if len(hashes) else np.zeros(0, bool)
    docs, found = doc[: len(hashes)][inside], hashes[inside]
    short = np.flatnonzero((count > 0) & (count < SIZE))
    if len(short):
        whole = range_hashes(words, ends[short], ends[short + 1], 0x9FB21C651E98DF25)
        docs, found = np.concatenate((docs, short)), np.concatenate((found, whole))
    order = np.lexsort((found, docs))
    docs, found = docs[order], found[order]
    keep = np.ones(len(found), bool)
    keep[1:] = (docs[1:] != docs[:-1]) | (found[1:] != found[:-1])
    docs, found = docs[keep], found[keep]
    return found, np.searchsorted(docs, np.arange(len(count) + 1))


def signatures(found: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per set, the same for equal sets."""
    total = np.zeros(len(found) + 1, U64)
    np.cumsum(mix(found ^ U64(0x5851F42D4C957F2D)), out=total[1:])
    return mix(total[ends[1:]] - total[ends[:-1]] + np.diff(ends).astype(U64)).view(np.int64)


def bitmaps(found: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Parity of shingles per bucket; as many buckets as the power of two from n on, at least 512."""
    sizes = np.diff(ends)
    width = np.maximum(512, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    base = np.concatenate(([0], np.cumsum(width)))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = base[doc] + ((found >> U64(7)).astype(np.int64) & (width[doc] - 1))
    parity = np.packbits((np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8), bitorder="little")
    return [parity[a // 8 : b // 8].tobytes() for a, b in zip(base, base[1:], strict=False)]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def frequent_shingles(docs: DataFrame, most: int = HEAVY) -> np.ndarray:
    """The hashes counted most often over all documents, among those met three times in some run of documents, most frequent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate([*held, np.zeros(0, U64)]), return_counts=True)
            often = counts >= 3
            values, counts = values[often], counts[often]
            top = np.argsort(-counts, kind="stable")[:most]
            return pa.RecordBatch.from_arrays([pa.array(values[top].view(np.int64)), pa.array(counts[top])], ["h", "n"])

        for batch in batches:
            for part in text_slices(batch):
                held.append(shingle_sets(part.column("text"))[0])
                size += len(held[-1])
            if size > 6_000_000:
                yield flush()
                held, size = [], 0
        yield flush()

    counted = map_batches(_texts(docs), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "h").limit(most).toPandas()
    return rows["h"].to_numpy(np.int64)[::-1].copy().view(U64)


def nodes_of(docs: DataFrame) -> DataFrame:
    """doc_id, sig, n, bitmap per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                found, ends = shingle_sets(part.column("text"))
                arrays = [part.column("doc_id"), pa.array(signatures(found, ends)), pa.array(np.diff(ends)), pa.array(bitmaps(found, ends), pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "sig", "n", "bitmap"])

    return map_batches(_texts(docs), run, "doc_id long, sig long, n long, bitmap binary")


def candidate_groups(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """Rows (key, sig, n): nodes that share a prefix shingle and could by their sizes be linked."""
    spark = docs.sparkSession
    parts = partitions(spark)
    buckets = parts * 8
    order = np.argsort(heavy)
    shared = spark.sparkContext.broadcast((heavy[order], order.astype(U64)))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = shared.value
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for part in text_slices(batch):
                held.append(one(part.column("text"), known, place))
                size += len(held[-1][0])
            if size > 300_000:
                yield blocks(held)
                held, size = [], 0
        if held:
            yield blocks(held)

    def one(column: pa.Array, known: np.ndarray, place: np.ndarray) -> tuple:
        found, ends = shingle_sets(column)
        sizes, sig = np.diff(ends), signatures(found, ends)
        rank = found >> U64(1)
        if len(known):
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            rank = np.where(known[at] == found, TOP + place[at], rank)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        by = np.lexsort((rank, doc))
        position = np.arange(len(found)) - np.repeat(ends[:-1], sizes)
        first = position < np.repeat(sizes - (3 * sizes + 3) // 4 + 1, sizes)
        return rank[by][first], sig[doc[first]], sizes[doc[first]].astype(np.int32)

    def blocks(held: list[tuple]) -> pa.RecordBatch:
        rank, sig, n = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = (mix(rank) % U64(buckets)).astype(np.int64)
        by = np.lexsort((sig, rank, bucket))
        rank, sig, n, bucket = rank[by], sig[by], n[by], bucket[by]
        new = np.ones(len(rank), bool)
        new[1:] = (rank[1:] != rank[:-1]) | (sig[1:] != sig[:-1])
        rank, sig, n, bucket = rank[new], sig[new], n[new], bucket[new]
        names = np.unique(bucket)
        edges = np.searchsorted(bucket, [*names, buckets])
        packed = [rank[a:b].tobytes() + sig[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(packed, pa.binary())], ["bucket", "packed"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, sigs, sizes = [], [], []
        for batch in batches:
            for raw in batch.column("packed").to_pylist():
                m = len(raw) // 20
                ranks.append(np.frombuffer(raw, U64, m))
                sigs.append(np.frombuffer(raw, np.int64, m, 8 * m))
                sizes.append(np.frombuffer(raw, np.int32, m, 16 * m))
        if not ranks:
            return
        rank, sig, n = np.concatenate(ranks), np.concatenate(sigs), np.concatenate(sizes)
        by = np.argsort(rank, kind="stable")
        rank, sig, n = rank[by], sig[by], n[by]
        twice = np.zeros(len(rank), bool)
        twice[1:] = rank[1:] == rank[:-1]
        twice[:-1] |= twice[1:]
        rank, sig, n = rank[twice], sig[twice], n[twice]
        by = np.lexsort((sig, n, rank))
        rank, sig, n = rank[by], sig[by], n[by]
        new = np.ones(len(rank), bool)
        new[1:] = (rank[1:] != rank[:-1]) | (sig[1:] != sig[:-1])
        rank, sig, n = rank[new], sig[new], n[new].astype(np.int64)
        apart = np.ones(len(rank), bool)  # a gap in size that no link can span also ends a group
        apart[1:] = (rank[1:] != rank[:-1]) | (4 * n[:-1] < 3 * n[1:])
        starts = np.flatnonzero(apart)
        counts = np.diff(np.r_[starts, len(rank)])
        total = np.r_[U64(0), np.cumsum(mix(sig.view(U64) ^ U64(0x2545F4914F6CDD1D)))]
        key = mix(total[starts + counts] - total[starts] + counts.astype(U64)).view(np.int64)
        _, once = np.unique(key, return_index=True)
        once = once[counts[once] > 1]
        if len(once):
            rows = spread(starts[once], counts[once])
            for at in range(0, len(rows), 100_000):
                r = rows[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key[once], counts[once])[at : at + 100_000]), pa.array(sig[r]), pa.array(n[r])], ["key", "sig", "n"])

    dealt = map_batches(_texts(docs), prefixes, "bucket long, packed binary").repartition(parts, "bucket")
    return map_batches(dealt, groups, "key long, sig long, n long").dropDuplicates(["key", "sig"])


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def bitmap_links(sizes: list[int], data: list[bytes]) -> list[tuple[int, int]]:
    """Spanning links among nodes whose bitmaps differ in at most (n + m) / 7 places."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    n = np.array([sizes[i] for i in order])
    words = [np.frombuffer(data[i], U64) for i in order]
    root, out, folded = np.arange(len(n)), [], {}
    to = np.searchsorted(3 * n, 4 * n, side="right")  # 3 * larger <= 4 * smaller
    for i in range(len(n)):
        w = len(words[i])
        if w not in folded:  # sizes ascend, so all later nodes have at least this width
            folded[w] = (i, np.array([np.bitwise_xor.reduce(x.reshape(-1, w), 0) for x in words[i:]]))
        first, rows = folded[w]
        a, b = i + 1, int(to[i])
        if a >= b:
            continue
        other = np.flatnonzero(root[a:b] != root[i])
        if not len(other):
            continue
        differ = np.bitwise_count(rows[a - first + other] ^ rows[i - first]).sum(1, dtype=np.int64)
        for j in (other[7 * differ <= n[i] + n[a + other]] + a).tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((order[i], order[j]))
    return out


class _Node:
    __slots__ = ("tokens", "kids", "ends", "low", "high", "depth", "same")

    def __init__(self, tokens: np.ndarray, depth: int):
        self.tokens, self.depth = tokens, depth  # depth: shingles up to and with this node
        self.kids: dict[int, _Node] = {}
        self.ends: list[int] = []
        self.low, self.high, self.same = 1 << 60, 0, -1


def trie_links(sizes: list[int], data: list[bytes]) -> list[tuple[int, int]]:
    """Spanning links among sets, by walking a compressed prefix tree of them."""
    flat = np.concatenate([np.frombuffer(d, U64) for d in data])
    values, place, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(values))
    cuts = np.cumsum([len(d) // 8 for d in data])[:-1]
    sets = [np.sort(s) for s in np.split(rank[place], cuts)]
    has = np.zeros(len(values), bool)
    forest, out, root = Forest(len(sets)), [], _Node(np.zeros(0, np.int64), 0)
    for x, own in enumerate(sets):
        has[own] = True
        _walk(root, x, own, has, sets, forest, out)
        has[own] = False
        _insert(root, x, own, forest)
    return out


def _walk(root: _Node, x: int, own: np.ndarray, has: np.ndarray, sets: list[np.ndarray], forest: Forest, out: list) -> None:
    size, work = len(own), [(root, 0)]
    while work:
        node, shared = work.pop()
        if node.same >= 0 and forest.find(node.same) == forest.find(x):
            continue
        if 4 * node.high < 3 * size or 3 * node.low > 4 * size:
            continue
        if len(node.tokens):
            shared += int(np.count_nonzero(has[node.tokens]))
            left = size - int(np.searchsorted(own, node.tokens[-1], side="right"))
        else:
            left = size
        if 7 * (shared + min(left, node.high - node.depth)) < 3 * (size + node.low):
            continue
        for y in node.ends:
            if 7 * shared >= 3 * (size + len(sets[y])) and forest.join(x, y):
                out.append((x, y))
        work.extend((kid, shared) for kid in node.kids.values())


def _insert(root: _Node, x: int, own: np.ndarray, forest: Forest) -> None:
    node, at, size = root, 0, len(own)
    _count(node, x, size, forest)
    while at < size:
        kid = node.kids.get(int(own[at]))
        if kid is None:
            kid = node.kids[int(own[at])] = _Node(own[at:], size)
            _count(kid, x, size, forest)
            kid.ends.append(x)
            return
        k = min(len(kid.tokens), size - at)
        differ = np.flatnonzero(kid.tokens[:k] != own[at : at + k])
        k = int(differ[0]) if len(differ) else k
        if k < len(kid.tokens):
            upper = _Node(kid.tokens[:k], node.depth + k)
            upper.low, upper.high, upper.same = kid.low, kid.high, kid.same
            upper.kids[int(kid.tokens[k])] = kid
            kid.tokens = kid.tokens[k:]
            node.kids[int(own[at])] = upper
            kid = upper
        _count(kid, x, size, forest)
        node, at = kid, at + k
    node.ends.append(x)


def _count(node: _Node, x: int, size: int, forest: Forest) -> None:
    if node.high == 0:
        node.same = x
    elif node.same >= 0 and forest.find(node.same) != forest.find(x):
        node.same = -1
    node.low, node.high = min(node.low, size), max(node.high, size)


def block_links(members: DataFrame, payload: DataFrame, kernel) -> DataFrame:
    """Links (a, b) that span what `kernel` finds among the nodes of each key.

    members: materialized rows key, sig, n; payload: sig, data. Keys above BLOCK nodes (or BLOCK_SHINGLES shingles) are dealt into
    blocks by a hash of sig, each with the key's PIVOTS pivots. A node whose class in its block holds no
    pivot of the main pivot class is then compared with all blocks.
    """
    spark = members.sparkSession
    parts = partitions(spark)
    pivots = F.array_distinct(F.array(*(F.min_by("sig", F.xxhash64("sig", F.lit(i))) for i in range(PIVOTS))))
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("long")
    many = materialize(members.groupBy("key").agg(blocks.alias("blocks"), pivots.alias("pivots")).filter("blocks > 1"))
    sized = spread_join(members, many.select("key", "blocks"), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    placed = materialize(sized.select("key", "blocks", "sig", F.pmod(F.xxhash64("sig"), F.col("blocks")).alias("block"), F.lit(0).alias("role")))
    each = many.select("key", "blocks", "pivots", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    shared = each.select("key", "blocks", F.explode("pivots").alias("sig"), "block", F.lit(1).alias("role"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, blocks, _, _), rows in _grouped(batches):
            own = {}
            for sig, role, n, data in rows:
                seen = own.get(sig)
                own[sig] = (max(role, seen[0]) if seen else role, n, data)
            sigs, roles = list(own), [v[0] for v in own.values()]
            links = kernel([v[1] for v in own.values()], [v[2] for v in own.values()]) if len(own) > 1 else []
            out = [(key, sigs[i], sigs[j], False) for i, j in links]
            if blocks > 1 and 2 not in roles:
                forest = Forest(len(sigs))
                for i, j in links:
                    forest.join(i, j)
                at = sorted((sigs[i], i) for i, r in enumerate(roles) if r == 1)
                alone = Forest(len(at))
                for i, j in kernel([own[s][1] for s, _ in at], [own[s][2] for s, _ in at]) if len(at) > 1 else []:
                    alone.join(i, j)
                classes = [alone.find(i) for i in range(len(at))]
                main = max(set(classes), key=lambda c: (classes.count(c), -c))
                settled = {forest.find(i) for (_, i), c in zip(at, classes, strict=True) if c == main}
                out += [(key, s, s, True) for i, s in enumerate(sigs) if forest.find(i) not in settled]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["key", "a", "b", "rest"])

    def linked(rows: DataFrame) -> DataFrame:
        full = rows.join(payload, "sig").select("key", "blocks", "block", F.col("chunk"), "sig", "role", "n", "data")
        dealt = full.repartition(parts, "key", "block", "chunk").sortWithinPartitions("key", "block", "chunk")
        return map_batches(dealt, run, "key long, a long, b long, rest boolean")

    first = materialize(linked(placed.unionByName(shared).withColumn("chunk", F.lit(0).cast("long"))))
    links = first.filter("NOT rest").select("a", "b")
    rest = materialize(first.filter("rest").select("key", F.col("a").alias("sig")).distinct())
    if rest.isEmpty():
        return links
    chunks = materialize(rest.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("long").alias("chunks")))
    open_keys = spread_join(placed, chunks, "key")
    each_chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    held = open_keys.select("key", "blocks", "sig", "block", F.lit(0).alias("role"), each_chunk.alias("chunk"))
    each_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = spread_join(rest, chunks.join(many.select("key", "blocks"), "key"), "key").select("key", "blocks", "sig", each_block.alias("block"), F.lit(2).alias("role"), F.pmod(F.xxhash64("sig", F.lit(1)), F.col("chunks")).alias("chunk"))
    second = linked(held.unionByName(left))
    return links.union(second.select("a", "b"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """((key, blocks, block, chunk), rows) for runs of equal keys in sorted batches."""
    now, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "blocks", "block", "chunk", "sig", "role", "n", "data")]
        for key, blocks, block, chunk, *row in zip(*columns, strict=True):
            if (key, blocks, block, chunk) != now:
                if rows:
                    yield now, rows
                now, rows = (key, blocks, block, chunk), []
            rows.append(row)
    if rows:
        yield now, rows


def sets_of(docs: DataFrame) -> DataFrame:
    """sig, n and the packed sorted set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                found, ends = shingle_sets(part.column("text"))
                data = [found[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(signatures(found, ends)), pa.array(np.diff(ends)), pa.array(data, pa.binary())], ["sig", "n", "data"])

    return map_batches(docs.select("text"), run, "sig long, n long, data binary")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    docs = _texts(docs)
    nodes = materialize(nodes_of(docs))
    groups = materialize(candidate_groups(docs, frequent_shingles(docs)))
    one = nodes.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bitmap").alias("data"))
    met = components(block_links(groups, one.select("sig", "n", "data"), bitmap_links))
    members = materialize(met.join(one.select("sig", "n", "doc_id"), met["v"] == F.col("sig")).select(F.col("c").alias("key"), "sig", "n", "doc_id"))
    texts = docs.join(members.select("doc_id"), "doc_id", "left_semi")
    sets = sets_of(texts).dropDuplicates(["sig"])
    final = components(block_links(members.select("key", "sig", "n"), sets, trie_links))
    linked = materialize(final.join(one.select("sig", "doc_id"), final["v"] == F.col("sig")).select("c", "sig", "doc_id"))
    least = linked.groupBy("c").agg(F.min("doc_id").alias("least"))
    named = materialize(spread_join(linked, least, "c").select("sig", "least"))
    named = one.select("sig", "doc_id").join(named, "sig", "left").select("sig", F.coalesce("least", "doc_id").alias("least"))
    rows = spread_join(nodes.select("doc_id", "sig", "n"), named, "sig", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component, and every document without shingles. Rows of one doc_id stay or go together."""
    stay = jaccard_components(docs).filter(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("kept")).distinct().alias("_stay")
    return docs.alias("_all").join(stay, F.col("_all.doc_id").cast("long").eqNullSafe(F.col("_stay.kept")), "left_semi")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
