"""Substring dedup over words by recompression.

Removes every word covered by a window of 20 words whose sequence also starts earlier (a smaller doc_id, or
the same document further left). Documents are recompressed in rounds: runs of one symbol, then pairs (a
symbol of the left class before one of the right class, classes drawn from the symbols' names) become new
symbols. Names are hashes of what they stand for, so they agree over the whole corpus without a dictionary, and a
symbol's place depends on a few neighbours only: equal word sequences have equal interior symbols. Two
rounds keep that reach (EXTENT words) within a window; every window takes as its anchor the symbol of least
name among the highest-level ones that lie inside it with their reach. Anchors that occur once cannot lie in a
repeat; the windows at shared anchors travel with their words and are verified word by word (words are named
by a dictionary where they meet, hashes only find the candidates), and the first of each class by
(doc_id, start) stays.

Defined cases: null and empty texts have no words; under 20 words nothing is removed; rows that repeat one
another are answered alike; a null doc_id counts as largest; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.llm._anchors import BLOCK_SCHEMA, HOT_LEAST, SPREAD, attach, blocks, covered, expand, from_planes, is_in, meet_and_return, order_ids, ordinals_of, planes, repeated_anchors, squeeze, with_marks, with_uid
from quillon.llm._base import U64, map_batches, mix, partitions, release_freed_memory, spread, table, text_bytes, text_slices, window_hashes, words_of
from quillon.llm.suffix_dedup import sliding_least

WINDOW = 20
EXTENT = (1, 6, 12)  # words a usable symbol of each level may depend on
NONE = U64(0xFFFFFFFFFFFFFFFF)
FAR = 1 << 40


def recompress(name: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, level: int) -> tuple:
    """One round on symbols in text order: (name, doc, left, right), [left, right) being the words each one's name and place depend on."""

    def reach(d: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """What a symbol depends on if it also depends on the one beside it: without end where the document ends, as a window does not show that."""
        out_lo, out_hi = np.full(len(lo), -FAR), np.full(len(lo), FAR)
        if len(lo) > 1:
            same = d[1:] == d[:-1]
            to, of = (slice(None, -1), slice(1, None)) if step > 0 else (slice(1, None), slice(None, -1))
            out_lo[to] = np.where(same, np.minimum(lo[to], lo[of]), -FAR)
            out_hi[to] = np.where(same, np.maximum(hi[to], hi[of]), FAR)
        return out_lo, out_hi

    if not len(name):
        return name, doc, left, right
    # runs: a symbol's name now says how often it stands there, which the single symbols at its ends decide
    before, behind = reach(doc, left, right, -1), reach(doc, left, right, 1)
    head = np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]
    first = np.flatnonzero(head)
    last = np.r_[first[1:], len(name)] - 1
    count = last - first + 1
    run = np.where(count > 1, mix(name[first] * U64(0xD1342543DE82EF95) + count.astype(U64)), name[first])
    d = doc[first]
    lo = np.minimum(np.minimum.reduceat(left, first), before[0][first])
    hi = np.maximum.reduceat(right, first)
    lo, hi = np.minimum(lo, behind[0][last]), np.maximum(np.maximum(hi, behind[1][last]), before[1][first])
    # pairs: left class before right class
    after = (mix(run ^ U64(0x9E6C63D0876A9A47 + level)) & U64(1)).astype(bool)
    joins = np.zeros(len(run), bool)
    joins[:-1] = ~after[:-1] & after[1:] & (d[1:] == d[:-1])
    taken = np.r_[False, joins[:-1]]
    follow = np.r_[run[1:], U64(0)]
    new = np.where(joins, mix(run * U64(0xA0761D6478BD642F) + (follow ^ U64(level + 1)) * U64(0xE7037ED1A0B428DB)), run)
    before, behind = reach(d, lo, hi, -1), reach(d, lo, hi, 1)
    leans_back = after & ~joins
    out_lo, out_hi = (np.where(leans_back, x, y) for x, y in zip(before, behind, strict=True))
    stay = ~taken
    return new[stay], d[stay], out_lo[stay], out_hi[stay]


def window_anchors(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The anchor of the window at each place (windows may cross documents; the caller leaves those out)."""
    n = len(words)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    symbols = (mix(words), doc, np.arange(n), np.arange(1, n + 1))
    levels = [mix(words)]
    for level in (1, 2):
        symbols = recompress(*symbols, level)
        name, _, lo, hi = symbols
        reach = EXTENT[level]
        ok = (hi - lo <= reach) & (lo + reach <= n)
        at = lo[ok]
        least = np.full(n, NONE)
        if len(at):
            np.minimum.at(least, at, mix(name[ok] ^ window_hashes(words, reach)[at]) >> U64(1))
        levels.append(least)
    out = sliding_least(levels[0], WINDOW)
    for level in (1, 2):
        best = sliding_least(levels[level], WINDOW - EXTENT[level] + 1)[: len(out)]
        out = np.where(best != NONE, mix(best + U64(level)), out)
    return out


def anchor_runs(column: pa.Array) -> tuple:
    """Runs of windows with one anchor: (anchor, first window, windows, document), then word hashes and offsets."""
    data, offsets = text_bytes(column)
    words, _, ends = words_of(data, offsets, lower=False)
    if len(words) < WINDOW:
        none = np.zeros(0, np.int64)
        return none.view(U64), none, none, none, words, ends
    anchor = window_anchors(words, ends)
    change = np.r_[True, anchor[1:] != anchor[:-1]]
    change[ends[ends < len(anchor)]] = True
    start = np.flatnonzero(change)
    doc = np.searchsorted(ends, start, side="right") - 1
    count = np.minimum(np.r_[start[1:], len(anchor)], ends[doc + 1] - WINDOW + 1) - start
    keep = count > 0
    start, doc, count = start[keep], doc[keep], count[keep]
    pieces = -(-count // 32)
    which = np.repeat(np.arange(len(start)), pieces)
    shift = spread(np.zeros(len(start), np.int64), pieces) * 32
    return anchor[start[which]], start[which] + shift, np.minimum(32, count[which] - shift), doc[which], words, ends


def anchors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, start, count, doc, words, ends = anchor_runs(column)
    # equal windows can share one run where a text repeats at short distance; such runs are known to repeat
    known = np.zeros(len(found), bool)
    if len(found):
        names = window_hashes(words, WINDOW)[spread(start, count)]
        _, which, many = np.unique(names, return_inverse=True, return_counts=True)
        known = np.logical_or.reduceat(many[which] > 1, np.cumsum(count) - count)
    return found, known, np.searchsorted(doc, np.arange(len(ends)))


def pack_marks(uid: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, start, mask): marked window starts, 64 to a row."""
    at = at.astype(np.int64)
    by = np.lexsort((at, uid))
    uid, at = uid[by], at[by]
    start = at & ~63
    new = np.flatnonzero(np.r_[True, (uid[1:] != uid[:-1]) | (start[1:] != start[:-1])][: len(uid)])
    mask = np.bitwise_or.reduceat(U64(1) << (at & 63).astype(U64), new) if len(new) else np.zeros(0, U64)
    return uid[new], start[new].astype(np.uint32), mask


def word_ids(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Numbers that are equal where words are."""
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def later_copies(name: np.ndarray, doc: np.ndarray, at: np.ndarray, uid: np.ndarray, place: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows have an earlier one of the same words; windows are ids[place : place + WINDOW], names only find the candidates."""
    by = np.lexsort((uid, at, doc, name))
    n = name[by]
    new = np.r_[True, n[1:] != n[:-1]][: len(n)]
    twice = np.flatnonzero(~new)
    a, b = place[by][twice], place[by][twice - 1]
    differ = np.zeros(len(twice), bool)
    for j in range(WINDOW):
        differ |= ids[a + j] != ids[b + j]
    if differ.any():  # windows of one hash and other words: name all by their words
        rows = np.ascontiguousarray(ids[place[:, None] + np.arange(WINDOW)])
        _, exact = np.unique(rows.view(f"V{8 * WINDOW}").ravel(), return_inverse=True)
        return later_copies(exact.astype(U64), doc, at, uid, place, ids)
    u, t = uid[by], at[by]
    first = np.flatnonzero(new)
    head = np.repeat(first, np.diff(np.r_[first, len(n)]))
    out = np.zeros(len(name), bool)
    out[by] = (u != u[head]) | (t != t[head])  # a repeated row is the same window, not a copy
    return out


_HEAD = [np.uint32, np.int64, np.int64, np.uint32, np.uint32, np.uint8]  # key (part of the anchor), uid, doc, first window, mask of the windows listed, windows
SEND_WORDS = 1 << 21  # words a map task holds before it writes its blocks


def bits_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bit) of every bit set."""
    return np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little"))


def kernel(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    heads, ids, known = [], [], {}
    for raw in map(expand, raws):
        columns, at = from_planes(raw, int(np.frombuffer(raw, np.int64, 1)[0]), _HEAD, 8)
        heads.append(columns)
        ids.append(word_ids(raw[at:].split(), known))
    _, uid, doc, start, mask, count = (np.concatenate(c) for c in zip(*heads, strict=True))
    ids = np.concatenate(ids)
    size = count.astype(np.int64) + WINDOW - 1
    first = np.cumsum(size) - size
    which, bit = bits_of(mask)
    at, place = start[which].astype(np.int64) + bit, first[which] + bit
    late = later_copies(window_hashes(mix(ids.view(U64)), WINDOW)[place], doc[which], at, uid[which], place, ids)
    return pack_marks(uid[which][late], at[late])


def repeated_words(docs: DataFrame, hot_least: int = HOT_LEAST) -> DataFrame:
    """doc_id, text, uid, marks: the marked 20-word windows of each document, for covered()."""
    rows = with_uid(docs)
    parts = partitions(docs.sparkSession)
    buckets = parts * SPREAD
    found, hot = repeated_anchors(rows, anchors, hot_least)
    hottest = docs.sparkSession.sparkContext.broadcast(hot)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_freed_memory()
        held, size = [], 0
        for batch in batches:
            for part in text_slices(batch):
                held.append(_flagged(part))
                size += len(held[-1][7])
                if size > SEND_WORDS:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        moved = np.cumsum([0, *(len(h[7]) for h in held)])
        key, uid, doc, start, count, name = (np.concatenate([h[i] for h in held]) for i in range(6))
        first = np.concatenate([h[6] + m for h, m in zip(held, moved, strict=False)])
        words = [w for h in held for w in h[7]]
        held.clear()
        if not len(key):
            return
        ids = word_ids(words, {})
        run = np.repeat(np.arange(len(key)), count)
        bit = spread(np.zeros(len(key), np.int64), count)
        late = later_copies(name, doc[run], start[run] + bit, uid[run], first[run] + bit, ids)
        marks = pack_marks(uid[run][late], (start[run] + bit)[late])
        yield from blocks((mix(marks[0].view(U64)) % U64(buckets)).astype(np.int64), list(marks), True)
        run, bit, name = run[~late], bit[~late], name[~late]
        mask = np.zeros(len(key), np.uint32)
        np.bitwise_or.at(mask, run, np.uint32(1) << bit.astype(np.uint32))
        hot = is_in(key, hottest.value)
        single = hot[run]  # window by window, each under its own hash
        stay = np.flatnonzero((mask != 0) & ~hot)
        r, b = run[single], bit[single]
        key, mask = np.concatenate([key[stay], name[single]]), np.concatenate([mask[stay], np.ones(len(r), np.uint32)])
        uid, doc = np.concatenate([uid[stay], uid[r]]), np.concatenate([doc[stay], doc[r]])
        start, first = np.concatenate([start[stay], start[r] + b]), np.concatenate([first[stay], first[r] + b])
        count = np.concatenate([count[stay], np.ones(len(r), np.int64)])
        if not len(key):
            return
        bucket, part = ((key >> U64(20)) % U64(buckets)).astype(np.int64), (key >> U64(32)).astype(np.uint32)
        by = np.lexsort((part, bucket))
        cuts = np.flatnonzero(np.r_[True, bucket[by][1:] != bucket[by][:-1]])
        packed = []
        for s in np.split(by, cuts[1:]):
            head = planes([c[s].astype(t) for c, t in zip((part, uid, doc, start, mask, count), _HEAD, strict=True)])
            body = b" ".join([b" ".join(words[a:z]) for a, z in zip(first[s].tolist(), (first[s] + count[s] + WINDOW - 1).tolist(), strict=True)])
            packed.append(squeeze(np.int64(len(s)).tobytes() + head + body))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[by][cuts]), pa.array(np.zeros(len(cuts), bool)), pa.array(packed, pa.binary())], ["bucket", "sure", "packed"])

    sent = map_batches(attach(rows, found), send, BLOCK_SCHEMA)
    return with_marks(rows, meet_and_return(sent, kernel))


def _flagged(part: pa.RecordBatch) -> tuple:
    """key, uid, doc, first window in document, windows, window names, first word here of the runs at repeated anchors; all words."""
    key, start, count, doc, words, ends = anchor_runs(part.column("text"))
    begin = np.searchsorted(doc, np.arange(len(ends)))
    at = np.concatenate([np.zeros(0, np.int64), *(o[o < e - b] + b for o, b, e in zip(ordinals_of(part.column("ordinals")), begin, begin[1:], strict=False))])
    key, start, count, doc = key[at], start[at], count[at], doc[at]
    uid, ids = part.column("uid").to_numpy(), order_ids(part.column("doc_id"))
    names = window_hashes(words, WINDOW)[spread(start, count)] if len(at) else np.zeros(0, U64)
    shown = [w for t in part.column("text").to_pylist() for w in t.encode("utf-8", "surrogatepass").split()]
    return key, uid[doc], ids[doc], start - ends[doc], count, names, start, shown


def deduplicate_words(docs: DataFrame, hot_least: int = HOT_LEAST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the remaining words joined by a space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                rows = []
                for text, marks in zip(part.column("text").to_pylist(), part.column("marks").to_pylist(), strict=True):
                    words = text.encode("utf-8", "surrogatepass").split()  # bytes: exactly \x20 and \x09-\x0D
                    if marks:
                        gone = covered(marks, len(words), WINDOW)
                        kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                        removed = int(gone.sum())
                    else:
                        kept, removed = b" ".join(words), 0
                    rows.append((len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return map_batches(repeated_words(docs, hot_least).select("doc_id", "text", "marks"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op8_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_words(table(spark, sf_dir, "documents")).drop("kept")
