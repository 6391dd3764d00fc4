"""Suffix-array dedup of byte strings.

Removes every byte covered by a 50-byte string that also starts in a document with a smaller doc_id. Each
window's anchor is its 16-byte string of least hash (see _anchors for how anchors met only once are dropped); runs of
windows with one anchor travel as short segments of text, equal segments of a map task once. Where the
segments of an anchor meet, equal ones (compared byte by byte) are one class; where an anchor has several
classes a suffix array of them is built by two-stage sorting: only suffixes smaller than their
successor are sorted directly (to the depth that matters), the others are induced by one scan over the
symbol buckets; suffixes that neither start a window nor are needed to induce one that does are left out.
Adjacent common prefixes of at least 50 bytes then give the equal windows and, in each class of them, the
smallest doc_id. Hashes choose anchors and find equal segments; they decide nothing.

Defined cases: null is empty; texts under 50 bytes lose nothing; matches do not cross documents and a
document never matches itself or a row with its own doc_id; rows that repeat one another are answered alike; a null doc_id
counts as largest; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.llm._anchors import BLOCK_SCHEMA, HOT_LEAST, SPREAD, attach, blocks, covered, expand, from_planes, is_in, meet_and_return, order_ids, ordinals_of, planes, repeated_anchors, squeeze, with_marks, with_uid
from quillon.llm._base import U64, map_batches, mix, partitions, release_freed_memory, spread, table, text_bytes, text_slices

WINDOW = 50
GRAM = 16
MARK = 0xFF  # never a byte of UTF-8, so it can end segments
BLOCK = 1 << 13  # windows or segments hashed at a time, so that what is in between stays in the cache
ODD = [U64(0xC6A4A7935BD1E995), U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93)]


def eights(data: np.ndarray, order: str = "<") -> np.ndarray:
    """Eight bytes from each place on as one number: a view, not aligned."""
    return np.ndarray((max(len(data) - 7, 0),), f"{order}u8", np.ascontiguousarray(data), strides=(1,))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def least_hashes(data: np.ndarray) -> np.ndarray:
    """For each window the least hash of the GRAM-byte strings in it."""
    span = WINDOW - GRAM + 1
    eight = eights(data)
    out = np.empty(max(len(data) - WINDOW + 1, 0), U64)
    for at in range(0, len(out), BLOCK):
        to = min(len(out), at + BLOCK)
        part = eight[at : to + WINDOW - 8].astype(U64)
        grams = part[: 8 - GRAM] * ODD[0]
        grams += part[GRAM - 8 :] * ODD[1]
        grams ^= grams >> U64(32)
        grams *= ODD[2]
        grams ^= grams >> U64(29)
        out[at:to] = sliding_least(grams, span)
    return out


def anchor_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows, document) of each run of windows that have their anchor in one place."""
    span = WINDOW - GRAM + 1
    if len(data) < WINDOW:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = least_hashes(data)
    # A run ends where the least hash changes or a document begins, so runs depend on their document alone.
    change = np.r_[True, least[1:] != least[:-1]]
    change[offsets[offsets < len(least)]] = True
    start = np.flatnonzero(change)
    doc = np.searchsorted(offsets, start, side="right") - 1
    count = np.minimum(np.r_[start[1:], len(least)], offsets[doc + 1] - WINDOW + 1) - start
    keep = count > 0
    start, doc, count = start[keep], doc[keep], count[keep]
    pieces = -(-count // span)  # over `span` windows: equal grams follow each other
    which = np.repeat(np.arange(len(start)), pieces)
    shift = spread(np.zeros(len(start), np.int64), pieces) * span
    return least[start[which]], start[which] + shift, np.minimum(span, count[which] - shift), doc[which]


def anchors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    found, _, _, doc = anchor_runs(data, offsets)
    return found, np.zeros(len(found), bool), np.searchsorted(doc, np.arange(len(offsets)))


def _ties(same: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places among `at` whose key equals a neighbour's, `same` telling equality with the one before, and their groups' numbers."""
    tie = same.copy()
    tie[:-1] |= same[1:]
    number = np.cumsum(tie & ~same)
    return at[tie], number[tie]


def suffix_order(text: np.ndarray, eight: np.ndarray, depth: int = WINDOW, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of text (bytes) in order of at least their first `depth` symbols, by two-stage sorting. eight: packed_eights of the padded text.
    wanted (boolean by place): only these suffixes, and those that they are induced from, are sorted."""
    n = len(text)
    # a suffix is smaller than its successor if the next different symbol is larger; the last run's are not
    runs = np.flatnonzero(np.r_[True, text[1:] != text[:-1]][:n])
    head = text[runs]
    smaller = np.repeat(np.r_[head[1:] > head[:-1], False][: len(runs)], np.diff(np.r_[runs, n]))
    direct = np.flatnonzero(smaller)
    previous = np.full(n, -1, np.int16)  # the symbol before; -1 where the suffix before is not wanted
    previous[1:] = text[:-1]
    if wanted is not None:  # a suffix that is not sorted directly is induced from the next one
        last = np.flatnonzero(wanted & ~np.r_[wanted[1:], False][:n])
        wanted = wanted.copy()
        wanted[spread(last, np.r_[direct, n - 1][np.searchsorted(direct, last)] - last + 1)] = True
        direct = np.flatnonzero(smaller & wanted)
        previous[1:][~wanted[:-1]] = -1
    first = eight[direct]
    order = np.argsort(first)
    direct, first = direct[order], first[order]
    at, group = _ties(np.r_[False, first[1:] == first[:-1]][: len(first)], np.arange(len(direct)))
    done = 8
    while len(at) and done < depth:  # tied suffixes by as many further symbols as fit beside the group's number
        fits = (64 - int(group[-1]).bit_length()) // 8
        tied = direct[at]
        more = eight[tied + done] >> U64(64 - 8 * fits) | group.astype(U64) << U64(8 * fits)
        order = np.argsort(more)
        direct[at], more = tied[order], more[order]
        at, group = _ties(np.r_[False, more[1:] == more[:-1]], at)
        done += fits
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and (wanted is None or wanted[-1]):
        induced[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        if not induced[c] and bounds[c] == bounds[c + 1]:
            continue
        layer = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        here = [layer]
        while len(layer):
            layer = layer[previous[layer] == c] - 1
            here.append(layer)
        whole = np.concatenate([*here, direct[bounds[c] : bounds[c + 1]]])
        out.append(whole)
        symbol = previous[whole]
        up = symbol > c
        before, symbol = whole[up] - 1, symbol[up]
        if len(before):
            by = np.argsort(symbol, kind="stable")
            before, symbol = before[by], symbol[by]
            cuts = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
            for a, b in zip(cuts, np.r_[cuts[1:], len(symbol)], strict=True):
                induced[symbol[a]].append(before[a:b])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def packed_eights(padded: np.ndarray) -> np.ndarray:
    """Eight symbols from each place on as one number that sorts like them."""
    return eights(padded, ">").astype(U64)


def window_owners(text: np.ndarray, valid: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each valid window start: the smallest owner among the starts of equal windows."""
    eight = packed_eights(np.r_[text, np.zeros(WINDOW + 16, np.uint8)])
    wanted = np.zeros(len(text), bool)
    wanted[valid] = True
    order = suffix_order(text, eight, wanted=wanted)
    place = np.full(len(text) + 1, -1, np.int64)
    place[valid] = np.arange(len(valid))
    rank = place[order]
    rank = rank[rank >= 0]
    at = valid[rank]
    same = np.ones(max(len(at) - 1, 0), bool)
    for s in (*range(0, WINDOW - 8, 8), WINDOW - 8):  # common prefix with the suffix before is 50 at least
        part = eight[at + s]
        same &= part[1:] == part[:-1]
    starts = np.flatnonzero(np.r_[True, ~same][: len(at)])
    out = np.zeros(len(valid), np.int64)
    if len(at):
        least = np.minimum.reduceat(owner[rank], starts)
        out[rank] = np.repeat(least, np.diff(np.r_[starts, len(at)]))
    return out


_HEAD = [np.uint32, np.int64, np.int64, np.uint32, np.uint8]  # key (part of the anchor), uid, doc, start, count
PART_BYTES = 1 << 20  # segment text that is sorted at a time, unless one anchor alone has more
SEND_BYTES = 1 << 24  # text a map task holds before it writes its blocks
STEP = 1 << 15  # segments named or compared at a time


def _pack(key, uid, doc, start, count, data, first) -> bytes:
    body = data[spread(first, count + WINDOW - 1)].tobytes()
    head = planes([c.astype(t) for c, t in zip((key, uid, doc, start, count), _HEAD, strict=True)])
    return squeeze(np.int64(len(uid)).tobytes() + head + body)


def _segments(raws: list[bytes]) -> tuple:
    heads, bodies = [], []
    for raw in map(expand, raws):
        columns, at = from_planes(raw, int(np.frombuffer(raw, np.int64, 1)[0]), _HEAD, 8)
        heads.append(columns)
        bodies.append(np.frombuffer(raw, np.uint8, offset=at))
    key, uid, doc, start, count = (np.concatenate(c) for c in zip(*heads, strict=True))
    return key, uid, doc, start, count.astype(np.int64), np.concatenate(bodies)


def names_of(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each data[first : first + size] (size 8 at least), by eight bytes at a time; the last eight may overlap others."""
    eight, out = eights(data), [np.zeros(0, U64)]
    for at in range(0, len(first), BLOCK):
        f, last = first[at : at + BLOCK], size[at : at + BLOCK] - 8
        name = mix(last.astype(U64) * ODD[1])
        for s in range(0, int(last.max()) + 8, 8):
            name ^= eight[f + np.minimum(s, last)]
            name *= ODD[0]
            name ^= name >> U64(32)
        out.append(mix(name))
    return np.concatenate(out)


def classes(key: np.ndarray, name: np.ndarray, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(representative of each class, class of each segment): segments of one key and equal bytes. Names only find them; bytes decide."""
    by = np.lexsort((name, size, key))
    new = np.r_[True, (key[by][1:] != key[by][:-1]) | (size[by][1:] != size[by][:-1]) | (name[by][1:] != name[by][:-1])][: len(by)]
    one, which = by[new], np.empty(len(by), np.int64)
    which[by] = np.cumsum(new) - 1
    others = np.flatnonzero(one[which] != np.arange(len(key)))
    for at in range(0, len(others), STEP):
        other = others[at : at + STEP]
        n = size[other]
        differ = data[spread(first[other], n)] != data[spread(first[one[which[other]]], n)]
        if differ.any():  # two texts of one hash: name by the bytes themselves
            exact: dict[bytes, int] = {}
            ids = [exact.setdefault(data[f : f + n].tobytes(), len(exact)) for f, n in zip(first, size, strict=True)]
            return classes(key, np.array(ids, U64), data, first, size)
    return one, which


def full(count: np.ndarray) -> np.ndarray:
    return (U64(1) << count.astype(U64)) - U64(1)


def kernel(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks of a bucket, anchor by anchor: equal windows have one anchor."""
    key, uid, doc, start, count, body = _segments(raws)
    size = count + WINDOW - 1
    first = np.cumsum(size) - size
    one, which = classes(key, names_of(body, first, size), body, first, size)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    # one and its classes ascend by key; anchors with one class only need no sorting
    owner = key[one]
    edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][: len(owner)])
    many = np.diff(np.r_[edge, len(owner)])
    several = np.flatnonzero(np.repeat(many > 1, many))
    piece = (np.cumsum(size[one[several]]) // PART_BYTES)[np.searchsorted(owner[several], owner[several])]  # an anchor stays in one piece
    masks = np.zeros(len(one), U64)
    for i in np.split(several, np.flatnonzero(np.diff(piece)) + 1):
        if len(i):
            masks[i] = _class_masks(body, first[one[i]], count[one[i]], least[i])
    mask = np.where(doc > least[which], full(count), masks[which])
    hit = mask != 0
    return uid[hit], start[hit], mask[hit]


def _class_masks(body: np.ndarray, first: np.ndarray, count: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Per class of segments: which of its windows a smaller doc_id has in another class."""
    size = count + WINDOW - 1
    begin = np.cumsum(size + 1) - size - 1
    text = np.full(int((size + 1).sum()), MARK, np.uint8)
    text[spread(begin, size)] = body[spread(first, size)]
    owners = window_owners(text, spread(begin, count), np.repeat(least, count))
    marked = (owners < np.repeat(least, count)).astype(U64) << spread(np.zeros(len(count), np.int64), count).astype(U64)
    return np.bitwise_or.reduceat(marked, np.cumsum(count) - count)


def repeated_bytes(docs: DataFrame, hot_least: int = HOT_LEAST) -> DataFrame:
    """doc_id, text, uid, marks: the marked 50-byte windows of each document, for covered()."""
    rows = with_uid(docs)
    parts = partitions(docs.sparkSession)
    buckets = parts * SPREAD
    found, hot = repeated_anchors(rows, anchors, hot_least)
    known = docs.sparkSession.sparkContext.broadcast(hot)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_freed_memory()
        held, size = [], 0
        for batch in batches:
            for part in text_slices(batch):
                held.append(_flagged(part))
                size += len(held[-1][6])
                if size > SEND_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        moved = np.cumsum([0, *(len(h[6]) for h in held)])
        key, uid, doc, start, count, name = (np.concatenate([h[i] for h in held]) for i in range(6))
        data = np.concatenate([h[6] for h in held])
        first = np.concatenate([h[7] + m for h, m in zip(held, moved, strict=False)])
        held.clear()
        hot = is_in(key, known.value)
        if hot.any():  # window by window, each under its own hash
            n = count[hot]
            single = spread(first[hot], n)
            own = names_of(data, single, np.full(len(single), WINDOW))
            shown = [np.repeat(uid[hot], n), np.repeat(doc[hot], n), spread(start[hot], n), np.ones(len(single), np.int64)]
            uid, doc, start, count = (np.concatenate([c[~hot], x]) for c, x in zip((uid, doc, start, count), shown, strict=True))
            key, name, first = np.concatenate([key[~hot], own]), np.concatenate([name[~hot], own]), np.concatenate([first[~hot], single])
        if not len(key):
            return
        one, which = classes(key, name, data, first, count + WINDOW - 1)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc)
        later = doc > least[which]  # an equal segment with a smaller doc_id is right here
        yield from blocks((mix(uid[later].view(U64)) % U64(buckets)).astype(np.int64), [uid[later], start[later].astype(np.uint32), full(count[later])], True)
        stay = np.flatnonzero(~later)
        bucket = ((key[stay] >> U64(20)) % U64(buckets)).astype(np.int64)
        part = (key[stay] >> U64(32)).astype(np.uint32)
        by = np.lexsort((part, bucket))
        stay, bucket, part = stay[by], bucket[by], part[by]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
        packed = [_pack(p, uid[s], doc[s], start[s], count[s], data, first[s]) for s, p in zip(np.split(stay, cuts[1:]), np.split(part, cuts[1:]), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(np.zeros(len(cuts), bool)), pa.array(packed, pa.binary())], ["bucket", "sure", "packed"])

    sent = map_batches(attach(rows, found), send, BLOCK_SCHEMA)
    marks = meet_and_return(sent, kernel)
    return with_marks(rows, marks)


def _flagged(part: pa.RecordBatch) -> tuple:
    """key, uid, doc, start in document, windows, name, bytes of all texts, first byte there: the runs at repeated anchors."""
    data, offsets = text_bytes(part.column("text"))
    key, start, count, doc = anchor_runs(data, offsets)
    begin = np.searchsorted(doc, np.arange(len(offsets)))
    at = np.concatenate([np.zeros(0, np.int64), *(o[o < e - b] + b for o, b, e in zip(ordinals_of(part.column("ordinals")), begin, begin[1:], strict=False))])
    key, start, count, doc = key[at], start[at], count[at], doc[at]
    uid, ids = part.column("uid").to_numpy(), order_ids(part.column("doc_id"))
    name = names_of(data, start, count + WINDOW - 1)
    return key, uid[doc], ids[doc], start - offsets[doc], count, name, data.copy(), start


def deduplicate_bytes(docs: DataFrame, hot_least: int = HOT_LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary: the remaining bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                rows = []
                for text, marks in zip(part.column("text").to_pylist(), part.column("marks").to_pylist(), strict=True):
                    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                    gone = covered(marks, len(data), WINDOW)
                    spans = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])) if len(gone) else 0
                    kept = data[~gone].tobytes()
                    rows.append((len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return map_batches(repeated_bytes(docs, hot_least).select("doc_id", "text", "marks"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_bytes(table(spark, sf_dir, "documents")).drop("kept")
