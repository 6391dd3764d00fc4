"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training rows are those with a language whose crc32(doc_id as text) mod 5 is not 0, at most about
`max_docs` per language (chosen by a hash of doc_id); their counts over BUCKETS hashed 1- to 4-grams make
one log-probability matrix, broadcast to the executors. It holds at most CELLS floats: over CELLS / BUCKETS
(512) languages the buckets are halved until it fits, so every label can be learned and predicted; over
MAX_LANGS labels an error says so. Scoring turns each slice of texts into (document, bucket) indices, gathers matrix rows and sums
them per document, all in numpy; whole texts are scored. score is the posterior of the chosen language.

Defined cases: a text that is null or has no letter is `und` with score 0; with no training rows all are
`und`; ties go to the language that sorts first; repeated rows each come back; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._base import U64, map_batches, mix, table, text_slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
MAX_TRAIN_DOCS = 4000  # per language, about
CELLS = 1 << 24
MAX_LANGS = 1 << 16
CHUNK = 1 << 19  # code points scored in one pass


def held_out():
    """Rows kept out of training; a null doc_id counts as such."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


@cache
def letters() -> np.ndarray:
    """Per code point: its lower-case letter, or 0 if it is none."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def buckets_for(languages: int) -> int:
    """The largest power of two up to BUCKETS with which the matrix has at most CELLS floats."""
    return min(BUCKETS, 1 << ((CELLS // max(languages, 1)).bit_length() - 1))


def hashed_grams(texts: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document index, bucket) of every n-gram of letters, runs of other characters counting as one mark."""
    fold = letters()
    group, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), CHUNK):
            piece = text[at : at + CHUNK + max(ORDERS) - 1]
            group.append((i, piece, at + CHUNK < len(text)))
            size += len(piece)
            if size >= CHUNK:
                yield _grams(group, fold, buckets)
                group, size = [], 0
    if group:
        yield _grams(group, fold, buckets)


def _grams(group: list, fold: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer("".join("\0" + t for _, t, _ in group).encode("utf-32-le", "surrogatepass"), np.uint32)
    docs = np.repeat([i for i, _, _ in group], [len(t) + 1 for _, t, _ in group])
    c = fold[raw]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c, docs = c[keep].astype(U64) + U64(1), docs[keep]
    out_docs, out = [], []
    rolled = np.zeros(len(c), U64)
    for n in range(1, max(ORDERS) + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        rolled = rolled[:m] * U64(0x100000001B3) + c[n - 1 :] * U64(0x9E3779B97F4A7C15)
        if n in ORDERS:
            ok = docs[:m] == docs[n - 1 :]
            if n == 1:
                ok &= c != 1
            out.append((mix(rolled + U64(n)) & U64(buckets - 1)).astype(np.int32)[ok])
            out_docs.append(docs[:m][ok])
    return np.concatenate(out_docs), np.concatenate(out)


class LanguageModel:
    def __init__(self, languages: list[str], log_prob: np.ndarray, prior: np.ndarray):
        self.languages, self.log_prob, self.prior = languages, log_prob, prior

    @classmethod
    def from_counts(cls, languages: list[str], counts: np.ndarray, docs: np.ndarray) -> LanguageModel:
        smooth = counts + 0.1
        log_prob = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)
        return cls(languages, np.ascontiguousarray(log_prob.T), np.log(docs / max(docs.sum(), 1)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n, k = len(texts), len(self.languages)
        total, seen = np.tile(self.prior, (n, 1)) if k else np.zeros((n, 0)), np.zeros(n, np.int64)
        for docs, buckets in hashed_grams([t or "" for t in texts], len(self.log_prob)):
            if k:
                starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, np.int64)
                if len(starts):
                    np.add.at(total, docs[starts], np.add.reduceat(self.log_prob[buckets], starts, axis=0, dtype=np.float64))
            seen += np.bincount(docs, minlength=n)
        has = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        if not k:
            return ["und"] * n, np.zeros(n)
        best = total.argmax(1) if n else np.zeros(0, int)
        top = total.max(1, keepdims=True) if n else total
        score = 1 / np.exp(total - top).sum(1)
        return [self.languages[b] if h else "und" for b, h in zip(best, has, strict=True)], np.where(has, score, 0.0)


def train(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> LanguageModel:
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} different labels in lang: not a column of languages")
    languages, size = sorted(sizes), buckets_for(len(sizes))
    place = {lang: i for i, lang in enumerate(languages)}
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    cut = docs.sparkSession.createDataFrame([(x, int(min(1.0, max_docs / sizes[x]) * (1 << 20)) + 1) for x in languages], "lang string, cut long")
    picked = rows.join(F.broadcast(cut), "lang").filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < F.col("cut")).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), size), np.int64)
        for batch in batches:
            for part in text_slices(batch):
                which = np.array([place[x] for x in part.column("lang").to_pylist()], np.int64)
                for at, buckets in hashed_grams(part.column("text").to_pylist(), size):
                    sums += np.bincount(which[at] * size + buckets, minlength=sums.size).reshape(sums.shape)
        for i in np.flatnonzero(sums.any(1)):
            (at,) = np.nonzero(sums[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(at), pa.array(sums[i, at])], ["lang", "bucket", "n"])

    few = picked.repartition(8)  # a bounded sample: few partial count vectors
    got = map_batches(few, count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), size))
    counts[got["lang"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    return LanguageModel.from_counts(languages, counts, np.array([sizes[x] for x in languages], float))


def predict_language(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default doc_id) plus lang_pred and score."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_prob, model.prior))
    names = ["lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        for batch in batches:
            for part in text_slices(batch):
                lang, score = own.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, *names])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(docs.select(*dict.fromkeys([*keep, "text"])), run, f"{fields}, lang_pred string, score double")


MIN_SCORE = 0.5


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Documents with a predicted language and at least `min_score`; `und` ones go. Columns keep their names, whatever they are."""
    names = docs.columns
    safe = docs.select(*(F.col(f"`{c}`").alias(c if c in ("doc_id", "text", "lang") else f"_c{i}") for i, c in enumerate(names)))
    held = predict_language(safe, train(safe), safe.columns).filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return held.select(*(F.col(s).alias(c) for s, c in zip(safe.columns, names, strict=True)))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = predict_language(docs, train(docs))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
