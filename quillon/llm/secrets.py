"""Secret scans: fixed patterns plus two character Markov models compared by log-likelihood ratio.

Training samples are labelled: "random" strings drawn over the alphabets that keys are issued in, and
"ordinary" identifiers, the words of a bounded sample of documents (MAX_TRAIN_DOCS) joined the ways code
joins them; no word list is built in, so the models suit the corpus that they are trained on. Both give a first-order Markov model over 66 character classes; a long unbroken run of key
characters is flagged when its mean log-likelihood ratio per transition reaches MIN_RATIO. Whole texts are scanned;
the pattern spans always stay and the models add `markov` spans that overlap none of them.

Defined cases: null and empty texts have no spans; a text of any length is scanned whole; repeated rows
each come back; spans that start together come in the order of KINDS; an empty table gives an empty result
(the ordinary model is then uniform).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._base import map_batches, table, text_slices

# Fixed values of the contract: the base patterns and the least lengths of what they must hold.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/")
MAX_TRAIN_DOCS = 500
MIN_RATIO = 1.0  # nats per transition

_CLASS = np.full(128, 65, np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_"):
    _CLASS[ord(_c)] = _i
N_CLASS = 66


def _codes(text: str) -> np.ndarray:
    return _CLASS[np.frombuffer(text.encode("ascii", "replace"), np.uint8) & 127]


class MarkovPair:
    """Log transition probabilities of random strings minus those of ordinary identifiers."""

    def __init__(self, ratio: np.ndarray):
        self.ratio = ratio

    @classmethod
    def fit(cls, random: list[str], ordinary: list[str]) -> MarkovPair:
        tables = []
        for sample in (random, ordinary):
            counts = np.zeros((N_CLASS, N_CLASS))
            for text in sample:
                c = _codes(text)
                np.add.at(counts, (c[:-1], c[1:]), 1)
            single = counts.sum(0) + 0.5
            counts += 5 * single / single.sum()  # pairs not seen fall back on how common the second character is
            tables.append(np.log(counts / counts.sum(1, keepdims=True)))
        return cls(tables[0] - tables[1])

    def score(self, text: str) -> float:
        c = _codes(text)
        return float(self.ratio[c[:-1], c[1:]].mean()) if len(c) > 1 else 0.0


def labelled_samples(texts: list[str], seed: int = 7) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers) to learn from."""
    rng = np.random.default_rng(seed)
    random = ["".join(rng.choice(list(a), int(rng.integers(20, 65)))) for a in ALPHABETS for _ in range(500)]
    words = [w for t in texts for w in re.findall(r"[A-Za-z]{2,20}", t)]
    words = [words[i] for i in rng.permutation(len(words))[:60_000]]
    joined = []
    for i in range(0, len(words) - 2, 3):
        a = words[i : i + 3]
        joined.append(("_".join(a), "-".join(a).lower(), "/".join(a), a[0].lower() + a[1].title() + a[2].title(), "_".join(a).upper(), "".join(a).lower())[i // 3 % 6])
    return random, joined + words


def find_spans(text: str, model: MarkovPair, min_ratio: float = MIN_RATIO) -> tuple[list[tuple], list[tuple]]:
    """(base, added) spans as (start, kind index, end), in code points."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    added = []
    for m in CANDIDATE.finditer(text):
        if any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        if model.score(m.group()) >= min_ratio:
            added.append((m.start(), 3, m.end()))
    return base, added



def train(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> MarkovPair:
    """Ordinary words come from at most about `max_docs` documents, chosen by a hash of doc_id."""
    n = docs.select("doc_id").count()
    share = min(1.0, max_docs / max(n, 1))
    picked = docs.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    texts = picked.select(F.col("text").cast("string").alias("t")).collect()
    return MarkovPair.fit(*labelled_samples(sorted(r.t for r in texts if r.t)))


def scan_secrets(docs: DataFrame, model: MarkovPair, min_ratio: float = MIN_RATIO) -> DataFrame:
    """One row per document: doc_id and its spans as structs (start, end, kind)."""
    ratio = model.ratio

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = MarkovPair(ratio)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            for part in text_slices(batch):
                found = []
                for text in part.column("text").to_pylist():
                    base, added = find_spans(text or "", own, min_ratio)
                    found.append([{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in sorted(base + added)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(texts, run, "doc_id long, spans array<struct<start:long,end:long,kind:string>>")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from scan_secrets()'s rows."""
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest(scan_secrets(docs, train(docs)))

