"""Byte-level BPE by backtracking over longest matches.

An Aho-Corasick automaton over all tokens finds the longest token at every start of a pretoken. The encoder
takes it, checks the seam with the token before it against the pair-compatibility relation (would the merges,
run in rank order, ever cross that seam?), falls back to the next shorter token or one step back where the
seam is impossible, and so reaches the one exact merge result while looking at each position a bounded
number of times. Decoding looks ids up in one byte string through an offset table.

Tables come from a tokenizers JSON file whose path is a parameter; its text is broadcast (a vocabulary file
of fixed size, 1.5 MB). Memory per worker is bounded: memo tables empty themselves at MEMO entries.

Defined cases: null and empty texts have no ids and decode to an empty text; the special token's string in a
text gives its id, as the library does; repeated rows each come back; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._base import map_batches, table, text_slices

# Fixed value: how byte-level BPE of this vocabulary cuts text.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 120_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself where printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class BpeCodec:
    """Internal tokens: 0..255 the bytes, 256 + i what merge i makes; `ids` maps them to the file's ids."""

    def __init__(self, config: str, quick: bool = False):
        """quick: leave the merging of words to the tiktoken library, for callers that only need the ids."""
        data = json.loads(config)
        letters = byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        vocab = {spell(s): i for s, i in data["model"]["vocab"].items() if all(c in letters for c in s)}
        self.token = [bytes([b]) for b in range(256)]
        self.number = {t: i for i, t in enumerate(self.token)}
        self.parts = [(b, b) for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        for merge in data["model"]["merges"]:
            a, b = (spell(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            pair, made = (self.number[a], self.number[b]), a + b
            if made not in self.number:
                self.number[made] = len(self.token)
                self.token.append(made)
                self.parts.append(pair)
            self.pairs.setdefault(pair, self.number[made])
        self.length = [len(t) for t in self.token]
        self.ids = np.array([vocab[t] for t in self.token], np.uint32)
        self.id_bytes = [i.tobytes() for i in self.ids]
        self.quick = None
        if quick:
            import tiktoken

            self.quick = tiktoken.Encoding("same", pat_str=PRETOKENS, mergeable_ranks=dict(self.number), special_tokens={})
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.token):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.seams: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.cut = regex.compile(PRETOKENS)
        self.apart = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.odd_space = re.compile(r"\s (?:\s|\Z)")
        size = max([*self.ids.tolist(), *self.special.values()]) + 1
        spelled = [b""] * size
        for i, t in zip(self.ids.tolist(), self.token, strict=True):
            spelled[i] = t
        for s, i in self.special.items():
            spelled[i] = s.encode()
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(s) for s in spelled])))

    def prefix_of(self, token: int) -> int:
        """The next shorter token that begins this one, or -1."""
        found = self.shorter.get(token)
        if found is None:
            text = self.token[token][:-1]
            while text and text not in self.number:
                text = text[:-1]
            found = self.shorter[token] = self.number[text] if text else -1
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging left's and right's bytes in rank order leaves a seam between them."""
        key = (left, right)
        found = self.seams.get(key)
        if found is None:
            if len(self.seams) > MEMO:
                self.seams.clear()
            found = self.seams[key] = self._seam(left, right)
        return found

    def _seam(self, left: int, right: int) -> bool:
        # Undo merges from the latest back. A merge across the seam happens only if it ranks before the
        # merges that formed the two tokens beside it at that moment.
        before = len(self.token)
        while True:
            made = self.pairs.get((left, right))
            if made is not None and made < before:
                return False
            if left > right:
                before, left = left, self.parts[left][1]
                if left == before:
                    return True
            else:
                # equal ranks apply from the left, so the right token's own merge still counts
                before = right + 1
                step = self.parts[right][0]
                if step == right:
                    before, step = left, self.parts[left][1]
                    if step == left:
                        return True
                    left = step
                else:
                    right = step

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        whole = self.number.get(word)
        if n == 1:
            return [whole]
        text = word.decode("latin-1")
        greedy = [token for _, token in self.automaton.iter_long(text)]
        if all(map(self.compatible, greedy, greedy[1:])):
            return greedy  # no seam fails, so the search below would take these very tokens
        longest = [-1] * n
        for end, token in self.automaton.iter(text):
            start = end - self.length[token] + 1
            if longest[start] < 0 or self.length[token] > self.length[longest[start]]:
                longest[start] = token
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + self.length[token]
            if open_at[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                continue
            token = self.prefix_of(token)
            if token < 0:
                open_at[at] = 0
                token = out.pop()
                at -= self.length[token]

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > MEMO:
                self.words.clear()
            found = self.words[word] = b"".join(map(self.id_bytes.__getitem__, self.encode_word(word.encode("utf-8", "surrogatepass"))))
        return found

    def _chunk(self, piece: str) -> bytes:
        """Ids of a space and what follows it up to the next one."""
        if self.quick:
            return b"".join(map(self.id_bytes.__getitem__, self.quick.encode_ordinary(" " + piece)))
        if piece.isalpha():  # letters only: one pretoken
            return self._word(" " + piece)
        if piece[:-1].isalpha() and piece[-1] in ",.":
            return self._word(" " + piece[:-1]) + self._word(piece[-1])
        return b"".join(map(self._word, self.cut.findall(" " + piece)))

    def _plain(self, text: str) -> bytes:
        # A cut before a space is a pretoken edge unless white space stands on both sides of that space.
        if self.odd_space.search(text):
            return b"".join(map(self._word, self.cut.findall(text)))
        first, *rest = text.split(" ")
        out = list(map(self.chunks.get, rest))
        if None in out:
            if len(self.chunks) > MEMO:
                self.chunks.clear()
            for i, found in enumerate(out):
                if found is None:
                    piece = rest[i]
                    out[i] = self.chunks.get(piece)
                    if out[i] is None:
                        out[i] = self.chunks[piece] = self._chunk(piece)
        return b"".join([*map(self._word, self.cut.findall(first)), *out])

    def encode(self, text: str) -> np.ndarray:
        if self.apart and any(s in text for s in self.special):
            parts = [np.uint32(self.special[p]).tobytes() if p in self.special else self._plain(p) for p in self.apart.split(text) if p]
            return np.frombuffer(b"".join(parts), np.uint32)
        return np.frombuffer(self._plain(text), np.uint32) if text else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        first = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        return self.spelled[first + np.arange(len(first))].tobytes().decode("utf-8", "replace")


@cache
def codec(config: str, quick: bool = False) -> BpeCodec:
    return BpeCodec(config, quick)


def broadcast_config(spark: SparkSession, path: str | None = None):
    with open(path or default_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text."""
    config = broadcast_config(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(config.value)
        for batch in batches:
            for part in text_slices(batch):
                ids = [own.encode(t or "") for t in part.column("text").to_pylist()]
                flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(texts, run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of encode_documents() with a column `decoded`; null ids decode to an empty text."""
    config = broadcast_config(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(config.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column("ids")
                texts = [own.decode(x.values.to_numpy()) if x.is_valid else "" for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, decoded string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode_documents(encode_documents(table(spark, sf_dir, "documents")))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
