"""Repetition inside a single document (problem 10).

Public vocabularies measure each text: characters per token, share of byte-fallback tokens and entropy of the
tokens; documents outside their script's bands are rejected. For the share of repeated words the entropy is that of
runs of six tokens, of the words as they are compared: a text without repetition has the greatest there can
be, and each run that occurred before takes away two parts in the number of runs at least. So the band below the greatest entropy that
holds all documents with enough repetition is known for each document from its words and its fertility (tokens a
word, which differs by language and script); nothing that repeats is outside of it. Documents in
the band are the candidates, and the exact share of words confirms them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.tokenizer import TOKENIZERS, encoder
from corpusmill.llm.words import CACHE_PIECES, DIGITS, WORD, WordHasher

RUN = 6
MEASURES = "words bigint, repeat_share double, chars_per_token double, byte_fallback_share double, token_entropy double, script string"


def _runs(ids: np.ndarray, run: int) -> np.ndarray:
    """A hash of each run of ``run`` ids (none for fewer ids)."""
    n = len(ids)
    h = np.zeros(max(0, n - run + 1), np.uint64)
    mixed = ids ^ (ids >> np.uint64(29))
    for j in range(run if len(h) else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mixed[j : n - run + 1 + j]
    return h


def repeat_share(words: np.ndarray, run: int = RUN) -> float:
    """Share of the words that lie in a run of ``run`` words equal to a run starting earlier (0 for fewer words)."""
    n = len(words)
    if n <= run:
        return 0.0
    h = _runs(words, run)
    order = np.argsort(h, kind="stable")
    again = order[1:][h[order[1:]] == h[order[:-1]]]  # stable: the first of equal runs is the earliest
    if not len(again):
        return 0.0
    edge = np.zeros(n + 1, np.int32)
    edge[again] += 1
    np.add.at(edge, again + run, -1)
    return float(np.count_nonzero(np.cumsum(edge[:n]))) / n


def entropy(ids: np.ndarray) -> float:
    """Shannon entropy in bits of the ids (0 for none)."""
    if not len(ids):
        return 0.0
    s = np.sort(ids)
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
    p = np.diff(at) / len(s)
    return float(-(p * np.log2(p)).sum())


def run_deficit(ids: np.ndarray, run: int = RUN) -> float:
    """Runs of ``run`` ids times the bits by which their entropy is below its greatest, the logarithm of their number."""
    h = _runs(ids, run)
    s = np.sort(h)
    m = np.diff(np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])) if len(s) else np.empty(0, np.int64)
    m = m[m > 1]
    return float((m * np.log2(m)).sum())


def in_band(deficit: float, words: int, share: float, run: int = RUN) -> bool:
    """Whether ``share`` of the words can stand in repeats.

    They are covered by at least ``share * words / run`` runs of words that occurred before, and each begins a run of
    tokens that occurred before. ``r`` repeated runs lower the entropy of ``n`` runs by at least ``2 r / n``.
    """
    return deficit >= 2 * share * words / run - 1e-6


def script_of(text: str) -> str:
    """The script of most letters above ASCII, ``latin`` when those are few or Latin."""
    if text.isascii():
        return "latin"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = np.count_nonzero(codes >= 0x370)
    letters = np.count_nonzero(codes >= 0x41)
    if 2 * high < letters:
        return "latin"
    cyrillic = np.count_nonzero((codes >= 0x400) & (codes < 0x530))
    return "cyrillic" if 2 * cyrillic >= high else "other"


class _Fertility:
    """Pieces and byte-fallback pieces of a sentencepiece vocabulary, by blank-separated piece of text."""

    def __init__(self, folder: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, "piece_bpe_32k.model"))
        self.known: dict[str, tuple[int, int]] = {}

    def counts(self, text: str) -> tuple[int, int]:
        known, n, fallback = self.known, 0, 0
        if len(known) > CACHE_PIECES:
            known.clear()
        for p in text.split(" "):
            if (c := known.get(p)) is None:
                ids = self.model.encode(p)
                c = known[p] = len(ids), sum(map(self.model.is_byte, ids))
            n += c[0]
            fallback += c[1]
        return n, fallback


class TokenHasher(WordHasher):
    """Tokens of a text's words, each word as it is compared; the first token of a word is marked, so words can be counted."""

    FIRST = 1 << 40

    def __init__(self, enc):
        super().__init__(digits=True)
        self.enc = enc

    def piece(self, piece: str) -> bytes:
        out = []
        for w in WORD.findall(DIGITS.sub("0", piece)):
            ids = np.frombuffer(self.enc.encode_bytes(" " + w.lower()), np.int32).astype(np.uint64)
            ids[0] += np.uint64(self.FIRST)
            out.append(ids.tobytes())
        return b"".join(out)


_TOOLS: dict[str, tuple] = {}


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and the measures of every row.

    Null, empty and blank texts have 0 words and 0 measures. Rows repeated under a key are measured each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if folder not in _TOOLS:
            _TOOLS[folder] = WordHasher(digits=True), _Fertility(folder), encoder(folder=folder)
        hasher, fertility, enc = _TOOLS[folder]
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                if not t:
                    rows.append((0, 0.0, 0.0, 0.0, 0.0, "latin"))
                    continue
                words = hasher.hashes(t)
                ids = np.frombuffer(enc.encode_bytes(t), np.int32)
                pieces, fallback = fertility.counts(t)
                rows.append((len(words), repeat_share(words), len(t) / max(1, len(ids)), fallback / max(1, pieces), entropy(ids), script_of(t)))
            columns = [*zip(*rows)] or [[]] * 6
            kinds = [pa.int64(), *[pa.float64()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["key", *(m.split()[0] for m in MEASURES.split(", "))])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"key {kind}, {MEASURES}").withColumnRenamed("key", key)


def banded(measured: DataFrame, width: float = 3.0, least_words: int = 20) -> DataFrame:
    """The measures with ``rejected``: outside the bands of the document's script.

    A band reaches ``width`` interquartile ranges beyond the quartiles, which are taken over all
    documents of the script with at least ``least_words`` words. Shorter documents are never rejected
    here. Scripts are few, so the table of bands is broadcast (at most three rows).
    """
    names = ["chars_per_token", "byte_fallback_share", "token_entropy"]
    long_ = measured.where(F.col("words") >= least_words)
    bands = long_.groupBy("script").agg(*(F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), 10_000).alias(f"__{m}") for m in names))
    out = measured.join(F.broadcast(bands), "script", "left")
    beyond = F.lit(False)
    for m in names:
        low, high = F.get(f"__{m}", F.lit(0)), F.get(f"__{m}", F.lit(1))
        room = F.lit(width) * (high - low) + F.lit(0.05)
        beyond = beyond | (F.col(m) < low - room) | (F.col(m) > high + room)
    return out.withColumn("rejected", F.coalesce(beyond & (F.col("words") >= least_words), F.lit(False))).select(*measured.columns, "rejected")


_HASHERS: dict[str, tuple[TokenHasher, WordHasher]] = {}


def repetitive(docs: DataFrame, least_words: int = 50, share: float = 0.3, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """Keys of the documents of ``least_words`` or more words of which at least ``share`` stand in a repeat.

    The entropy of token runs selects the candidates without loss, the exact share confirms them. Null and empty texts give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if folder not in _HASHERS:
            _HASHERS[folder] = TokenHasher(encoder(folder=folder)), WordHasher(digits=True)
        tokens, words = _HASHERS[folder]
        for b in batches:
            keep = []
            for t in b.column(1).to_pylist():
                ids = tokens.hashes(t)
                n = int(np.count_nonzero(ids >= np.uint64(TokenHasher.FIRST)))
                keep.append(n >= least_words and in_band(run_deficit(ids), n, share) and repeat_share(words.hashes(t)) >= share)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_()))], ["key"])

    return docs.select(key, text).mapInArrow(run, f"key {dict(docs.dtypes)[key]}").withColumnRenamed("key", key)
