"""Encoding with a public byte-level BPE vocabulary (problem 8).

Texts are mapped to their UTF-8 bytes, the bytes to Latin-1 characters, and an Aho-Corasick
automaton over all vocabulary entries gives the longest entry at each position. A backtracking walk
takes the longest entry that is *compatible* with the one before it: two neighbours are compatible
when the merges, played back from both sides of their border, would never have joined across it.
That answer is memoised, so the walk gives exactly the result of applying the merges by rank, in
time linear in the text.

The pre-tokenisation pattern never crosses a single blank that follows a non-blank character, so a
text is cut there first and each piece's ids are kept in a bounded dictionary: most of a corpus is
pieces seen before.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary files lie; a parameter of every operator that uses them.
TOKENIZERS = os.environ.get("CORPUSMILL_TOKENIZERS", "/opt/tokenizers")
#: Pieces kept for reuse in each Python worker; beyond it the dictionary starts anew.
CACHE_PIECES = 200_000

# Fixed value: the vocabulary's published split pattern.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabulary files write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Exact encoder of one vocabulary file in the ``tokenizers`` JSON format."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        spell = lambda s: "".join(chr(letters[c]) for c in s)
        special = {t for t in model["vocab"] if not all(c in letters for c in t)}
        ids = {spell(t): i for t, i in model["vocab"].items() if t not in special}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        rank: dict[int, int] = {}
        for n, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b = spell(a), spell(b)
            whole = ids[a + b]
            self.merged[ids[a], ids[b]] = whole
            self.halves[whole] = ids[a], ids[b]
            rank[whole] = n
        ids = {t: i for t, i in ids.items() if len(t) == 1 or i in rank}
        self.order = {i: rank.get(i, -1) for i in ids.values()}
        self.length = {i: len(t) for t, i in ids.items()}
        self.shorter: dict[int, int | None] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            self.automaton.add_word(t, i)
            self.shorter[i] = next((ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ids), None)
        self.automaton.make_automaton()
        self.known: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave a border between these neighbours."""
        if (answer := self.known.get((left, right))) is None:
            if len(self.known) > 4 * CACHE_PIECES:
                self.known.clear()
            answer = self.known[left, right] = self._border(left, right)
        return answer

    def _border(self, left: int, right: int) -> bool:
        order, merged, halves = self.order, self.merged, self.halves
        ceiling = len(order) + 1  # merges of this rank or above come too late to join across the border
        while True:
            joined = merged.get((left, right))
            if joined is not None and order[joined] < ceiling:
                return False
            # Undo the latest merge that touches the border; of equal ranks the left one came first.
            a, b = order[left], order[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                ceiling, left = a, halves[left][1]
            else:
                ceiling, right = b + 1, halves[right][0]

    def encode_pretoken(self, word: str) -> list[int]:
        """Ids of one piece of the split pattern."""
        text = word.encode("utf-8", "surrogatepass").decode("latin-1")
        n = len(text)
        longest: list[int] = [-1] * n
        length, shorter = self.length, self.shorter
        for end, token in self.automaton.iter(text):
            start = end + 1 - length[token]
            if longest[start] < 0 or length[token] > length[longest[start]]:
                longest[start] = token
        if length[longest[0]] == n:
            return [longest[0]]
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token is not None and (dead[at + length[token]] or (out and not self.compatible(out[-1], token))):
                token = shorter[token]
            if token is None:  # nothing fits here: take the last one back and try a shorter one
                dead[at] = 1
                last = out.pop()
                at -= length[last]
                token = shorter[last]
                continue
            out.append(token)
            at += length[token]
            token = longest[at] if at < n else None
        return out

    def piece(self, piece: str) -> bytes:
        return b"".join(np.array(self.encode_pretoken(w), np.int32).tobytes() for w in PATTERN.findall(piece))

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as consecutive 32-bit numbers."""
        known = self.pieces
        pieces = text.split(" ")
        pieces[1:] = [" " + p for p in pieces[1:]]
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            pass
        for i, p in enumerate(pieces):
            if p not in known:
                bare = p[1:] if i else p
                if not bare or bare != bare.strip():  # longer white space: cut by the pattern itself
                    return self.encode_words(text)
                if len(known) > CACHE_PIECES:
                    known.clear()
                    return self.encode_bytes(text) if len(pieces) <= CACHE_PIECES else self.encode_words(text)
                known[p] = self.piece(p)
        return b"".join([known[p] for p in pieces])

    def encode_words(self, text: str) -> bytes:
        words, out = self.words, []
        for w in PATTERN.findall(text):
            if (ids := words.get(w)) is None:
                if len(words) > CACHE_PIECES:
                    words.clear()
                ids = words[w] = np.array(self.encode_pretoken(w), np.int32).tobytes()
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist() if text else []


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Encoder:
    """The encoder of a vocabulary file, built once in each Python process."""
    file = os.path.join(folder, f"{name}.json")
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


def encode_column(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(key, ids ARRAY<INT>)`` of every row; no special tokens.

    A null and an empty text give the empty list. Strings that spell a special token are ordinary
    text. Repeated rows and null keys are kept as they are; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for b in batches:
            parts = [enc.encode_bytes(t) if t else b"" for t in b.column(1).to_pylist()]
            ends = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], ["key", "ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_column(docs: DataFrame, keep: list[str], text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` and ``tokens BIGINT``, the number of ids of the row's text (null and empty: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for b in batches:
            n = [len(enc.encode_bytes(t)) // 4 if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], [*keep, "tokens"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, text).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", tokens bigint")
