"""Words of a text as 64-bit hashes, with a bounded dictionary of pieces seen before.

A word is a longest run of letters and digits of any script, lower-cased. Blanks never lie inside a
word, so a text is cut at blanks and each piece's word hashes are kept for reuse.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
DIGITS = re.compile(r"[0-9]+")
CACHE_PIECES = 200_000


class WordHasher:
    """``keep`` says which lower-cased words count; ``digits`` turns each run of 0-9 into one 0 first."""

    def __init__(self, keep: Callable[[str], bool] | None = None, digits: bool = False):
        self.keep, self.digits = keep, digits
        self.known: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        if self.digits:
            piece = DIGITS.sub("0", piece)
        words = [w.lower() for w in WORD.findall(piece)]
        return b"".join(xxhash.xxh64_digest(w) for w in words if self.keep is None or self.keep(w))

    def hashes(self, text: str | None) -> np.ndarray:
        """The hashes of the text's words in order (empty for null)."""
        if not text:
            return np.empty(0, np.uint64)
        known, pieces = self.known, text.split(" ")
        try:
            return np.frombuffer(b"".join([known[p] for p in pieces]), np.uint64)
        except KeyError:
            pass
        if len(known) > CACHE_PIECES:
            known.clear()
        out = []
        for p in pieces:
            if (h := known.get(p)) is None:
                h = known[p] = self.piece(p)
            out.append(h)
        return np.frombuffer(b"".join(out), np.uint64)
