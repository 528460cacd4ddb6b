"""Garbled text from wrong character encoding (problem 4).

Adjacent character pairs are counted over the whole corpus; a pair's share in the mutual information
of neighbours says how usual it is. Text whose pairs contribute little is improbable: maximum-scoring
segments isolate those runs, and only inside them are inverse mappings tested. A mapping writes the
run back to bytes in the encoding it was wrongly read with and reads them in the right one. For UTF-8
the bytes themselves prove the mapping (and the decoded characters must be usual in the corpus); for
single-byte encodings the mapped pairs must be far more usual than those found.

Garble that its bytes prove is counted as what it reads, not as what it shows, so that a site garbled
throughout does not make its own pairs usual.

Counts live in tables of fixed size (hashed pairs), so what is broadcast does not grow with the data.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIRS, CHARS = 1 << 20, 1 << 16
LOST = "�"
#: Score that a segment must reach.
LEAST_SCORE = 2.0
BLANKS = " \t\n"
CUT = re.compile(r"[ \t]+")
#: Only pairs rarer than this speak for a single-byte mapping, and only with at least this gain.
RARE, STEP = 3e-5, 3.0
#: Encodings text may have been read with by mistake, and for each the encodings it may really have had.
UTF8_READ_AS = ("cp1252", "latin-1", "mac_roman", "cp1251", "cp1250", "cp437", "cp850", "cp866", "koi8_r", "mac_cyrillic", "iso8859_2", "iso8859_15", "cp1254", "cp1253")
SWAPS = (
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("latin-1", "mac_roman"), ("latin-1", "cp1251"), ("cp1252", "cp1251"), ("latin-1", "koi8_r"), ("cp1252", "koi8_r"),
    ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp437"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"), ("iso8859_5", "cp1251"), ("cp1251", "iso8859_5"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("latin-1", "iso8859_5"), ("latin-1", "cp866"), ("cp1252", "cp866"),
)
MAPPINGS = tuple((outer, "utf-8") for outer in UTF8_READ_AS) + SWAPS


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Lower-case code of each code, where that is one character, line ends as blanks; so pairs are counted.
FOLD = np.arange(CHARS, dtype=np.uint32)
FOLD[:0x530] = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(0x530))]


FOLD[9:14] = 32
LETTER = np.array([chr(c).isalpha() for c in range(CHARS)])
CODE = np.arange(CHARS)


def _folded(codes: np.ndarray) -> np.ndarray:
    """Codes without case; astral characters are one character here."""
    return FOLD[np.minimum(codes, CHARS - 1)]


def _pair_index(codes: np.ndarray) -> np.ndarray:
    """Bucket of each adjacent pair of folded codes; beside a sign above ASCII all letters are one."""
    letter = LETTER[codes]
    sign = ~letter & (codes > 127)
    a = np.where(letter[:-1] & sign[1:], np.uint32(97), codes[:-1])
    b = np.where(letter[1:] & sign[:-1], np.uint32(97), codes[1:])
    return ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77) >> np.uint32(3))).astype(np.int64) >> 5 & (PAIRS - 1)


def _byte_of(outer: str) -> dict[int, int]:
    """Character code -> byte of an encoding; undefined bytes stand for the control code of their number."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(outer)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(ord(c), b)
    return out


BYTES_OF = {outer: _byte_of(outer) for outer in {o for o, _ in MAPPINGS}}
#: For each encoding, its characters as the characters of their bytes, and what a UTF-8 sequence looks like at least.
AS_BYTES = {outer: {c: chr(b) for c, b in BYTES_OF[outer].items()} for outer in UTF8_READ_AS}
SEQUENCE = {
    outer: re.compile("[{}][{}]".format(*("".join(re.escape(chr(c)) for c, b in BYTES_OF[outer].items() if low <= b <= high) for low, high in ((0xC2, 0xF4), (0x80, 0xBF)))))
    for outer in UTF8_READ_AS
}
LATIN = frozenset(c for c in map(chr, range(0xC0, 0x180)) if c.isalpha())
MIXED = re.compile("[A-Za-zÀ-ž][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ž]")
CYRILLIC = frozenset(map(chr, range(0x400, 0x460)))
#: Characters above ASCII that a proved reading may have.
READABLE = LATIN | CYRILLIC | frozenset(map(chr, [*range(0xA0, 0xC0), 0xD7, 0xF7, *range(0x2010, 0x2045), 0x20AC, 0x2116, 0x2122]))


def _read_once(word: str) -> str | None:
    """The word as UTF-8 if all its characters above ASCII are the bytes of whole sequences, or lost ones."""
    spare = 3 * word.count(LOST) + word.count("?")
    for outer in UTF8_READ_AS:
        if SEQUENCE[outer].search(word):
            table = AS_BYTES[outer]
            new = "".join([c if c < "\x80" else table.get(ord(c), "\xff") for c in word]).encode("latin-1").decode("utf-8", "replace")
            high = [c for c in new if c >= "\x80" and c != LOST]
            if len(high) < (2 if outer.startswith("mac") else 1) or new.count(LOST) > spare or new == word:
                continue
            again = None if READABLE.issuperset(high) else _read_once(new)  # wrongly decoded twice
            if again or READABLE.issuperset(high) and not (CYRILLIC.intersection(high) and any(c in LATIN or c.isascii() and c.isalpha() for c in new)):
                return new
    return None


def reading(word: str) -> str:
    """What a word reads whose bytes prove that it was decoded wrongly, once or more than once; any other word itself."""
    for _ in range(4):
        if (new := _read_once(word)) is None:
            break
        word = new
    return word


class Reader:
    """Texts with their proved garble read; keeps what it has seen."""

    def __init__(self):
        self.known: dict[str, str] = {}

    def word(self, word: str) -> str:
        if (new := self.known.get(word)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            new = self.known[word] = reading(word)
        return new

    def text(self, text: str) -> str:
        """The text with line ends and tabs as blanks."""
        if text.isascii():
            return text
        return " ".join([w if w.isascii() else self.word(w) for w in text.replace("\n", " ").replace("\t", " ").split(" ")])


def _climbs(word: str) -> int:
    """Places where an upper-case letter follows a lower-case one."""
    return sum(a.islower() and b.isupper() for a, b in zip(word, word[1:]))


class Model:
    """Character and pair frequencies of a corpus."""

    def __init__(self, pairs: np.ndarray, chars: np.ndarray):
        n, m = max(1, pairs.sum()), max(1, chars.sum())
        self.log_pair = np.log((pairs + 0.3) / n).astype(np.float32)
        self.pair = (pairs / n).astype(np.float32)
        self.log_char = np.log((chars + 0.3) / m).astype(np.float32)
        least = np.full(CHARS, chars[128:].sum())  # what counts as usual is judged among letters of one script and among signs
        for kind in (LETTER & (CODE < 0x250), (CODE >= 0x400) & (CODE < 0x530), ~LETTER):
            least[kind] = chars[kind & (CODE > 127)].sum()
        self.usual = chars >= np.maximum(2.0, 2e-4 * least)
        #: In valid UTF-8, rare letters of Latin-1 and rare signs are as good.
        self.good = self.usual.copy()
        self.good[[FOLD[ord(c)] for c in READABLE if c < "\u0100" or c in "œŒŸ" or c > "\u2000"]] = True
        self.usual[:32] = False
        self.usual[0x80:0xA0] = False
        self.good[:32] = self.good[0x80:0xA0] = False
        self.bytes_of = BYTES_OF
        self.reader = Reader()
        self.words: dict[str, np.ndarray] = {}
        self.suspects: dict[str, bool] = {}

    def improbability(self, codes: np.ndarray, floor: float) -> np.ndarray:
        """For each pair, the logarithm of ``floor`` over its share in the mutual information, within +-4."""
        codes = _folded(codes)
        i = _pair_index(codes)
        lp = self.log_pair[i]
        pmi = lp - self.log_char[codes[:-1] & (CHARS - 1)] - self.log_char[codes[1:] & (CHARS - 1)]
        share = self.pair[i] * np.maximum(pmi, 0.01)
        s = np.log(floor / (share + 1e-9))
        plain = (codes[:-1] < 128) & (codes[1:] < 128)
        return np.where(plain, np.minimum(np.clip(s, -4, 4), -0.5), np.clip(s, -4, 4))

    def mapped(self, word: str, outer: str, inner: str) -> str | None:
        """The word read again; None where it has characters that the outer encoding lacks."""
        table = self.bytes_of[outer]
        raw = bytearray()
        for c in word:
            b = ord(c) if c < "\x80" else table.get(ord(c), -1)
            if b < 0:
                if inner != "utf-8":
                    return None
                b = 0xFF  # never valid: counts as lost
            raw.append(b)
        if inner == "utf-8":
            return bytes(raw).decode("utf-8", "replace")
        try:
            return bytes(raw).decode(inner)
        except UnicodeDecodeError:
            return None

    def likelihood(self, word: str) -> np.ndarray:
        """Log frequency of each pair of a word between blanks; a letter of the common class counts as one of twenty."""
        codes = _folded(_codes(f" {word} "))
        sign = ~LETTER[codes] & (codes > 127)
        one = (LETTER[codes[:-1]] & sign[1:]) | (LETTER[codes[1:]] & sign[:-1])
        return self.log_pair[_pair_index(codes)] - 3.0 * one

    def gains(self, word: str) -> np.ndarray:
        """What each mapping would gain on a word that holds characters above ASCII."""
        if (g := self.words.get(word)) is not None:
            return g
        g = np.zeros(len(MAPPINGS), np.float32)
        own = self.likelihood(word)
        rare = own < np.log(RARE)
        plain = not set(word).difference("…\xa0", map(chr, range(128)))  # a mere ellipsis or hard space proves no single-byte mapping
        for j, (outer, inner) in enumerate(MAPPINGS):
            new = self.mapped(word, outer, inner)
            if new is None:
                g[j] = -6
            elif inner == "utf-8":
                high = [c for c in new if c >= "\x80"]
                good = sum(c != LOST and bool(self.good[FOLD[min(ord(c), CHARS - 1)]]) for c in high)
                if len(high) - good and (again := self.mapped(new, outer, inner)) and LOST not in again:  # wrongly decoded twice
                    high, good = [good], max(good, sum(c >= "\x80" and bool(self.good[FOLD[min(ord(c), CHARS - 1)]]) for c in again))
                g[j] = 5 * good - 1.25 * max(0, len(high) - good)
            elif new == word or plain:
                g[j] = 0
            elif MIXED.search(new) and not MIXED.search(word):
                g[j] = -6
            else:
                c = _folded(_codes(new))
                usual = self.usual[c] | (c < 128)
                change = self.likelihood(new) - own
                g[j] = np.where(rare & (change > STEP), change, np.minimum(change, 0)).sum() - 4 * (_climbs(new) - _climbs(word)) if usual.all() else -6
        if len(self.words) > 100_000:
            self.words.clear()
        self.words[word] = g
        return g

    def segments(self, text: str, floor: float) -> list[tuple[int, int]]:
        """Maximum-scoring segments of improbable pairs: from where the sum of scores leaves 0 to its highest point."""
        total = np.cumsum(self.improbability(_codes(text), floor))
        climb = total - np.minimum.accumulate(np.r_[0, total])[:-1]  # above 0 within an excursion
        inside = climb > 0
        if not inside.any():
            return []
        edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
        out = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            top = a + int(np.argmax(climb[a:b]))
            if climb[top] >= LEAST_SCORE:
                out.append((a, top + 1))
        return out

    def suspect(self, word: str, floor: float) -> bool:
        """Whether a word has an improbable segment that some mapping would improve."""
        if (known := self.suspects.get(word)) is None:
            if len(self.suspects) > 200_000:
                self.suspects.clear()
            known = bool(self.segments(f" {word} ", floor)) and any(self.gains(w).max() > 0 for w in CUT.split(word))
            self.suspects[word] = known
        return known

    def best(self, line: str, floor: float, least: float) -> tuple[int, list[tuple[int, int]]] | None:
        """The mapping that fits the line's improbable runs, and those runs; None if there is none."""
        runs = []
        for a, b in self.segments(f" {line} ", floor):
            start, end = max(0, a - 1), min(len(line), b)
            while start > 0 and line[start - 1] not in BLANKS:
                start -= 1
            while end < len(line) and line[end] not in BLANKS:
                end += 1
            if runs and start <= runs[-1][1]:
                runs[-1] = runs[-1][0], max(end, runs[-1][1])
            else:
                runs.append((start, end))
        words = []
        for a, b in runs:
            words += [w for w in CUT.split(line[a:b]) if not w.isascii()]
        if not words:
            return None
        gains = np.sum([self.gains(w) for w in words], axis=0)
        proved, swapped = gains[: len(UTF8_READ_AS)], gains[len(UTF8_READ_AS) :]
        if proved.max() >= 3.75:
            return int(np.argmax(proved)), runs
        return (len(UTF8_READ_AS) + int(np.argmax(swapped)), runs) if swapped.max() >= least else None

    def repair(self, text: str, floor: float, least: float) -> tuple[bool, str, bool]:
        """Whether the text is garbled, the text with what could be restored, and whether nothing was lost."""
        if text.isascii():
            return False, text, True
        garbled, lines = False, text.split("\n")
        for k, line in enumerate(lines):
            if line.isascii() or not any([self.suspect(w, floor) for w in line.split(" ") if not w.isascii()]):
                continue
            done: set[str] = set()  # words restored in this line
            for _ in range(4):
                if (hit := self.best(line, floor, least)) is None:
                    break
                garbled = True
                outer, inner = MAPPINGS[hit[0]]
                out, at = [], 0
                for a, b in hit[1]:
                    words = _parts(line[a:b])
                    for i, w in enumerate(words):
                        if not w.isascii() and not (inner == "utf-8" and self.gains(w)[hit[0]] <= 0 and (w in done or not self.segments(f" {w} ", floor))):
                            proved = w if inner == "utf-8" else self.reader.word(w)
                            words[i] = proved if proved != w else self.mapped(w, outer, inner) or w
                            done.add(words[i])
                    out += [line[at:a], "".join(words)]
                    at = b
                new = "".join([*out, line[at:]])
                if new == line:
                    break
                line = new
            lines[k] = line
        fixed = "\n".join(lines)
        garbled = garbled or LOST in text
        if garbled:  # no proved garble is left, be its pairs improbable or not
            fixed = "".join([w if w.isascii() else self.reader.word(w) for w in _parts(fixed)])
        return garbled, fixed, LOST not in fixed


_MODELS: dict[str, Model] = {}


def shared_model(name: str, counts) -> Model:
    """The model of broadcast counts, one a Python worker, so that the tasks it runs one after the other share what it has seen."""
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = Model(*(x.astype(np.float64) for x in counts.value))
    return _MODELS[name]


def _parts(run: str) -> list[str]:
    """Words and white space, to be joined again."""
    out, word = [], ""
    for c in run:
        if c in BLANKS:
            out += [word, c]
            word = ""
        else:
            word += c
    return [*out, word]


def corpus_counts(rows: DataFrame, fields: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed character pairs and of characters over all fields of all rows, proved garble as what it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, chars = np.zeros(PAIRS, np.int64), np.zeros(CHARS, np.int64)
        reader = Reader()
        for b in batches:
            for column in b.columns:
                values = column.to_pylist()
                for start in range(0, len(values), 500):
                    codes = _codes(reader.text("\n".join(v for v in values[start : start + 500] if v)))
                    if len(codes) > 1:
                        codes = _folded(codes)
                        pairs += np.bincount(_pair_index(codes), minlength=PAIRS)
                        chars += np.bincount(codes & (CHARS - 1), minlength=CHARS)
        i, j = np.flatnonzero(pairs), np.flatnonzero(chars)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[i, -1 - j].astype(np.int32)), pa.array(np.r_[pairs[i], chars[j]])], ["i", "n"])

    got = rows.select(*fields).mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    i, n = got["i"].to_numpy(), got["n"].to_numpy()
    pairs, chars = np.zeros(PAIRS, np.float64), np.zeros(CHARS, np.float64)
    pairs[i[i >= 0]] = n[i >= 0]
    chars[-1 - i[i < 0]] = n[i < 0]
    return pairs, chars


def repaired(rows: DataFrame, key: str = "page_id", fields: tuple[str, ...] = ("text", "title", "description"), floor: float = 1e-3, least: float = 6.5) -> DataFrame:
    """``key, field, restored, complete`` of every field that holds garbled text.

    ``restored`` is the field with every stretch mapped back that can be; ``complete`` says that nothing
    was lost; no proved garble is left then. A replacement character alone is garbled text too. Null and empty fields are none. ``floor``
    is the share in the mutual information below which a pair is improbable, ``least`` the log-likelihood
    a single-byte mapping must gain on a line. Keys must be unique; an empty table gives an empty one.
    """
    spark = rows.sparkSession
    counts = spark.sparkContext.broadcast(tuple(x.astype(np.float32) for x in corpus_counts(rows, list(fields))))
    names, model_name = list(fields), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_model(model_name, counts)
        for b in batches:
            keys, field, restored, complete = [], [], [], []
            ids = b.column(0).to_pylist()
            for name, column in zip(names, b.columns[1:]):
                for k, v in zip(ids, column.to_pylist()):
                    if v:
                        bad, text, whole = model.repair(v, floor, least)
                        if bad:
                            keys.append(k)
                            field.append(name)
                            restored.append(text)
                            complete.append(whole)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(field, pa.string()), pa.array(restored, pa.string()), pa.array(complete, pa.bool_())], ["key", "field", "restored", "complete"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, *names).mapInArrow(run, f"key {kind}, field string, restored string, complete boolean").withColumnRenamed("key", key)
