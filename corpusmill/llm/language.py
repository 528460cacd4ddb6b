"""Missing or wrong document language labels (problem 5).

A byte convolutional network: filters of several widths slide over the UTF-8 bytes of a fixed-length
window, each filter's greatest response is kept, and a softmax gives the language. It is trained in
numpy on labelled sentences and applied to batches of windows that cover every line wholly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.garbled import MAPPINGS

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 32
#: Rows of labelled text that training may take at most.
MOST_ROWS = 4_000
#: Class of text in no language.
NONE = "none"
# The words of the usual filler text.
FILLER = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam "
    "quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum "
    "eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()


class Network:
    """Weights: for each width a table (width, 256, FILTERS) and biases; the dense layer; the class names."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.tables = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.dense_bias = np.zeros(len(classes), np.float32)

    def _pooled(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Greatest response of each filter over the window, and its position if asked for."""
        out, at = [], []
        for table, bias in zip(self.tables, self.bias):
            w = len(table)
            n = WINDOW - w + 1
            r = table[0][x[:, :n]]
            for j in range(1, w):
                r += table[j][x[:, j : n + j]]
            if where:
                at.append(r.argmax(1))
            out.append(np.maximum(r.max(1) + bias, 0))
        return np.concatenate(out, 1), at

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self._pooled(x)[0] @ self.dense + self.dense_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int, rate: float = 0.01, batch: int = 64, seed: int = 7) -> None:
        """Adam on the cross-entropy; the gradient of max pooling reaches one position a filter."""
        rng = np.random.default_rng(seed)
        weights = [*self.tables, *self.bias, self.dense, self.dense_bias]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step = 0
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for start in range(0, len(x), batch):
                i = order[start : start + batch]
                pooled, at = self._pooled(x[i], True)
                z = pooled @ self.dense + self.dense_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(i)), y[i]] -= 1
                p /= len(i)
                back = (p @ self.dense.T) * (pooled > 0)
                gradients: list[np.ndarray] = []
                for k, w in enumerate(WIDTHS):
                    g = np.zeros_like(self.tables[k])
                    own = back[:, k * FILTERS : (k + 1) * FILTERS]
                    f = np.broadcast_to(np.arange(FILTERS), own.shape)
                    for j in range(w):
                        np.add.at(g[j], (x[i][np.arange(len(i))[:, None], at[k] + j], f), own)
                    gradients.append(g)
                gradients += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))]
                gradients += [pooled.T @ p, p.sum(0)]
                step += 1
                for w, g, m, v in zip(weights, gradients, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def windows(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all windows of the lines, and which line each is of; the last window of a long line overlaps the one before."""
    parts, owner = [], []
    for i, line in enumerate(lines):
        b = line.lower().encode("utf-8", "replace")
        n = len(b)
        if n <= WINDOW:
            parts.append(b.ljust(WINDOW, b"\0"))
            owner.append(i)
            continue
        for start in range(0, n - WINDOW + 1, WINDOW):
            parts.append(b[start : start + WINDOW])
            owner.append(i)
        if n % WINDOW:
            parts.append(b[n - WINDOW :])
            owner.append(i)
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WINDOW), np.array(owner, np.int64)


def _garble(text: str, rng: np.random.Generator) -> str:
    outer, inner = MAPPINGS[int(rng.integers(len(MAPPINGS)))]
    return text.encode(inner, "replace").decode(outer, "replace")


def training_set(labelled: list[tuple[str, str]], rounds: int = 10, seed: int = 7) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Class names, windows and classes: random cuts of the sentences, some garbled, and made filler."""
    rng = np.random.default_rng(seed)
    classes = [*sorted({c for c, _ in labelled}), NONE]
    texts, y = [], []
    for c, t in labelled:
        for k in range(rounds):
            start = int(rng.integers(0, max(1, len(t) - 40))) if k else 0
            cut = t[start : start + int(rng.integers(40, WINDOW))]
            if k % 5 == 4:  # a sentence about filler is no filler
                at = cut.find(" ", len(cut) // 2)
                cut = cut[:at] + " lorem ipsum" + cut[at:][:60]
            texts.append(_garble(cut, rng) if rng.random() < 0.2 else cut)
            y.append(classes.index(c))
    keys = "asdf qwer qwertz yxcv test xxx foo bar jkl uiop".split()
    for k in range(rounds * max(1, len(labelled) // max(1, len(classes) - 1))):
        words = rng.choice(FILLER if k % 5 else keys, int(rng.integers(6, 20)))
        texts.append(" ".join(words).capitalize() + ".")
        y.append(len(classes) - 1)
    cut = [t.lower().encode("utf-8", "replace")[:WINDOW].ljust(WINDOW, b"\0") for t in texts]
    return classes, np.frombuffer(b"".join(cut), np.uint8).reshape(-1, WINDOW), np.array(y)


def line_probabilities(model: Network, lines: list[str]) -> np.ndarray:
    """Class probabilities of each line: the windows' mean logarithms, made to sum to 1."""
    x, owner = windows(lines)
    if not len(x):
        return np.zeros((0, len(model.classes)))
    p = np.concatenate([model.probabilities(x[s : s + 512]) for s in range(0, len(x), 512)])
    score = np.zeros((len(lines), len(model.classes)))
    np.add.at(score, owner, np.log(p + 1e-6))
    score /= np.bincount(owner, minlength=len(lines))[:, None]
    out = np.exp(score - score.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def cut_label(label: str | None) -> str:
    return (label or "").split("-")[0].split("_")[0].lower()


def train(sample: DataFrame, lang: str = "lang", text: str = "text", rounds: int = 5, most_rows: int = MOST_ROWS, order: str = "sample_id", pages: DataFrame | None = None, most_pages: int = 500, most_windows: int = 12, key: str = "page_id") -> Network:
    """A network from labelled rows (at most ``most_rows``, the first by ``order``); null labels and texts are left out.

    With ``pages`` a second network is fitted, which has also seen the lines of at most ``most_pages``
    pages (the least by a hash of the key) whose label agrees with the first network: page furniture, at most
    ``most_windows`` windows of each. A bound of the hash, set from the number of pages, leaves about twice as many
    pages before they are ordered, so the driver and its tasks see no more.
    """
    rows = sample.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).orderBy(order).limit(most_rows).select(lang, text).collect()
    classes, x, y = training_set([(r[0], r[1]) for r in rows])
    net = Network(classes)
    if not rows:
        return net
    net.train(x, y, rounds)
    if pages is None:
        return net
    more_x, more_y = [], []
    long_ = pages.where(F.col("words") >= 40)
    bound = min(1 << 31, (2 * most_pages + 100) * (1 << 31) // max(1, long_.count()))
    h = F.pmod(F.xxhash64(key), F.lit(1 << 31))
    some = long_.where(h < bound).orderBy(h, key).limit(most_pages).select("lang", F.transform("blocks", lambda b: b.text)).collect()
    for label, blocks in some:
        lines = [t for b in blocks or () for t in (b or "").split("\n") if t.strip()]
        p = line_probabilities(net, lines)
        if not len(lines) or cut_label(label) not in classes:
            continue
        own = classes.index(cut_label(label))
        weight = np.array([len(t) for t in lines], np.float64)
        if (p * weight[:, None]).sum(0).argmax() != own:
            continue
        keep = [t for t, q in zip(lines, p) if q.argmax() == own or q.max() < 0.9]
        w, _ = windows(keep)
        more_x.append(w[:most_windows])
        more_y.append(np.full(len(more_x[-1]), own))
    if more_x:
        net = Network(classes)
        net.train(np.concatenate([x, *more_x]), np.concatenate([y, *more_y]), rounds)
    return net


def languages(pages: DataFrame, network: Network, key: str = "page_id", label: str = "lang", least_tokens: int = 12, least_share: float = 0.3) -> DataFrame:
    """``key, block_pos, line_pos, lang, confidence, main, label`` for each page and each long line.

    The page's row has positions -1 and the language with the greatest part of its bytes; it is null
    where less than ``least_share`` of them is in any language (filler), or where there is no line.
    Lines of ``least_tokens`` or more white-space tokens have a row each. ``main`` is the page's language,
    ``label`` its given one cut at the first ``-`` or ``_`` and lower-cased, empty for null.
    """
    net = pages.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value
        none = model.classes.index(NONE)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                b = batch.slice(start, 200)
                lines, places = [], []
                ids, labels = b.column(0).to_pylist(), b.column(1).to_pylist()
                for i, blocks in enumerate(b.column(2).to_pylist()):
                    for bp, t in enumerate(blocks or ()):
                        for lp, line in enumerate((t or "").split("\n")):
                            if line.strip():
                                lines.append(line)
                                places.append((i, bp, lp))
                line_p = line_probabilities(model, lines)
                page_p = np.zeros((b.num_rows, len(model.classes)))
                weight = np.array([len(t) for t in lines], np.float64)
                at = np.array([q[0] for q in places], np.int64)
                np.add.at(page_p, at, line_p * weight[:, None])
                total = page_p.sum(1)
                own = np.delete(page_p, none, 1)
                names = [c for c in model.classes if c != NONE]
                main: list[str | None] = [names[int(r.argmax())] if t > 0 and r.sum() >= least_share * t else None for r, t in zip(own, total)]
                sure = [float(r.max() / t) if t > 0 else 0.0 for r, t in zip(page_p, total)]
                cut = [cut_label(s) for s in labels]
                out = [(k, -1, -1, m, c, m, s) for k, m, c, s in zip(ids, main, sure, cut)]
                for (i, bp, lp), line, q in zip(places, lines, line_p):
                    if len(line.split()) >= least_tokens:
                        c = int(q.argmax())
                        out.append((ids[i], bp, lp, None if c == none else model.classes[c], float(q[c]), main[i], cut[i]))
                columns = [*zip(*out)] or [[]] * 7
                kinds = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "block_pos", "line_pos", "lang", "confidence", "main", "label"])

    kind = dict(pages.dtypes)[key]
    rows = pages.select(key, label, F.transform("blocks", lambda x: x.text).alias("blocks"))
    return rows.mapInArrow(run, f"key {kind}, block_pos int, line_pos int, lang string, confidence double, main string, label string").withColumnRenamed("key", key)


def mislabelled(pages: DataFrame, network: Network, least_words: int = 40, least_confidence: float = 0.9) -> DataFrame:
    """``page_id, block_pos, line_pos, lang``: pages whose label is not their language, and lines in another one."""
    rows = languages(pages.where(F.col("words") >= least_words), network)
    page = (F.col("block_pos") == -1) & F.col("lang").isNotNull() & (F.col("label") != F.col("lang"))
    line = (F.col("block_pos") >= 0) & F.col("main").isNotNull() & (F.col("lang") != F.col("main")) & (F.col("confidence") >= least_confidence)
    return rows.where(page | line).select("page_id", "block_pos", "line_pos", "lang")
