"""The share of repeated words against brute force, and the entropy band that may lose none of them."""

import random

import numpy as np

from corpusmill.llm import repetition
from corpusmill.llm.tokenizer import encoder
from corpusmill.llm.words import WordHasher


def brute(words, run=6):
    hit, seen = set(), set()
    for i in range(len(words) - run + 1):
        w = tuple(words[i : i + run])
        if w in seen:
            hit.update(range(i, i + run))
        seen.add(w)
    return len(hit) / len(words) if words else 0.0


def texts():
    rng = random.Random(11)
    base = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    for n in (0, 5, 6, 50, 51, 120, 400):
        for share in (0.0, 0.1, 0.29, 0.3, 0.31, 0.6, 1.0):
            words = [rng.choice(base) for _ in range(n)]
            part = words[: int(n * share / 2) + 6]
            at = rng.randrange(len(words) + 1)
            yield words[:at] + part + words[at:]
    yield ["same"] * 200
    yield ["слово", "и", "дело"] * 40


def test_share_and_band():
    tokens, plain = repetition.TokenHasher(encoder()), WordHasher(digits=True)
    for words in texts():
        text = " ".join(words)
        share = repetition.repeat_share(plain.hashes(text))
        assert abs(share - brute(words)) < 1e-12
        ids = tokens.hashes(text)
        assert np.count_nonzero(ids >= tokens.FIRST) == len(words)
        for least in (0.1, 0.3, 0.6):
            if share >= least and len(words) >= 6:
                assert repetition.in_band(repetition.run_deficit(ids), len(words), least)
    varied = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500))
    assert not repetition.in_band(repetition.run_deficit(tokens.hashes(varied)), 500, 0.3)


def test_found(spark):
    line = "one and the same line of nine plain words. "
    rows = [(1, line * 12), (2, None), (3, ""), (4, " \n "), (5, line.upper() + "7 " + line * 5), (6, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(99))), (7, line * 4), (8, "x " * 200_000), (1, line * 12)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, words int")
    assert sorted(r.doc_id for r in repetition.repetitive(docs).collect()) == [1, 1, 5, 8]
    assert repetition.repetitive(docs.limit(0)).count() == 0
    assert repetition.banded(repetition.measure(docs)).count() == len(rows)
