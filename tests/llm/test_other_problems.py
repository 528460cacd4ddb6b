"""Problems 1, 2, 5, 8 and 9 against plain versions and on odd inputs."""

import random
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import distinctive, language, mixing, repeated_lines, set_join, tokenizer

BLOCKS = "page_id bigint, site string, text string, blocks array<struct<heading:string,level:int,text:string>>"


def test_clean_texts(spark):
    rows = []
    for i in range(12):
        lines = [f"Own line {'abcdefghijkl'[i]} of the page", "Notice 2024!", "", "more own " + "x" * (i + 1)]
        rows.append((i, "s", "\n".join([*lines, "tail " + "y" * (i + 1)]), [("h", 2, "\n".join(lines)), ("", 0, "tail " + "y" * (i + 1))]))
    rows += [(50, "s", None, []), (51, "s", "", []), (52, None, "Notice 2024!", [("", 0, "Notice 2024!")])]
    t = spark.createDataFrame(rows, BLOCKS)
    clean = {r.page_id: r for r in repeated_lines.without_lines(t, repeated_lines.repeated_lines(t)).collect()}
    assert clean[0].text == "Own line a of the page\n\nmore own x\ntail y" and [b.text for b in clean[0].blocks] == ["Own line a of the page\n\nmore own x", "tail y"]
    assert clean[50].text is None and clean[51].text == "" and clean[52].text == "Notice 2024!"
    assert repeated_lines.repeated_lines(t.limit(0)).count() == 0


def test_distinctive(spark):
    rng = random.Random(2)
    words = [f"{a}{b}rareword" for a in "abcde" for b in "fghij"]
    texts = {i: " ".join(rng.choice(words[: 6 + i]) for _ in range(40)) for i in range(15)}
    rows = [(i, None if i == 3 else "Title " + words[i], t) for i, t in texts.items()] + [(90, "", ""), (91, None, None)]
    t = spark.createDataFrame(rows, "page_id bigint, title string, text string")
    bags = {i: Counter(f"{title or ''} {text or ''}".lower().split()) for i, title, text in rows}
    df = Counter(w for b in bags.values() for w in b)
    want = {(i, w) for i, b in bags.items() for w, n in b.items() if n >= 4 and 2 <= df[w] <= 6 and len(w) >= 7}
    assert {tuple(r) for r in distinctive.distinctive(t).collect()} == want
    assert distinctive.tf_idf(t.limit(0)).count() == 0


SENTENCES = {"en": "The old mill stands near the river and people walk there in the evening", "de": "Die alte Mühle steht am Fluss und die Leute gehen dort am Abend spazieren", "ru": "Старая мельница стоит у реки и люди гуляют там по вечерам каждый день"}


@pytest.fixture(scope="module")
def network(spark):
    rows = [(i, lang, " ".join(random.Random(i).sample(s.split(), 9))) for i, (lang, s) in enumerate([*SENTENCES.items()] * 40)]
    return language.train(spark.createDataFrame([*rows, (999, None, "x"), (1000, "en", None)], "sample_id int, lang string, text string"), rounds=8)


def test_held_out_sentences(network):
    held = [(lang, " ".join(random.Random(1000 + i).sample(s.split(), 11))) for i, (lang, s) in enumerate([*SENTENCES.items()] * 20)]
    p = language.line_probabilities(network, [t for _, t in held])
    assert np.mean([network.classes[q.argmax()] == lang for (lang, _), q in zip(held, p)]) >= 0.9


def test_language_of_pages(spark, network):
    s = SENTENCES
    rows = [(1, "de-DE", 60, [("", 0, "\n".join([s["en"]] * 4))]), (2, "EN_gb", 60, [("", 0, "\n".join([s["en"]] * 4 + [s["ru"]]))]), (3, None, 60, [("", 0, "\n".join([s["ru"]] * 3))]), (4, "en", 60, None), (5, "en", 60, [(None, None, None)]), (6, "xx", 10, [("", 0, s["de"])]), (7, "en", 60, [("", 0, " ".join([s["en"]] * 3000))])]
    t = spark.createDataFrame(rows, "page_id bigint, lang string, words bigint, blocks array<struct<heading:string,level:int,text:string>>")
    assert {tuple(r) for r in language.mislabelled(t, network).collect()} == {(1, -1, -1, "en"), (2, 0, 4, "ru"), (3, -1, -1, "ru")}
    assert language.mislabelled(t.limit(0), network).count() == 0


def test_ids_round_trip(spark):
    tokenizers = pytest.importorskip("tokenizers")
    plain = tokenizers.Tokenizer.from_file(f"{tokenizer.TOKENIZERS}/byte_bpe_50k.json")
    plain.encode_special_tokens = True
    rng = random.Random(4)
    letters = "abc déß Жя 日本 \n\t'12 <|endoftext|> 😀 ́"
    texts = ["", " ", "don't stop", "a" * 5000, " " * 3000, *("".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(60))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (500, None)]
    got = [(r.doc_id, list(r.ids)) for r in tokenizer.encode_column(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got) == sorted([(i, plain.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)] + [(500, []), (500, [])])
    assert all(plain.decode(ids, skip_special_tokens=False) == texts[i] for i, ids in got if i < 500)


def test_mix(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice("aaaabbc"), rng.randrange(1, 60)) for i in range(3000)] + [(9000, None, 5), (9001, "unlisted", 9), (9002, "a", 0)]
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.2, 4), ("empty", 0.1, 2), (None, 0.0, 1)], "source string, weight double, max_repeats int")
    mixed, report = mixing.mix(spark.createDataFrame(docs, "doc_id bigint, source string, tokens int"), targets)
    most = {"a": 1, "b": 3, "c": 4}
    rows = mixed.collect()
    assert rows and all(1 <= r.copies <= most[r.source] for r in rows)
    got = {r.source: r for r in report.collect()}
    total = sum(r.tokens * r.copies for r in rows)
    for s, w in (("a", 0.3), ("b", 0.4), ("c", 0.2)):
        assert abs(got[s].share - w / 0.9) < 0.01 and got[s].mix_tokens == sum(r.tokens * r.copies for r in rows if r.source == s)
    assert got["empty"].share == 0 and abs(sum(r.mix_tokens for r in got.values()) - total) == 0
    mixed, report = mixing.mix(spark.createDataFrame([], "doc_id bigint, source string, tokens int"), targets)
    assert mixed.count() == 0 and report.count() == 4


def test_blocks_of_a_hot_combination(spark, monkeypatch):
    monkeypatch.setattr(set_join, "BLOCK", 40)
    rng = random.Random(8)
    sets = {i: frozenset(rng.sample([f"t{k}" for k in range(9)], rng.randrange(6, 9))) | ({f"own{i}"} if i % 3 else set()) for i in range(150)}
    rows = spark.createDataFrame([(i, sorted(v)) for i, v in sets.items()], "page_id bigint, v array<string>")
    pairs, member = set_join.similar_sets(set_join.token_sets(rows, "page_id", "v", "values", 6), set_join.Fraction(3, 5))
    ids = sorted(sets)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) * 5 >= 3 * max(len(sets[a]), len(sets[b]))}
    assert {tuple(r) for r in set_join.expand(pairs, member).collect()} == want
    odd = spark.createDataFrame([(1, None), (None, ["a"] * 9), (2, []), (3, [None, "", "a", "b", "c", "d", "e", "f"])], "page_id bigint, v array<string>")
    assert set_join.token_sets(odd, "page_id", "v", "values", 6).count() == 1
    pairs, member = set_join.similar_sets(set_join.token_sets(odd.limit(0), "page_id", "v", "values", 6), set_join.Fraction(3, 5))
    assert pairs.count() == 0 and member.count() == 0
