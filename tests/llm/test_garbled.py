"""A site garbled throughout is found and restored, whatever its share of the table."""

import pytest

from corpusmill.llm import garbled

FRENCH = (
    "Découvrez l’été à la forêt, où nos élèves préparent déjà la rentrée.",
    "Le café près du marché a été rénové grâce à l’équipe créée l’année dernière.",
    "À côté de la bâche, le vélo réparé est prêt à être protégé jusqu’à février.",
    "Les pièces signées sont vérifiées, la lumière reste agréable après la clôture.",
)
OTHER = ("Plain English words fill the other pages of this small table.", "Der schöne Garten blüht für alle Gäste, größer als früher.", "«МИР» и СССР» стоят рядом, вся группа «С» тоже здесь.")


def _garble(text, outer="cp1252"):
    return "".join(bytes([b]).decode(outer, "ignore") or chr(b) for b in text.encode())


def _pages(spark, hot, others):
    rows = [(i, _garble(" ".join(FRENCH[(i + j) % 4] for j in range(3))), _garble(FRENCH[i % 4]), None) for i in range(hot)]
    rows += [(1000 + i, OTHER[i % 3] + "\n" + FRENCH[i % 4], OTHER[i % 3], "") for i in range(others)]
    return spark.createDataFrame(rows, "page_id bigint, text string, title string, description string")


@pytest.mark.parametrize("hot, others", [(20, 380), (100, 200), (60, 0)])
def test_site_garbled_throughout(spark, hot, others):
    got = {(r.page_id, r.field): (r.restored, r.complete) for r in garbled.repaired(_pages(spark, hot, others)).collect()}
    want = {(i, "title"): (FRENCH[i % 4], True) for i in range(hot)}
    want |= {(i, "text"): (" ".join(FRENCH[(i + j) % 4] for j in range(3)), True) for i in range(hot)}
    assert got == want


def test_reading_needs_proof():
    for text in (*FRENCH, *OTHER):
        assert [garbled.reading(w) for w in text.split()] == text.split()
    for word in ("déjà", "l’été", "привет", "größer"):
        for outer in ("cp1252", "cp1251", "mac_roman", "cp437"):
            assert garbled.reading(_garble(word, outer)) == word
        assert garbled.reading(_garble(_garble(word))) == word


def test_lost_characters_are_not_complete(spark):
    rows = _pages(spark, 40, 80).collect()
    rows[0] = (0, _garble(FRENCH[0]).replace("©", "�", 1), _garble(FRENCH[0]), None)
    got = garbled.repaired(spark.createDataFrame(rows, "page_id bigint, text string, title string, description string"))
    flags = {r.field: r.complete for r in got.where("page_id = 0").collect()}
    assert flags == {"text": False, "title": True}


@pytest.mark.parametrize("word", ["œuvre", "naïf", "così", "Ægir", "verões", "oui—non"])
def test_rare_letters_beside_much_cyrillic(spark, word):
    rows = [(i, "Очень много русского текста стоит на всех этих страницах. " * 40, None, None) for i in range(200)]
    rows += [(1000, _garble(word), None, None), (1001, "Plain words here.", None, None)]
    got = garbled.repaired(spark.createDataFrame(rows, "page_id bigint, text string, title string, description string")).collect()
    assert [tuple(r) for r in got] == [(1000, "text", word, True)]
