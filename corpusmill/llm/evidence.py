"""What shows in a line that a text was never finished: placeholders, unrendered values, filler, texts to be replaced."""

from __future__ import annotations

import re

from corpusmill.llm.language import FILLER

# The notations of template languages and of values that were not rendered.
PLACEHOLDER = re.compile(
    r"\{\{[^{}]{1,60}\}\}|\{%[^%]{1,60}%\}|<%=?[^%]{1,60}%>|\$\{[^{}]{1,60}\}|\{\$\w{1,40}\}|\{\d{1,2}\}|\{[a-z]+(?:_[a-z]+)*\}|%[A-Z][A-Z_]{2,30}%|\[\[\w{2,40}\]\]"
    r"|\b__[A-Z][A-Z_]{1,30}__|@@[A-Z][A-Z_]{1,30}@@|#[A-Z][A-Z_]{2,30}#|<[A-Z]{3,20}>"
)
UNRENDERED = re.compile(r"\[object Object\]|\bundefined\b\W+\bundefined\b|:\s*undefined\s*$|\bNaN\b|\(null\b|:\s*null\s*$")
# Texts that ask to be replaced, in the languages at hand.
REPLACE_ME = re.compile(
    r"\bTODO\b:|\bXXX\b|\[insert [^\]]{2,60}\]|your text here|click to edit|^\W*sample text\W*$|this is a sample|replace (it|this) with|^\W*heading \d\W*$|placeholder text|"
    r"texto de ejemplo|sustituir antes de|texte de remplissage|à remplacer avant|texte d’exemple|blindtext|platzhaltertext|beispieltext|testo di (esempio|prova|riempimento)|"
    r"testo segnaposto|voorbeeldtekst|opvultekst|plaatshoudertekst|texto de exemplo|substituir antes de|texto de preenchimento|образец текста|текст для замены|текст-заполнитель|(asdf\W+){2}",
    re.I,
)
FILLER_WORDS = frozenset(w for w in FILLER if len(w) > 2)

_PARTS = re.compile(r"(?<=[.!?…])\s+(?![a-z])")
_WORDS = re.compile(r"[^\W_]+")
_SIGNS = frozenset("{%<#@[_$")


def marked(part: str, words: int) -> bool:
    """Placeholders, unless a single one inside a sentence of nine words or more is what the sentence is about."""
    found = [*PLACEHOLDER.finditer(part)]
    if not found:
        return False
    first, last = found[0], found[-1]
    at_edge = not any(c.isalnum() for c in part[: first.start()]) or not any(c.isalnum() for c in part[last.end() :])
    return len(found) > 1 or words < 9 or at_edge


def filled(part: str, words: int) -> bool:
    """At least four filler words that are half of the words."""
    n = sum(w in FILLER_WORDS for w in _WORDS.findall(part.lower()))
    return n >= 4 and 2 * n >= words


def unfinished(line: str, tokens: int, most_words: int = 14) -> bool:
    """Whether a part of the line shows that it was never finished. A text to be replaced is one of at most ``most_words``
    words; a longer sentence writes about it. Cheap looks come first, so a line without any sign costs next to nothing."""
    signs = not _SIGNS.isdisjoint(line)
    filler = not FILLER_WORDS.isdisjoint(line.lower().split())
    values = "undefined" in line or "NaN" in line or "null" in line or "[object" in line
    for part in _PARTS.split(line) if tokens > 12 else (line,):
        words = len(part.split())
        if (signs and marked(part, words)) or (values and UNRENDERED.search(part)) or (words <= most_words and REPLACE_ME.search(part)) or (filler and filled(part, words)):
            return True
    return False
