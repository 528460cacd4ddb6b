"""Column functions that judge how well a passage can be quoted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import sentences, strip, word_count

# Openers of questions (a prefix test without a boundary), of definitions, of passages that carry
# the one before over; figures, bylines and dates. English and French.
QUESTIONS = "what|why|how|when|where|who|which|can|should|does|do|is|are|will|comment|pourquoi|quand|où|qui|quoi|quel|quelle|quels|quelles|combien|est-ce|faut-il|peut-on|doit-on|qu'est"
DEFINITIONS = "is a|is an|is the|are the|refers to|means|consists of|stands for|allows you to|est un|est une|est le|est la|sont des|consiste à|désigne|signifie|permet de"
CARRYING = "above|below|as seen|as shown|therefore|thus|however|moreover|furthermore|this|these|those|it|they|that's why|ci-dessus|ci-dessous|comme vu|en effet|donc|ainsi|par ailleurs|de plus|celui-ci|cela"
UNITS = "%|€|\\$|£|km|kg|lb|h|min|years?|months?|days?|m²|°[CF]"
BYLINES = "by|written by|author|par|rédigé par|écrit par"
MONTHS = (
    "january|february|march|april|may|june|july|august|september|october|november|december|"
    "janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre"
)

#: Parts of the score of a passage, each with what is said where it is missing.
NO_HEADING, NO_QUESTION = "passage has no section heading", "the section heading is not phrased as a question"
NO_ANSWER = "no direct answer in the first sentence"
CARRIES = "opens by carrying over the previous paragraph (not self-contained)"
NO_FIGURES = "no figures worth quoting"
UNCOMFORTABLE = "length outside the comfortable window (60–220 words)"


def is_question(heading: Column) -> Column:
    return heading.rlike(rf"(?iu)^(?U:\s*)({QUESTIONS})")


def defines(text: Column) -> Column:
    return text.rlike(rf"(?iuU)\b({DEFINITIONS})\b")


def carries_over(sentence: Column) -> Column:
    return sentence.rlike(rf"(?iuU)^\s*({CARRYING})\b")


def figures(text: Column) -> Column:
    """How many numbers stand in the text, each with its decimals and unit."""
    return F.regexp_count(text, F.lit(rf"(?U)\b\d+([.,]\d+)?\s?({UNITS})?\b"))


def has_byline(text: Column) -> Column:
    return F.substring(text, 1, 1500).rlike(rf"(?iuU)\b({BYLINES})\s+[A-ZÉÈÀÂÎÔÛ][\w'’-]+")


def has_date(text: Column) -> Column:
    return F.substring(text, 1, 2000).rlike(rf"(?iuU)\b(\d{{1,2}}\s+({MONTHS})\s+\d{{4}}|\d{{2}}/\d{{2}}/\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}})\b")


def score(heading: Column, text: Column) -> Column:
    """``struct<score, words, gaps>`` of a passage: up to 2 for its length, 1 each for a question as heading, an answer at
    the start, an opening that stands alone, and two figures or more. Null heading counts as empty, null text as empty."""
    heading, text = F.coalesce(heading, F.lit("")), strip(F.coalesce(text, F.lit("")))
    n = word_count(text)
    parts = sentences(text)
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    good, fair = n.between(60, 220), n.between(40, 320)
    asks = (heading != "") & is_question(heading)
    answers = defines(F.array_join(F.slice(parts, 1, 2), " ")) | ((first != "") & (word_count(first) <= 35))
    carries = carries_over(first)
    quotable = figures(text) >= 2
    length_gap = F.when(good, F.lit(None)).when(fair, F.lit(UNCOMFORTABLE)).otherwise(F.concat(n.cast("string"), F.when(n < 40, F.lit(" words: too short to stand alone")).otherwise(F.lit(" words: too long to be lifted as-is"))))
    gaps = F.array_compact(F.array(
        length_gap, F.when(heading == "", F.lit(NO_HEADING)).when(~asks, F.lit(NO_QUESTION)), F.when(~answers, F.lit(NO_ANSWER)),
        F.when(carries, F.lit(CARRIES)), F.when(~quotable, F.lit(NO_FIGURES)),
    ))
    points = F.when(good, 2).when(fair, 1).otherwise(0) + asks.cast("int") + answers.cast("int") + (~carries).cast("int") + quotable.cast("int")
    return F.struct(points.cast("int").alias("score"), n.cast("int").alias("words"), gaps.alias("gaps"))


def grade(mean: Column, passages: Column) -> Column:
    """Band of a page's mean score: good from 4, improvable from 3, hard below; null without a passage."""
    return F.when(passages > 0, F.when(mean >= 4, "good").when(mean >= 3, "improvable").otherwise("hard"))
