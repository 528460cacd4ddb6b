"""Structured data and robots rules: the two places that need Python, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

OBJECTS = ArrayType(StructType([StructField("types", ArrayType(StringType())), StructField("same_as", ArrayType(StringType())), StructField("author", BooleanType())]))


def typed_objects(raw: str | None) -> list[dict]:
    """The objects with a ``@type`` in one JSON-LD text: at the top, in lists and under ``@graph``, to any depth.
    Broken JSON and null give none. Values of other keys are not entered."""
    try:
        waiting = [json.loads(raw)]
    except (ValueError, TypeError, RecursionError):
        return []
    found = []
    while waiting:
        node = waiting.pop()
        if isinstance(node, list):
            waiting.extend(node)
        elif isinstance(node, dict):
            if "@graph" in node:
                inner = node["@graph"]
                waiting.extend(inner if isinstance(inner, list) else [inner])
            if "@type" in node:
                found.append(node)
    return found


@F.pandas_udf(OBJECTS)
def jsonld_objects(texts: pd.Series) -> pd.Series:
    """The typed objects of an array of JSON-LD texts: their types, the values of a list ``sameAs``, whether they name an author."""

    def of(page):
        out = []
        for raw in page if page is not None else ():
            for o in typed_objects(raw):
                kinds, same = o["@type"], o.get("sameAs")
                out.append({
                    "types": [str(k) for k in (kinds if isinstance(kinds, list) else [kinds])],
                    "same_as": [str(s) for s in same] if isinstance(same, list) else [],
                    "author": "author" in o,
                })
        return out

    return texts.map(of, na_action=None)


@F.pandas_udf(ArrayType(BooleanType()))
def allowed(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether each agent (third column, an array) may fetch the URL (second) under a robots.txt (first). Null text gives null."""
    from urllib.robotparser import RobotFileParser

    for bodies, urls, agents in rows:
        out = []
        for body, url, names in zip(bodies, urls, agents):
            if body is None or names is None:
                out.append(None)
                continue
            rules = RobotFileParser()
            rules.parse(body.splitlines())
            out.append([bool(rules.can_fetch(a, url or "")) for a in names])
        yield pd.Series(out, dtype=object)


def named(body: Column, agent: Column) -> Column:
    """Whether a robots.txt has a line for this agent by its full name, whatever the case."""
    return F.exists(F.split(body, r"\r\n|\n|\r"), lambda x: F.lower(F.regexp_replace(x, r"(?U)^\s*(?i:user-agent):\s*|\s*$", "")).eqNullSafe(F.lower(agent)) & x.rlike(r"(?i)^\s*user-agent:"))


def sitemap_lines(body: Column) -> Column:
    """The addresses of a robots.txt's ``Sitemap:`` lines."""
    return F.regexp_extract_all(body, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))


def locations(body: Column) -> Column:
    """The ``<loc>`` values of a sitemap, without white space."""
    return F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<loc>(.*?)</loc>"), F.lit(1)), lambda x: F.regexp_replace(x, r"(?U)\s+", ""))


def is_sitemap_index(body: Column) -> Column:
    return F.lower(body).contains("<sitemapindex")


def charset(content_type: str | None, head: bytes) -> str | None:
    """The charset a response names: in its header, else in a ``<meta>`` of the first 4096 bytes; None if in neither."""
    if m := re.search(r"charset=[\"']?([\w-]+)", content_type or "", re.I):
        return m.group(1)
    if m := re.search(rb"<meta[^>]+charset=[\"']?\s*([\w-]+)", head[:4096], re.I):
        return m.group(1).decode("ascii", "ignore")
    return None


def decode(body: bytes, content_type: str | None) -> str:
    """Text of a response. Without a named charset it is UTF-8 if it can be, else Windows-1252; wrong bytes are replaced."""
    name = charset(content_type, body)
    if name is None:
        try:
            return body.decode("utf-8")
        except UnicodeDecodeError:
            name = "cp1252"
    try:
        return body.decode(name, "replace")
    except (LookupError, TypeError):
        return body.decode("utf-8", "replace")
