"""Similar pages of one site: candidates through rare shared terms, cosine, near-duplicate groups and what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.graph import components
from corpusmill.operators.joins import lookup_join

LOW, HIGH, SAME = 0.30, 0.70, 0.95


def candidate_pairs(vectors: DataFrame, most_pages: int = 60, min_shared: int = 2) -> DataFrame:
    """``site, a, b, shared, partial`` (``a < b`` page ids): pages that share ``min_shared`` terms that stand in at most ``most_pages`` vectors of the site.

    The cut is by count, so a term gives at most ``most_pages`` (``most_pages`` - 1) / 2 rows whatever the site's size.
    ``partial`` is what those terms give to the cosine.
    """
    often = vectors.groupBy("site", "term").agg(F.count(F.lit(1)).alias("pages"))
    rare = lookup_join(vectors.select("site", "page_id", "term", "weight"), often.where(F.col("pages").between(2, most_pages)).select("site", "term"), ["site", "term"], "left_semi")
    lists = rare.groupBy("site", "term").agg(F.sort_array(F.collect_list(F.struct("page_id", "weight"))).alias("l"))  # at most most_pages entries
    left = lists.select("site", "l", F.posexplode("l").alias("i", "x"))
    both = left.select("site", "x", F.explode(F.slice("l", F.col("i") + 2, F.lit(most_pages))).alias("y"))
    sums = both.groupBy("site", F.col("x.page_id").alias("a"), F.col("y.page_id").alias("b"))
    return sums.agg(F.count(F.lit(1)).alias("shared"), F.sum(F.col("x.weight") * F.col("y.weight")).alias("partial")).where(F.col("shared") >= min_shared)


def packed(vectors: DataFrame) -> DataFrame:
    """``page_id, v``: each page's terms and weights as a map in the order of rank."""
    entries = F.array_sort(F.collect_list(F.struct("rk", "term", "weight")))
    return vectors.groupBy("page_id").agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e.term, e.weight))).alias("v"))


def similar_pairs(vectors: DataFrame, low: float = LOW, top: int = 5) -> DataFrame:
    """``site, a, b, similarity, terms``: candidate pairs whose cosine over all shared terms is at least ``low``.

    ``terms`` are the ``top`` shared terms by summed weight. The vectors have length 1 and at most some dozen terms, so they are joined whole.
    """
    pairs = candidate_pairs(vectors)
    v = packed(vectors)
    both = pairs.join(v.select(F.col("page_id").alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col("page_id").alias("b"), F.col("v").alias("vb")), "b")
    common = F.array_intersect(F.map_keys("va"), F.map_keys("vb"))
    weights = F.transform(common, lambda t, i: F.struct(F.round(-(F.try_element_at("va", t) + F.try_element_at("vb", t)), 12).alias("w"), i.alias("i"), t.alias("t"), (F.try_element_at("va", t) * F.try_element_at("vb", t)).alias("p")))
    out = both.select("site", "a", "b", weights.alias("ws"))
    cosine = F.aggregate("ws", F.lit(0.0), lambda acc, x: acc + x.p)
    out = out.withColumn("similarity", cosine).where(F.col("similarity") >= low)
    terms = F.transform(F.slice(F.array_sort("ws"), 1, top), lambda x: x.t)
    return out.select("site", "a", "b", "similarity", terms.alias("terms"))


def band(similarity: Column) -> Column:
    """Reading of a cosine: unrelated, distant (0.20), complementary (0.30), overlap (0.50), cannibalisation (0.70), same (0.95)."""
    s = similarity
    return F.when(s >= 0.95, "same").when(s >= 0.70, "cannibalisation").when(s >= 0.50, "overlap").when(s >= 0.30, "complementary").when(s >= 0.20, "distant").otherwise("unrelated")


def described(pairs: DataFrame, pages: DataFrame, linked: DataFrame) -> DataFrame:
    """The pairs with ``url_a, url_b, title_a, title_b, lang_a, lang_b, linked``; ``linked``: one page links to the other editorially."""
    names = pages.select("page_id", "url", F.coalesce("title", F.lit("")).alias("title"), F.lower(F.substring_index(F.translate(F.coalesce("lang", F.lit("")), "_", "-"), "-", 1)).alias("lang"))
    for side in "ab":
        pairs = pairs.join(names.select(F.col("page_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("url", "title", "lang"))), side)
    known = linked.select("site", F.col("a").alias("__a"), F.col("b").alias("__b"), F.lit(True).alias("linked"))
    rows = pairs.withColumn("__a", F.least("url_a", "url_b")).withColumn("__b", F.greatest("url_a", "url_b"))
    return rows.join(known, ["site", "__a", "__b"], "left").drop("__a", "__b").withColumn("linked", F.coalesce("linked", F.lit(False)))


def _same_lang(one_language: bool) -> Column:
    return (F.col("lang_a") == F.col("lang_b")) if one_language else F.lit(True)


def opportunities(described: DataFrame, high: float = HIGH, one_language: bool = False) -> DataFrame:
    """Close pages, below ``high``, that no editorial link joins; ``one_language`` leaves out pairs of two languages."""
    return described.where((F.col("similarity") < high) & ~F.col("linked") & _same_lang(one_language))


def cannibalisation(described: DataFrame, high: float = HIGH, same: float = SAME, one_language: bool = False) -> DataFrame:
    """Pages from ``high`` up to ``same``: too close for two pages."""
    return described.where((F.col("similarity") >= high) & (F.col("similarity") < same) & _same_lang(one_language))


def duplicates(pairs: DataFrame, pages: DataFrame, same: float = SAME) -> DataFrame:
    """``site, urls, canonicals, title`` of each group of pages joined by pairs of ``same`` or more: shortest address first, its title,
    and the different canonicals the group declares."""
    names = pages.select("page_id", "url", "title", "canonical")
    rows = pairs.where(F.col("similarity") >= same).select("site", "a", "b")
    labels = components(rows).withColumnRenamed("url", "page_id")
    entry = F.struct(F.length("url").alias("n"), "url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("canonical", F.lit("")).alias("canonical"))
    groups = labels.join(names, "page_id").groupBy("site", "label").agg(F.array_sort(F.collect_list(entry)).alias("m"))
    canonicals = F.array_sort(F.array_distinct(F.filter(F.transform("m", lambda x: x.canonical), lambda c: c != "")))
    return groups.select("site", F.transform("m", lambda x: x.url).alias("urls"), canonicals.alias("canonicals"), F.get("m", F.lit(0)).title.alias("title"))


def isolated(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """``site, url`` of the documents without a similar page, in sites of two documents or more."""
    near = pairs.select(F.explode(F.array("a", "b")).alias("page_id")).distinct()
    sites = documents.groupBy("site").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("site")
    return lookup_join(documents.select("site", "page_id", "url"), sites, ["site"], "left_semi").join(near, "page_id", "left_anti").select("site", "url")
