"""Template residue and error-page text (problem 7).

Lines are counted by host, digits and the site's name masked, and what recurs there as boilerplate is subtracted; what
remains is the page's own text. A page is excluded when its residual holds a placeholder, an unrendered value, filler
or a text to be replaced, or when it is a message: a line that recurs on several hosts and there stands alone, on pages without other
sentences. Error texts, block and maintenance messages and notices that scripts are needed are such lines in any
language; the text of a short but real page is not, since other pages do not print it. A line that is rare in all is believed only where the page
serves much HTML for its few words. A sentence that talks about such things is no evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.main_content import DATED, EXTRA, THIN, each_page, marked_lines


def residue_pages(
    pages: DataFrame, key: str = "page_id", source: str = "site", own_words: int = 8, often: int = 3, bytes_a_word: int = 1000, least_pages: int = 3, share: float = 0.1, repair: bool = True
) -> DataFrame:
    """``key, evidence`` of the pages to be left out: ``residue`` or ``message``.

    A page's own text is a message when a line that usually stands alone is left after the boilerplate and the lines that
    recur on the site, and at most ``own_words`` words stand in the other lines left. A line known from fewer than ``often`` pages counts only where the page
    has ``bytes_a_word`` bytes of HTML or more for each word. Pages without text are not judged; null bytes count as none.
    """
    thin = (F.coalesce("html_bytes", F.lit(0)) >= bytes_a_word * F.greatest(F.coalesce("words", F.lit(0)), F.lit(1)))
    rows = pages.where(F.col("text").isNotNull()).withColumn("thin", F.coalesce(thin, F.lit(False)))
    by_page = marked_lines(rows, key, source, least_pages, share, repair)

    def result(p, a, z, out):
        if any(p["kind"][i] & EXTRA for i in range(a, z) if not p["template"][i]):
            return [("residue",)]
        alone = {i for i in range(a, z) if p["alone"][i] and (p["seen"][i] >= often or p["kind"][i] & THIN)}
        left = [a + i for i, o in enumerate(out) if not o and not p["kind"][a + i] & DATED and (a + i in alone or not p["dense"][a + i])]
        if not alone.isdisjoint(left) and sum(p["tokens"][i] for i in left if i not in alone) <= own_words:
            return [("message",)]
        return []

    return each_page(by_page, key, "evidence string", result)
