"""A line repeated on a tenth of the pages is found, also where no other site is left to compare with."""

import pytest

from corpusmill.llm import repeated_lines


@pytest.mark.parametrize("sites", [1, 2])
def test_line_on_few_or_most_pages(spark, sites):
    rows, want = [], set()
    for s in range(sites):
        for i in range(50):
            page = 100 * s + i
            lines = [f"{chr(97 + i % 26)}{chr(97 + i // 26)} own text of page {chr(97 + s)}", "Seen on four pages only" if i < 4 else "filler " + "x" * (i + 1) + "y" * s]
            for k, n in enumerate((5, 12, 25, 40, 50)):
                if i < n:
                    want.add((page, 0, len(lines)))
                    lines.append("Notice " + "abcde"[k])
            rows.append((page, f"s{s}", [("h", 2, "\n".join(lines))], "\n".join(lines)))
    table = spark.createDataFrame(rows, "page_id bigint, site string, blocks array<struct<heading:string,level:int,text:string>>, text string")
    assert {tuple(r) for r in repeated_lines.repeated_lines(table).collect()} == want
