"""Records in chunks."""

import re

from glyphmill.llm import warc


def test_warc_slices_after_the_explode(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "é" * 100), (2, "http://a.com/b", "é" * 100), (3, None, None)], "page_id long, url string, html string")
    rows = warc.chunk_rows(pages, chunk=64)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence(" in plan and not re.search(r"explode\([^\n]*substring", plan)
    parts = {}
    for r in sorted(rows.collect(), key=lambda r: (r.page, r.chunk_no)):
        parts.setdefault(r.page, []).append(bytes(r.chunk))
    assert parts == {1: [("é" * 32).encode()] * 3 + [("é" * 4).encode()], 2: [b""], 3: [b""]}
