"""Paragraphs of pages as an expression, against the exact parser, on random tag soup and on corners of the grammar."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.sources import files

PARTS = ["<p>", "</p>", "<P class='a>b'>", "</p >", "<p/>", "<table>", "</table>", "<sup>", "</sup>", "<figure a=\"</p>\">", "</figure>", "<b>", "</b>", "<br/>", "<!-- <p> -->", "<!DOCTYPE html>", "<?pi p?>",
         "<script>if (a < b) '<p>'</script>", "<style type='x'>p {}</style>", "</script>", "<script/>", "<td x=1 y = '2'>", "uno &amp; dos ", "a < b ", "tres\n", " &lt;p&gt; ", "&#241;u ", "x=\"y\" it's ", "<pre>", "</pre>", "<a href=it's>", "</>", "<img alt=''>"]


def soup(seed):
    rng = random.Random(seed)
    return "".join(rng.choices(PARTS, weights=[6, 6, 2, 1, 1] + [1] * (len(PARTS) - 5), k=rng.randrange(1, 60)))


PAGES = [
    "", "no tags", "<p>one</p>", "<p>one<p>two</p>three</p>four", "</p><p>a</p>", "<p>open", "<table><p>in</p></table><p>out</p>", "</table><table><p>x</p>", "<p>a<script>x<p></script>b</p>", "<p>a<script>no end <p>b</p>", "<p>a<!-- no end </p>",
    "<p>a<sup>1</p>b</sup>c</p>", "<p>a</p>tail</p><p>b</p>", "<p/>x<p>y</p>", "<p title=\"a > b\">c</p>", "<P>Á&eacute;</P>", "<p>a &am<b>p;</b> c</p>", "<p>" * 400 + "x" + "</p>" * 400, "<p>a<![CDATA[ b > c ]]>d</p>", "<p>a</ p>b</p>", "<p\n>a</p\n>",
]


@pytest.mark.parametrize("least", [0, 2])
def test_the_expression_equals_the_parser(spark, least):
    pages = [*PAGES, *(soup(k) for k in range(400))]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").repartition(4)
    got = {r[0]: r[1] for r in rows.select("page_id", files.html_paragraphs_native(F.col("html"), least)).collect()}
    for k, page in enumerate(pages):
        assert got[k] == files.paragraphs_of(page, least), page


def test_depths_stay_at_zero(spark):
    rng = random.Random(1)
    cases = [[], [-1], [1, -1, -1, 1], [rng.choice([-1, -1, 0, 1, 1]) for _ in range(2000)]]
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, x array<int>").select("k", T.held_at_zero(F.col("x")))
    for k, got in rows.collect():
        depth, want = 0, []
        for s in cases[k]:
            depth = max(0, depth + s)
            want.append(depth)
        assert got == want


def test_null_pages(spark):
    assert spark.range(1).select(files.html_paragraphs_native(F.lit(None).cast("string"))).first()[0] == []
