"""Columns of the caller that bear the names that operators use inside."""

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import decontaminate, language_id, license_scan, line_dedup, near_copies, piece_codec, simhash, url_filter
from glyphmill.llm.queries import TOKENIZER

INNER = "__id __key __text __line __pos __norm __h __g __n __first __last __docs __drop __row __hot __words __items __spans __ids __by_rule __by_links row by_rule by_links d f u v a b p q n node root at __TEXT_".split()
ROWS = [(1, "one two three four five six seven eight nine ten\nshared line of words", "en"), (2, "Shared line of words\nand another thing said", "en"), (3, None, None), (4, "one two three four five six seven eight nine ten\nshared line of words", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumns({c: F.lit(f"my {c}") for c in INNER}).repartition(2)


def passes(docs, out):
    assert set(docs.columns) - {"text"} <= set(out.columns)
    rows = out.select("doc_id", *INNER).collect()
    assert rows and all(r[c] == f"my {c}" for r in rows for c in INNER)
    return rows


def test_inner_names_pass(spark, docs):
    bench = spark.createDataFrame([(1, "seven eight nine ten")], "item_id long, text string")
    assert len(passes(docs, line_dedup.line_dedup(docs))) == 4
    assert len(passes(docs, language_id.identify(docs))) == 4
    assert len(passes(docs, license_scan.license_scan(docs))) == 4
    assert len(passes(docs, decontaminate.decontaminate(docs, bench))) == 4
    coded = piece_codec.encode(docs, TOKENIZER)
    assert len(passes(docs, coded)) == len(passes(docs, piece_codec.decode(coded, TOKENIZER))) == 4
    assert len(passes(docs, simhash.near_dedup(docs))) == 3
    assert len(passes(docs, simhash.first_of_groups(docs, near_copies.near_groups(docs)))) == 3
    pages = docs.withColumns({"url": F.lit("http://a.com/x"), "html": F.lit("<a href='/y'>")})
    assert len(passes(docs, url_filter.url_filter(pages))) == 4


@pytest.mark.parametrize("extra", ["KEPT", "N_lines", "Lang_Pred", "HELD_OUT", "Score", "Matches", "N_WORDS", "Items", "Spans", "IDS", "Decoded", "Host", "Rule"])
def test_result_columns_replace_those_that_differ_in_case(spark, extra):
    docs = spark.createDataFrame([r for r in ROWS], "doc_id long, text string, lang string").withColumn(extra, F.lit("mine")).withColumns({"url": F.lit("http://a.com/x"), "html": F.lit("")})
    bench = spark.createDataFrame([(1, "seven eight nine ten")], "item_id long, text string")
    coded = piece_codec.encode(docs, TOKENIZER)
    for out in (line_dedup.line_dedup(docs), language_id.identify(docs), license_scan.license_scan(docs), decontaminate.decontaminate(docs, bench), coded, piece_codec.decode(coded, TOKENIZER), url_filter.url_filter(docs)):
        low = [c.lower() for c in out.columns]
        assert len(low) == len(set(low)) and extra.lower() in low
        made = extra not in out.columns
        assert out.select(extra).schema.fields and (made or out.select(extra).first()[0] == "mine")


def test_names_with_backticks_pass(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumns({"a`b": F.lit(1), "c.d": F.lit(2), "url": F.lit("http://a.com/x"), "html": F.lit("")})
    bench = spark.createDataFrame([(1, "seven eight nine ten")], "item_id long, text string")
    coded = piece_codec.encode(docs, TOKENIZER)
    for out in (line_dedup.line_dedup(docs), language_id.identify(docs), license_scan.license_scan(docs), decontaminate.decontaminate(docs, bench), coded, piece_codec.decode(coded, TOKENIZER), url_filter.url_filter(docs), simhash.near_dedup(docs), simhash.first_of_groups(docs, near_copies.near_groups(docs))):
        assert {"a`b", "c.d"} <= set(out.columns) and {(r["a`b"], r["c.d"]) for r in out.collect()} == {(1, 2)}
