"""Ids with several texts."""

from glyphmill.llm import simhash


def test_simhash_links_all_texts_of_an_id(spark):
    a, b, c = "one short text of several words", "quite another matter is said in here", "and a third thing that nobody asked for"
    rows = [(1, a), (5, a), (5, b), (6, b), (2, c), (5, c), (7, "alone with its very own words today")]
    got = {(r["__id"], r.component_id) for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (6, 1), (7, 7)}
