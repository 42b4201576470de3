"""Small cases that whole-table tests do not reach."""

import pytest

from glyphmill.llm import decontaminate, piece_codec, url_filter
from glyphmill.llm.queries import TOKENIZER

WORDS = [f"w{i}" for i in range(200)]


def test_many_blocks_and_counting_groups_change_nothing(spark):
    docs = spark.createDataFrame([(i, " ".join(WORDS[i : i + 40])) for i in range(0, 160, 7)] + [(900, "w3 " * 30), (901, None)], "doc_id long, text string").repartition(3)
    # items that share a window, repeated items, short ones, and one that no document holds
    items = [(i, " ".join(WORDS[10 * (i % 5) : 10 * (i % 5) + 12 + i % 3])) for i in range(60)] + [(100, "w3 w3"), (101, "w9 w10 w11"), (102, "absent " * 20), (102, "absent " * 20), (103, ""), (104, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = lambda r: (r.doc_id, r.n_words, r.n_hit, r.contaminated, sorted(r["items"]), sorted(map(tuple, r.spans)))
    seen = [sorted(map(plain, decontaminate.decontaminate(docs, bench, block_bytes=size, counted=counted).collect())) for size, counted in ((1 << 23, 1 << 24), (2000, 1 << 24), (2000, 30))]
    assert seen[1] == seen[0] and seen[2] == seen[0] and len(seen[0]) == 25
    hit = {r.doc_id: set(r["items"]) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert hit[0] >= {i for i in range(60) if i % 5 < 2} and hit[900] == {100} and hit[901] == set()


def test_ids_that_the_model_lacks_are_skipped(spark):
    ids = piece_codec.encode(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), TOKENIZER).first().ids
    rows = spark.createDataFrame([(1, [-1, *ids, 10**6]), (2, [None, 2**31 - 1, -(2**31)]), (3, []), (4, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in piece_codec.decode(rows, TOKENIZER).collect()} == {1: "a b c", 2: "", 3: "", 4: None}


@pytest.mark.parametrize("linked, verdict", [(True, "allow"), (False, "block")])
def test_distrust_must_exceed_trust(spark, linked, verdict):
    """h.com links to a blocked host; a trusted host that links to it gives it as much trust as that gives it distrust."""
    pages = spark.createDataFrame([(1, "http://a.com/", '<a href="http://h.com/">' if linked else ""), (2, "http://h.com/", '<a href="http://b.org/">'), (3, "http://b.org/", "")], "page_id long, url string, html string")
    rules = (("a.com", "/", "allow"), ("b.org", "/", "block"))
    got = {r.host: (r.rule, r.verdict) for r in url_filter.url_filter(pages, rules=rules).collect()}
    assert got == {"a.com": ("a.com/", "allow"), "b.org": ("b.org/", "block"), "h.com": (None, verdict)}
