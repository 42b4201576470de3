"""Host, path, rule and a rule's verdict in SQL on the driver's table; links counted by page."""

import duckdb

from glyphmill.llm import url_filter
from glyphmill.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_rule_columns_in_sql(spark):
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    order = [("www.example.com", "/en/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("com", "/", "allow")]
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value(h, p, v)}'" for h, p, v in order) + " END"
    sql = rf"""WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM '{DATA}/pages.parquet'),
    b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM a)
    SELECT page_id, host, path, {case(lambda h, p, v: h + p)}, {case(lambda h, p, v: v)} FROM b"""
    got = {r.page_id: tuple(r) for r in QUERIES["op4_url_filter"](spark, DATA).collect()}
    want = duckdb.sql(sql).fetchall()
    assert len(got) == len(want) and any(w[3] for w in want)
    for w in want:
        assert got[w[0]][:4] == w[:4] and (w[4] is None or got[w[0]][4] == w[4])


def test_edges_count_pages_not_links(spark):
    farm = "".join(f"<a href='http://d.org/{i}'>" for i in range(50))
    pages = [("s.org", farm + "<a href=/own><a href='http://s.org/named'>"), ("s.org", "<a href='//D.org/x'>"), ("", farm), ("t.org", None), ("t.org", "<a href='?q'><a href='other'>")]
    got = {(r.src, r.dst): r.n for r in url_filter.host_edges(spark.createDataFrame(pages, "host string, html string")).collect()}
    assert got == {("s.org", "d.org"): 2, ("s.org", "s.org"): 1, ("t.org", "t.org"): 1}


def test_equal_trust_and_distrust_is_allowed(spark):
    seeds = spark.createDataFrame([("a", 1.0, 1.0, 2.0), ("b", 0.0, 1.0, 1.0)], "host string, trust double, distrust double, weight double")
    rank = {r.host: r for r in url_filter.propagate(spark.createDataFrame([], "src string, dst string, n long"), seeds).collect()}
    assert rank["a"].trust == rank["a"].distrust and rank["b"].distrust > rank["b"].trust
