"""Propagation to its end."""

from glyphmill.llm import url_filter


def test_distrust_passes_long_chains(spark):
    pages = [(i, f"http://bad.example.com/en/{i}", "") for i in range(1000)] + [(2000, "http://h0.org/", "<a href='http://bad.example.com/en/1'>")]
    pages += [(2000 + i, f"http://h{i}.org/", f"<a href='http://h{i - 1}.org/'><a href='/own'>") for i in range(1, 13)]
    got = {r.page_id: r.verdict for r in url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {got[2000 + i] for i in range(13)} == {"block"}


def test_propagation_solves_the_equations(spark):
    import numpy as np

    edges = [("a", "a", 3), ("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "c", 1), ("d", "d", 2)]
    seeds = [("a", 3.0, 0.0, 3.0), ("c", 0.0, 2.0, 2.0), ("d", 1.0, 0.0, 1.0)]
    got = {r.host: tuple(r)[1:] for r in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, trust double, distrust double, weight double")).collect()}
    w, s = np.zeros((4, 4)), np.zeros((3, 4))
    for x, y, n in edges:
        w["abcd".index(x), "abcd".index(y)] = n
    for h, *v in seeds:
        s[:, "abcd".index(h)] = v
    along, against = w / w.sum(1, keepdims=True), (w / w.sum(0, keepdims=True)).T
    want = [0.15 * s[k] @ np.linalg.inv(np.eye(4) - 0.85 * m) for k, m in enumerate((along, against, along))]
    assert all(np.allclose(got[h], [x["abcd".index(h)] for x in want], atol=1e-5) for h in "abcd")
