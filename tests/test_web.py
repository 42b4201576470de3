"""Services and crawls with canned answers."""

import json
import sys
import urllib.parse

from pyspark import cloudpickle

from glyphmill.operators import corpus as C, overlap as V
from glyphmill.sources import web

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module
PARA = "La fotosíntesis es el proceso mediante el cual las plantas convierten la energía luminosa en energía química almacenada en azúcares."
SPANISH = "La casa de la que se habla en el texto no es una casa más, y por eso los que la ven como algo para su familia la quieren. "


def params(url):
    return {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlsplit(url).query).items()}


def index(text):
    out = {}
    for i, w in enumerate(text.split()):
        out.setdefault(w, []).append(i)
    return out


def works(url):
    q = params(url)
    if "seed" in q:
        n = int(q["seed"])
        own = [{"id": f"https://openalex.org/W{n % 3}", "title": "Un <i>título</i>", "publication_year": 2015, "abstract_inverted_index": index("Resumen: " + SPANISH * 8 + " Keywords: none"), "primary_topic": None if n % 3 else {"field": {"display_name": "Artes"}}}, {"id": f"W{n}", "title": None, "abstract_inverted_index": index("x")}, {"id": f"V{n}", "title": "t", "abstract_inverted_index": None}]
        return json.dumps({"results": own}).encode()
    assert q["filter"] == "has_abstract:true" and q["per-page"] == "5"
    return json.dumps({"results": [{"id": "w1", "doi": "doi:1", "title": None, "abstract_inverted_index": index("<b>" + PARA + "</b> &amp;")}, {"id": "w2", "doi": None, "title": "T", "abstract_inverted_index": None}]}).encode()


def pages(url):
    q = params(url)
    if q.get("list") == "search":
        return json.dumps({"query": {"search": [{"title": "La planta"}, {"title": "Vacía"}]}}).encode()
    if q.get("prop") == "extracts":
        return json.dumps({"query": {"pages": [{"extract": PARA if q["titles"] == "La planta" else ""}]}}).encode()
    if q.get("generator") == "random":
        return json.dumps({"query": {"pages": {"1": {"title": "Larga", "length": 20000}, "2": {"title": "Corta", "length": 50}, "3": {"title": "Nueva", "length": 20000}}}}).encode()
    if q.get("prop") == "revisions":
        assert q["rvstart"].startswith("2021-12-31")
        return json.dumps({"query": {"pages": {"1": {"revisions": [{"revid": 77, "timestamp": "2020-05-01T00:00:00Z"}]} if q["titles"] == "Larga" else {}}}}).encode()
    assert q["oldid"] == "77"
    return json.dumps({"parse": {"text": "".join(f"<p>{SPANISH * 4}[1]</p>" for _ in range(9))}}).encode()


def broken(url):
    raise RuntimeError("not what a service should do")


def asked(spark):
    return spark.createDataFrame([("plantas energía",)], "query string")


def test_searches_give_sources(spark):
    (w,) = web.openalex_search(works)(asked(spark)).collect()
    assert (w.url, w.title, w.kind, w.text) == ("doi:1", "(sin título)", "OpenAlex", PARA + " &")
    (p,) = web.wikipedia_search("es", pages)(asked(spark)).collect()
    assert (p.url, p.title, p.kind, p.text) == ("https://es.wikipedia.org/wiki/La_planta", "La planta", "Wikipedia", PARA)


def test_a_service_that_fails_while_it_runs_leaves_the_others(spark):
    rows = spark.createDataFrame([(0, (PARA + " ") * 6)], "doc_id long, text string")
    search = V.failover(web.openalex_search(broken), web.wikipedia_search("es", pages))
    (r,) = V.check(rows, search).collect()
    assert r.sources_seen == 1 and r.fraction == 1.0 and r.sources[0].kind == "Wikipedia"
    assert web.answers(asked(spark), web.OPENALEX, {}, {"search": "query"}, broken).first().answer is None


def test_odd_answers_give_no_rows(spark):
    for answer in (b"[]", b"{}", b'{"results": 3}', b'{"query": {"search": "x"}}'):
        assert web.openalex_search(lambda _, a=answer: a)(asked(spark)).count() == 0
        assert web.wikipedia_search("es", lambda _, a=answer: a)(asked(spark)).count() == 0


def test_crawls_give_items(spark):
    items = C.human_items(web.openalex_items(spark, 7, works), "academico", "-", 10).collect()
    assert {(i.id, i.source, i.title, i.year) for i in items} == {(f"oa_W{k}", f"https://openalex.org/W{k}", "Un título", 2015) for k in range(3)}
    assert all(not i.text.startswith("Resumen") and not i.text.endswith("none") for i in items) and {i.field for i in items} == {"Artes", "desconocido"}
    (w,) = C.human_items(web.wikipedia_items(spark, 3, get=pages), "enciclopedico", "-", 10, least=250, most=None).collect()
    assert (w.id, w.title, w.field, w.year) == ("wk_77", "Larga", "wikipedia", 2020) and w.source.endswith("oldid=77")
    assert 250 <= w.words <= 650 and "[1]" not in w.text and w.text.count("\n\n") == w.words // (27 * 4) - 1
