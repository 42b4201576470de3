"""Overlap, corpus building, metrics, fits, sources, streaming."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from glyphmill.config import EngineConfig
from glyphmill.operators import corpus as C, evaluate as E, models as M, overlap as V
from glyphmill.sources import files, sinks, web
from glyphmill.functions import text as T

PARA = "La fotosíntesis es el proceso mediante el cual las plantas convierten la energía luminosa en energía química almacenada en azúcares."


def source_rows(spark, *texts):
    return spark.createDataFrame([(f"u{k}", f"t{k}", "web", t, k) for k, t in enumerate(texts)], "url string, title string, kind string, text string, ord long")


def test_overlap_ignores_case_and_accents_and_prefers_the_first_source(spark):
    text = PARA.upper().replace("Í", "I") + "\n\nEste otro párrafo es mío y no se parece a nada de lo que se ha publicado antes en ningún sitio."
    sents = spark.createDataFrame([(0, text)], "doc_id long, t string").select("doc_id", F.posexplode(T.sentences(F.col("t"))).alias("sent_id", "s")).select("doc_id", "sent_id", "s.paragraph", "s.text")
    found = V.matches(sents, source_rows(spark, PARA, PARA, "otra cosa")).collect()
    assert [(r.sent_id, r.url, r.overlap) for r in found] == [(0, "u0", 1.0)]
    total = V.totals(sents, V.matches(sents, source_rows(spark, PARA))).first()
    assert 0.4 < total.fraction < 0.6 and total.sources[0].url == "u0"


def test_keywords_rank(spark):
    row = spark.createDataFrame([("El café café y la CAFÉ mesa mesa sobre desde extraordinaria",)], "t string").select(V.keywords(F.col("t"), 3)).first()
    assert row[0] == ["café", "mesa", "extraordinaria"]


def test_check_and_failover(spark):
    rows = spark.createDataFrame([(0, (PARA + " ") * 6)], "doc_id long, text string")

    def down(_):
        raise OSError("no network")

    r = V.check(rows, V.failover(down, lambda asked: source_rows(spark, PARA))).first()
    assert r.sources_seen == 1 and r.fraction == 1.0 and len(r.queries) == 1


def test_sources_keep_first_place_and_last_value(spark):
    rows = spark.createDataFrame([("u", "a", "k", "x", 1), ("v", "b", "k", "y", 2), ("u", "c", "k", "z", 3)], "url string, title string, kind string, text string, ord long")
    assert {r.url: (r.ord, r.title) for r in V.unique_sources(rows).collect()} == {"u": (1, "c"), "v": (2, "b")}


def scored(spark, n=300, seed=2):
    rnd = random.Random(seed)
    rows = [(i, rnd.random() < 0.4, rnd.randint(0, 20) / 20) for i in range(n)]
    return rows, spark.createDataFrame([(i, int(y), p) for i, y, p in rows] + [(n, None, 0.5), (n + 1, 1, None)], "id int, y int, p double")


def test_auroc_and_roc_against_pairs(spark):
    rows, frame = scored(spark)
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(E.auroc(frame, "p", "y").first().auroc - want) < 1e-12
    best = max((sum(a >= t for a in pos) / len(pos), t) for t in {*pos, *neg} if sum(b >= t for b in neg) / len(neg) <= 0.1)
    got = E.tpr_at_fpr(frame, "p", "y", fpr=0.1).first()
    assert (got.tpr, got.threshold) == pytest.approx(best)
    assert E.auroc(frame.where("y = 1"), "p", "y").first().auroc is None


def test_splits_keep_groups_together(spark):
    rows = spark.createDataFrame([(i, i % 17, i % 2) for i in range(400)], "id int, g int, y int")
    split = C.group_split(rows, "g", hold_out=F.col("id") == 3).collect()
    assert all(len({r.split for r in split if r.g == g}) == 1 for g in range(17)) and {r.split for r in split if r.g == 3} == {"test"}
    dealt = C.folds(rows, "g").collect()
    assert all(len({r.fold for r in dealt if r.g == g}) == 1 for g in range(17)) and {r.fold for r in dealt} == set(range(5))
    sample = C.stratified(rows, "y", "id", 40).collect()
    assert sorted(r.y for r in sample) == [0] * 20 + [1] * 20


def test_rejects_prompts_and_tasks(spark):
    rows = spark.createDataFrame([(i, "texto " * 120, "T", "física", "academico", 900) for i in range(400)], "id int, text string, title string, field string, domain string, words int")
    made = rows.select(C.choose_task("id").alias("task"), C.prompt("id", "text", "title", "field", "domain", "words", C.choose_task("id")).alias("p"), C.reject_reason(F.col("text")).alias("r")).collect()
    assert {r.r for r in made} == {"idioma"} and all("600 palabras" in r.p for r in made)
    share = sum(r.task == "redactar" for r in made) / 400
    assert 0.5 < share < 0.7 and all("título" not in r.p or "«T»" in r.p for r in made if r.task == "redactar")
    good, bad = C.split_rejects(rows, "text")
    assert good.count() == 0 and bad.count() == 400


def test_take_until_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 9), (1, 2, 1)], "id int, k int, n int")
    assert [r.k for r in C.take_until(rows, "id", "k", "n", 10).collect()] == [0]


def test_fits(spark):
    rnd = random.Random(5)
    rows = [(i, i % 7, float(y := rnd.random() < 0.5), (0.8 if y else 1.0) + rnd.gauss(0, 0.05), rnd.random()) for i in range(300)]
    frame = spark.createDataFrame(rows, "id int, g int, y double, s double, q double").cache()
    cal = M.fit_calibration(frame, "s", "y", "m")
    assert cal["slope"] < 0 and cal["metrics"]["auroc"] > 0.95
    out = M.out_of_fold(C.hashed_folds(frame, "g", 2), ["s", "q"], "y", k=2)
    assert out.count() == 300 and E.auroc(out, "meta_p", "y").first().auroc > 0.95
    fit = M.fit_meta(frame, ["s", "q"], "y")
    moved = M.shifted(fit, M.score_meta(frame, fit), "y", fpr=0.1)
    again = M.score_meta(frame, moved).where("y = 0 and meta_p >= 0.65").count() / frame.where("y = 0").count()
    assert abs(again - 0.1) < 0.02
    with pytest.raises(ValueError):
        M.fit_calibration(frame.where("y = 1"), "s", "y", "m")


def docx(xml):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{xml}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("Uno  dos") + f"<w:tbl><w:tr><w:tc>{p('celda')}</w:tc></w:tr></w:tbl>" + "<w:p><w:r><w:t>Cita</w:t></w:r><w:sdt><w:sdtContent><w:r><w:t> (Ruiz)</w:t></w:r></w:sdtContent></w:sdt></w:p>" + p("Ruiz, A. B. (2020). Título.")
    for name, raw in {"a.txt": b"\xef\xbb\xbfhola", "b.txt": "año".encode("latin-1"), "c.docx": docx(body), "d.xls": b"x", "e.docx": b"broken"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, f"file://{tmp_path}").collect()}
    assert got["a.txt"].text == "hola" and got["b.txt"].text == "año" and got["c.docx"].text == "Uno dos\n\nCita (Ruiz)"
    assert "unsupported" in got["d.xls"].error and "cannot read" in got["e.docx"].error


def test_html_parser_counts_and_flushes(spark):
    long = " ".join(["palabra"] * 15)
    html = f"<p>{long} &amp; más<sup>1</sup></p><p>corto</p><table><p>{long}</p></table><p>abierto <p>{long}</p>{long}</p>"
    rows = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    got = {r.page_id: r.paragraphs for r in files.html_paragraphs(rows).collect()}
    assert got[1] == [f"{long} & más", f"abierto {long}", long] and got[2] == []
    assert rows.where("page_id = 1").select(files.html_paragraphs_native(F.lit(f"<p>{long}</p>"))).first()[0] == [long]


def test_tables_and_zips(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("id\ttext\tlabel\tdomain\tmodel\n1\thola\tgenerated\tx\tA\n2\tadiós\thuman\tx\tno\n")
    assert [tuple(r) for r in files.read_labelled_tsv(spark, f"file://{tmp_path}/t.tsv").select("id", "label").collect()] == [("1", 1), ("2", 0)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/csv/a.csv", "essay,l1\nhola,en\n,fr\n")
        z.writestr("d/other.csv", "essay\nno\n")
    got = files.zipped_csv(spark, f"file://{tmp_path}/z.zip", ["essay", "l1", "home"], required="essay").collect()
    assert [tuple(r) for r in got] == [("hola", "en", None)]


def test_append_is_resumable(spark, tmp_path):
    jobs, path = spark.createDataFrame([(1,), (2,)], "id long"), f"file://{tmp_path}/out"
    work = lambda rows: rows.withColumn("text", F.lit("x"))
    for _ in range(2):
        sinks.append_missing(jobs, path, ["id"], work, "id long, text string")
    assert spark.read.json(path).count() == 2


def test_requests_are_retried():
    pauses, answers = [], [OSError("down"), OSError("down"), json.dumps({"results": [1]}).encode()]

    def get(_):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert web.fetch_json("http://x", {"q": 1}, get=get, pause=pauses.append) == {"results": [1]} and pauses == [1.0, 2.0]


def test_config_from_environment():
    c = EngineConfig.from_environment({"GLYPHMILL_MIN_WORDS": "5", "GLYPHMILL_USE_CLASSIFIER": "no"})
    assert c.min_words == 5 and c.use_classifier is False
    with pytest.raises(ValueError):
        EngineConfig.from_environment({"GLYPHMILL_MIN_WORDS": "x"})


def test_stream(spark, tmp_path):
    from glyphmill.streaming.analysis import stream_reports

    spark.createDataFrame([(1, PARA + " " + "palabra " * 90)], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    q = stream_reports(stream).select("doc_id", "p").writeStream.format("memory").queryName("reports").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert [r.doc_id for r in spark.table("reports").collect()] == [1]


def test_rewrite_change(spark):
    row = spark.createDataFrame([("uno dos tres", "uno dos cuatro cinco")], "a string, b string").select(C.rewrite_change("a", "b").alias("r")).first().r
    assert abs(row.kept - 2 / 3) < 1e-12 and abs(row.length_ratio - 4 / 3) < 1e-12


def test_human_items_and_articles(spark):
    es = "La casa de la que se habla en el texto no es una casa más, y por eso los que la ven como algo para su familia la quieren. " * 7
    rows = spark.createDataFrame([("a", es, "t", "f", 2020), ("a", es, "t", "f", 2020), ("b", "the of and " * 60, "t", "f", 2020), ("c", "corto", "t", "f", 2020), ("d", None, "t", "f", 2020)], "id string, text string, title string, field string, year int")
    assert [(r.id, r.domain) for r in C.human_items(rows, "academico", "dump", 5).collect()] == [("a", "academico")]
    parts = spark.createDataFrame([("a", 0, "uno[1] dos"), ("a", 1, "tres cuatro"), ("a", 2, "cinco seis siete")], "id string, k int, text string")
    assert C.article_text(parts, limit=4).first().text == "uno dos\n\ntres cuatro"


def test_model_providers(spark):
    from glyphmill.operators import signals as G

    rows = spark.createDataFrame([(1, "uno dos"), (2, None)], "doc_id long, text string")
    tokens = G.token_provider(rows, lambda: lambda t: [(0, len(w), 1.0, 2.0) for w in t.split()]).collect()
    assert [(r.doc_id, r.pos) for r in tokens] == [(1, 0), (1, 1)]
    scored = G.text_provider(rows, lambda: lambda ts: [len(t) / 10 for t in ts], "classifier_p", "double").collect()
    assert {r.doc_id: r.classifier_p for r in scored} == {1: 0.7, 2: 0.0}
