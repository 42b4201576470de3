"""The windowed audit of a stream, and PDF blocks by a stand-in for the library that is not here."""

import json
import sys
import types

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import style
from glyphmill.sources import files
from glyphmill.streaming import analysis

TEXTS = ["Además, es importante destacar que el análisis es clave. Por otro lado, el sistema es claro.", "Vine. ¿Quién sabe? Nadie, o eso dicen los que estaban aquella tarde larga de agosto en la plaza vieja.", ""]


def test_windowed_audit(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [(f"2024-01-01T{h:02d}:{m:02d}:00Z", "ab"[k % 2], TEXTS[k % 3]) for k, (h, m) in enumerate((h, m) for h in (10, 11, 12) for m in (0, 20, 59))]
    (source / "1.json").write_text("\n".join(json.dumps({"at": a, "g": g, "text": t}) for a, g, t in rows))
    (source / "2.json").write_text(json.dumps({"at": "2024-01-02T00:00:00Z", "g": "a", "text": TEXTS[0]}))
    stream = spark.readStream.schema("at timestamp, g string, text string").option("maxFilesPerTrigger", 1).json(str(source))
    query = analysis.windowed_audit(stream, "at", "g").writeStream.format("memory").queryName("audit").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        got = {(str(r.window.start), r.group): (r.n, r.flagged, r.mean_p) for r in spark.table("audit").collect()}
    finally:
        query.stop()
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, at string, g string, text string")
    scores = {r.doc_id: r.style for r in style.features(style.prepare(docs.select("doc_id", "text"))).select("doc_id", "style").collect()}
    want = {}
    for k, (at, g, _) in enumerate(rows):
        want.setdefault((f"2024-01-01 {at[11:13]}:00:00", g), []).append(scores[k])
    assert set(got) == set(want)  # windows close when the later file moves the watermark past them
    for key, own in want.items():
        assert got[key][:2] == (len(own), sum(s >= 0.65 for s in own)) and got[key][2] == pytest.approx(sum(own) / len(own))


def test_pdf_blocks(monkeypatch):
    class Page:
        def __init__(self, blocks):
            self.blocks = blocks

        def get_text(self, kind, sort):
            assert (kind, sort) == ("blocks", True)
            return self.blocks

    class Document(list):
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    def opened(stream, filetype):
        assert (stream, filetype) == (b"%PDF", "pdf")
        return Document([Page([(0, 0, 1, 1, "Uno\n dos ", 0, 0), (0, 0, 1, 1, "<image>", 1, 1)]), Page([(0, 0, 1, 1, "Tres", 0, 0)])])

    fake = types.ModuleType("fitz")
    fake.open = opened
    monkeypatch.setitem(sys.modules, "fitz", fake)
    assert files.pdf_paragraphs(b"%PDF") == ["Uno dos", "Tres"]


def test_a_pdf_without_the_library_is_a_row_with_an_error(spark, tmp_path):
    if "fitz" in sys.modules:
        pytest.skip("the library is here")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    (row,) = files.read_files(spark, f"file://{tmp_path}").collect()
    assert row.text in (None, "") and row.error == "PDF support needs PyMuPDF"


def test_reports_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = " ".join(TEXTS[:2] * 5)
    (tmp_path / "in" / "1.json").write_text(json.dumps({"doc_id": 7, "text": text}))
    stream = spark.readStream.schema("doc_id long, text string").json(str(tmp_path / "in"))
    query = analysis.stream_reports(stream).select("doc_id", "p", F.size("sentences").alias("n")).writeStream.format("memory").queryName("reports").start()
    try:
        query.processAllAvailable()
        (row,) = spark.table("reports").collect()
    finally:
        query.stop()
    assert row.doc_id == 7 and 0 < row.p < 1 and row.n == 25
