"""What keeps time and memory in proportion to the input: plans and bounds."""

from __future__ import annotations

import tracemalloc
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from glyphmill import round_trips as R
from glyphmill.functions import text as T
from glyphmill.operators import classifier as K, corpus as C, signals as G
from glyphmill.plans.partitioning import gathered
from glyphmill.sources import files


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_of_all_kinds_are_scanned_once(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"{k}.txt").write_text(f"text {k}")
    (tmp_path / "a.docx").write_bytes(R._docx(["one two", "three"]))
    (tmp_path / "b.docx").write_bytes(b"damaged")
    (tmp_path / "c.csv").write_text("x")
    read = files.read_files(spark, f"file://{tmp_path}")
    assert plan_of(read).count("FileScan binaryFile") == 1
    found = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in read.collect()}
    assert len(found) == 43 and found["7.txt"] == ("text 7", None) and found["a.docx"][0].startswith("one two\n\nthree") and found["a.docx"][1] is None
    assert found["b.docx"] == (None, "cannot read .docx: BadZipFile") and found["c.csv"] == (None, "unsupported format: .csv")


def test_many_small_files_share_tasks(spark):
    many = spark.range(100, numPartitions=400)
    assert gathered(many).rdd.getNumPartitions() == 25 and gathered(many).count() == 100
    few = spark.range(10, numPartitions=6)
    assert gathered(few).rdd.getNumPartitions() == 6


def test_rewrites_are_compared_pair_by_pair():
    texts = pd.Series([" ".join(f"word{(i * j) % 997}" for j in range(2000)) for i in range(1, 121)])
    tracemalloc.start()
    C._changes(texts, texts.str.slice(0, 100))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20  # words of all pairs at once take over 12 MB


def test_features_go_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 31}" for j in range(i))) for i in range(40)] + [(99, None)], "i int, text string").coalesce(1)
    rows = lambda df: sorted((r["i"], tuple(r["at"]), tuple(r["count"])) for r in df.collect())
    whole, scored = rows(K.featured(docs, ["i"])), K.GramClassifier(np.arange(K.DIM) % 7 - 3.0, 0.5)
    p = {r["i"]: r["p"] for r in scored.scored(K.featured(docs, ["i"]), ["i"]).collect()}
    monkeypatch.setattr(K, "MOST", 50)
    assert rows(K.featured(docs, ["i"])) == whole
    again = {r["i"]: r["p"] for r in scored.scored(K.featured(docs, ["i"]), ["i"]).collect()}
    assert p.keys() == again.keys() and all(abs(p[i] - again[i]) < 1e-12 for i in p)
    b = pa.RecordBatch.from_pydict({"at": [[1] * n for n in (0, 10, 30, 20, 0, 120, 5, 0)]})
    parts = list(K._parts(b))
    assert sum(x.num_rows for x in parts) == 8 and len(parts) > 2 and pa.concat_tables([pa.Table.from_batches([x]) for x in parts]).column("at").to_pylist() == b.column("at").to_pylist()


def test_archives_are_of_bounded_size(spark, tmp_path):
    frame = pd.DataFrame({"id": [str(i) for i in range(30)], "essay": [None if i % 5 == 0 else f"{i} " * 400 for i in range(30)], "lang": "en"})
    made = list(R._archives(frame, most=3000))
    assert len(made) > 5
    for name, raw in made:
        (tmp_path / name).write_bytes(raw)
        with zipfile.ZipFile(tmp_path / name) as z:
            assert len(z.namelist()) == 3
    back = files.zipped_csv(spark, f"file://{tmp_path}", ["id", "essay", "home"], required="essay").collect()
    assert {r["id"]: r["essay"] for r in back} == {i: e for i, e in zip(frame["id"], frame["essay"], strict=True) if e} and {r["home"] for r in back} == {None}


def test_indices_of_works_are_computed_once(spark):
    docs = spark.createDataFrame([(1, "a &lt;b a", "s"), (2, "", "s"), (3, None, "s")], "doc_id long, text string, source string")
    made = R.works(docs)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_entries") == 1
    assert [(r["url"], r["kind"]) for r in made.collect()] == [("id:1", "OpenAlex")]


def test_running_sums_of_any_length(spark):
    sizes = [0, 1, 3, 4, 5, 63, 64, 65, 128, 1000, 70_000]
    rows = spark.createDataFrame([(n, [i % 9 for i in range(n)]) for n in sizes], "n int, x array<int>")
    for n, got, low in rows.select("n", T.running("x"), T.scanned(F.transform("x", lambda v: -v), F.least)).collect():
        assert got == np.cumsum([i % 9 for i in range(n)]).tolist() and low == [-min(i, 8) for i in range(n)]


def test_sentences_and_tokens_are_merged_not_searched(spark):
    tokens, sents = [(k * 3, float(k % 5 + 1), float(k % 7 + 1)) for k in range(200)], [2, 2, 9, 30, 31, 32, 300, 900]
    rows = spark.createDataFrame([(tokens, [(s,) for s in sents]), ([], [(0,)]), (tokens, [])], "t array<struct<start:int,ppl:double,xppl:double>>, s array<struct<start:int>>")
    scored = rows.select(G.row_sentence_scores(F.col("t"), F.col("s")).alias("r"))
    assert "sort_array(concat(" in scored._jdf.queryExecution().optimizedPlan().toString()
    first, empty, none = (r["r"] for r in scored.collect())
    own = [[t for t in tokens if max((k for k, s in enumerate(sents) if s <= t[0]), default=-1) == i] for i in range(len(sents))]
    for i, r in enumerate(first):
        radius = next((k for k in range(len(sents)) if sum(map(len, own[max(0, i - k) : i + k + 1])) >= 30), len(sents))
        inside = [t for part in own[max(0, i - radius) : i + radius + 1] for t in part]
        assert r["sent_id"] == i and r["n_tokens"] == len(inside) and abs(r["score"] - sum(t[1] for t in inside) / sum(t[2] for t in inside)) < 1e-12
    assert [tuple(r) for r in empty] == [(0, 0, 0, 0, None)] and none == []
