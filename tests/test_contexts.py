"""Means of back-off statistics, a part of the contexts at a time."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glyphmill import queries as Q
from glyphmill.operators import backoff, contexts, signals


def texts(spark, path):
    r = random.Random(5)
    words = [f"{a}{b}" for a in "bcdfglmn" for b in ("a", "e", "io")]
    rows = [" ".join(r.choices(words, weights=[30, 20, *range(22, 0, -1)], k=r.randrange(1, 90))) for _ in range(60)]
    rows += [rows[0], rows[1], "la", "La la LA la", "", "12 . 34", None, "El día, el año: l'aigua d'or"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    docs.write.parquet(f"{path}/documents.parquet")
    return docs


def by_words(tokens):
    return {r.doc_id: (r.n, r.ppl, r.xppl) for r in tokens.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg("ppl").alias("ppl"), F.avg("xppl").alias("xppl")).collect()}


def same(got, wanted):
    got = {r.doc_id: (r.n, r.ppl, r.xppl) for r in got.collect()}
    assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k], rel=1e-9) for k in wanted)


@pytest.mark.parametrize("part", [1 << 22, 400])
def test_means_of_back_off_are_those_of_its_rows(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(contexts, "PART", part)
    docs = texts(spark, tmp_path)
    same(backoff.backoff_means(docs), by_words(backoff.backoff_statistics(docs)))


@pytest.mark.parametrize("part", [1 << 22, 400])
def test_means_of_pairs_are_those_of_their_rows(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(contexts, "PART", part)
    docs = texts(spark, tmp_path)
    same(signals.ngram_means(docs), by_words(signals.ngram_statistics(docs)))


def test_words_of_one_number_get_others(spark, tmp_path, monkeypatch):
    docs = texts(spark, tmp_path)
    real, seeds = contexts.code, []

    def narrow(word, seed):
        seeds.append(seed)
        return F.pmod(real(word, seed), F.lit(5)) if seed == 0 else real(word, seed)

    monkeypatch.setattr(contexts, "code", narrow)
    same(backoff.backoff_means(docs), by_words(backoff.backoff_statistics(docs)))
    assert {0, 1} <= set(seeds)


def test_an_empty_corpus_has_no_means(spark):
    none = spark.createDataFrame([(0, None), (1, "")], "doc_id long, text string")
    assert backoff.backoff_means(none).collect() == [] and signals.ngram_means(none).collect() == []


def files(spark, name=""):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [f for f in found.mkString("\n").split("\n") if "shuffle_" in f and name in f]


@pytest.mark.parametrize("name", ["backoff_statistics", "token_statistics"])
def test_no_rows_of_words_stay_on_disk(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(contexts, "PART", 400)
    texts(spark, tmp_path)
    before = set(files(spark))
    kept = set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("*"))
    plan = Q.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan  # words are not what the result moves
    made = [p for top in set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("*")) - kept for p in top.rglob("*.parquet")]
    assert made and not any("/rows/part=" in str(p) or "/lists/" in str(p) for p in made)
    until = time.time() + 20
    while time.time() < until and len(set(files(spark)) - before) > 12:
        time.sleep(0.5)
    assert len(set(files(spark)) - before) <= 12
