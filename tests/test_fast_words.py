"""Folding and back-off counts look at all of a text a few times only."""

import random
import time
import unicodedata

from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill import queries as Q
from glyphmill.operators import backoff as B, signals as G


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def test_folding_of_characters_that_become_several(spark):
    r = random.Random(6)
    marks = "ﬁﬂⅫǆ㎏ﬃĳ℡中Жéa b"
    texts = ["".join(r.choice(marks) for _ in range(n)) for n in range(60)] + ["中" * 50, "ﷺ" * 3 + "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {x.i: x.f for x in rows.select("i", T.fold(F.col("t")).alias("f")).collect()} == {i: plain(t) for i, t in enumerate(texts)}


def test_folding_looks_up_what_is_there(spark):
    rows = spark.createDataFrame([(0, "ﬁn"), (1, "palabra él " * 80_000 + "ﬁn")], "i int, t string")
    rows.where("i = 0").select(T.fold(F.col("t"))).collect()
    began = time.time()
    assert rows.select(F.length(T.fold(F.col("t"))).alias("n")).collect()[1].n == 80_000 * 11 + 3
    assert time.time() - began < 8  # a look-up for each character takes about 20 seconds


def test_back_off_scans_words_for_their_places_only(spark):
    rows = spark.createDataFrame([(0, "uno dos tres dos uno"), (1, "dos tres uno")], "doc_id long, text string")
    plan = B.backoff_statistics(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_windows_count_words_once(spark, tmp_path):
    spark.createDataFrame([(0, "uno dos")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = Q.model_windows(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    for cut in (G.lm_windows, G.classifier_chunks):
        own = spark.range(1).select(cut(F.size(T.words(F.col("id").cast("string")))).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert own.count("regexp_extract_all") == 1
