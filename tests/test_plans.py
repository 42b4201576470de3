"""Plans compute what is dear once, and rows of long texts take time in proportion."""

import html
import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from glyphmill import queries as own
from glyphmill.functions import scores as S, text as T
from glyphmill.operators import models as M, overlap as V, signals as G, style as O
from glyphmill.plans.report import report

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["style_features", "lexicon_hits", "report_rows", "sentence_split", "sentence_scores", "overlap_matches", "signal_report"])
def test_sentences_are_split_once_for_each_scan(spark, name):
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 27))
    plan = own.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    splits, scans = plan.count("(?=[.!?…])"), plan.count("Relation [")
    assert 1 <= splits <= scans


LONG = " ".join(f"palabra{i}x de la casa{i % 977}." for i in range(5_000))  # 20,000 words, most of them once


@pytest.mark.parametrize(
    ("name", "make"),
    [
        ("ngrams", lambda c: F.size(V.grams(c))),
        ("keywords", lambda c: F.size(V.keywords(F.translate(c, "0123456789", "abcdefghij")))),
        ("mattr", lambda c: T.mattr(T.lower_words(c))),
        ("sentences", lambda c: F.size(T.sentences(c))),
        ("windows", lambda c: F.size(G.row_sentence_scores(own.fixed_tokens(c), T.sentences(c)))),
    ],
)
def test_a_long_text_takes_time_in_proportion(spark, name, make):
    def seconds(times):
        rows = spark.createDataFrame([(" ".join([LONG] * times),)], "t string")
        rows.select(make(F.col("t"))).collect()
        began = time.time()
        rows.select(make(F.col("t"))).collect()
        return time.time() - began

    one, four = seconds(1), seconds(4)
    assert one < 10 and four < 10 * max(one, 0.3)


def test_a_long_report(spark):
    text = "\n\n".join(f"Frase número {i} de la casa. Otra frase más corta {i}. Y la tercera de todas, que es algo más larga." for i in range(2_500))
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    r = report(rows).first()
    assert len(r.paragraphs) == 2_500 and len(r.sentences) == 7_500 and time.time() - began < 60
    assert "\n\n".join(p.text for p in r.paragraphs) == r.text


def column(spark, texts, make):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    return [r[1] for r in sorted(rows.select("i", make(F.col("t"))).collect())]


def test_folding_is_the_compatibility_decomposition(spark):
    rnd = random.Random(4)
    texts = ["Ñandú º ﬁn ² ß Čš ő ½ Ⅳ ㎜ 𝐀b ŉ ĳ Ǆ", "İ", ""] + ["".join(chr(rnd.choice([rnd.randrange(32, 0x250), rnd.randrange(0x1E00, 0x2200)])) for _ in range(20)) for _ in range(300)]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
    assert column(spark, texts, T.fold) == [plain(t) for t in texts]


def test_entities_are_what_browsers_read(spark):
    rnd = random.Random(1)
    parts = ["&", "#", "x", "1", "6", "5", ";", "amp", "lt", "not", "in", "copy", " ", "a", "&#x1F600;", "&nbsp", "&eacute;", "&#233;"]
    texts = ["&amp;lt; &notit; &#xD800; &#128; &bogus; & &; &#; &#x; &#99999999999; &#65534;", "plain", "&#0;&#13;"] + ["".join(rnd.choice(parts) for _ in range(12)) for _ in range(500)]
    assert column(spark, texts, T.unescape) == [html.unescape(t) for t in texts]


def test_rounding_near_ties(spark):
    rnd = random.Random(1)
    values = [k / 10**4 + 5 * 10**-4 for k in range(-500, 1500)] + [k / 2**j for j in range(1, 14) for k in range(150)] + [rnd.random() for _ in range(300)] + [1e-9, 0.0, 12345.6785, 1e12]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    for digits in (2, 3, 4):
        assert [r[1] for r in sorted(rows.select("i", S.exact_round(F.col("x"), digits)).collect())] == [round(x, digits) for x in values]


def test_runs_and_bisection(spark):
    rows = spark.createDataFrame([([1, 1, 2, 2, 2, 3],), ([],), ([5],)], "x array<int>")
    got = rows.select(T.runs(F.col("x"), lambda v: v).alias("r"), T.bisect(F.size("x"), lambda i: F.get("x", i) >= 2).alias("b")).collect()
    assert [(r.r, r.b) for r in got] == [([[1, 1], [2, 2, 2], [3]], 2), ([], 0), ([[5]], 0)]


def test_predicates_and_sets(spark):
    assert column(spark, ["Se habla ESPAÑOL", None, "english"], lambda c: T.contains_any(c, "spanish", "español")) == [True, False, False]
    row = spark.createDataFrame([(["a", "b", "c"], ["c", "a", "x"])], "m array<string>, t array<string>").select(V.compared(F.col("m"), F.col("t")).alias("c")).first().c
    assert (row.shared, row.only_mine, row.share) == (["a", "c"], ["b"], 2 / 3)


def test_more_features_can_be_compared(spark):
    rnd = random.Random(7)
    rows = [(i % 3, float(y := rnd.random() < 0.5), rnd.random(), (0.7 if y else 0.3) + rnd.gauss(0, 0.2)) for i in range(240)]
    frame = spark.createDataFrame(rows, "fold int, y double, a double, b double").cache()
    got = {r.features: r for r in M.compare_features(frame, ["a"], ["b"], "y", k=3).collect()}
    assert got["with extra"].auroc > got["base"].auroc + 0.2 and got["base"].n == 240
    fixed = M.fixed_weights(spark.createDataFrame([(0.5, 0.9, 0.1)], "l double, c double, s double"), "l", "c", "s").first().fixed_p
    assert abs(fixed - (0.5 * 0.5 + 0.3 * 0.9 + 0.2 * 0.1)) < 1e-12


def test_switched_off_models_are_absent(spark):
    from glyphmill.config import EngineConfig

    text = "Una frase de la casa que no dice nada. " * 20
    signal = spark.createDataFrame([(0, 0.7, 0.9, 0.8, True, 0.99, 0.95, [0.99])], "doc_id long, lm_score double, lm_p double, threshold_low_fpr double, calibrated boolean, classifier_p double, meta_p double, sentence_p array<double>")
    rows = spark.createDataFrame([(0, text)], "doc_id long, text string")
    of = lambda **k: report(rows, signals=signal, config=EngineConfig(**k)).first()
    assert of().p == 0.95
    none = of(use_token_stats=False, use_classifier=False)
    assert none.p == none.signals["style"] and none.signals.lm_p is None and none.signals.classifier_p is None
    assert of(use_token_stats=False).signals.lm_score is None and of(use_classifier=False).signals.classifier_p is None



def test_token_statistics_do_not_sort_words(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = own.token_statistics(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan



def test_mattr_sorts_numbers_and_words_only_where_hashes_meet(spark):
    rng = random.Random(4)
    texts = [[f"w{rng.randrange(k)}" for _ in range(n)] for n, k in ((1, 1), (50, 9), (51, 9), (400, 30), (3_000, 2_000))]
    brute = lambda t: sum(len(set(t[i : i + 50])) for i in range(len(t) - 49)) / (len(t) - 49) / 50 if len(t) > 50 else len(set(t)) / len(t)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t array<string>").repartition(1)
    made = rows.select("k", T.mattr(F.col("t")).alias("m"))
    assert all(abs(r.m - brute(texts[r.k])) < 1e-12 for r in made.collect())
    assert "xxhash64" in made._jdf.queryExecution().optimizedPlan().toString()


def test_dear_lookbehinds_of_sentence_ends_come_after_cheap_lookaheads(spark):
    assert T.SENTENCE_END.count(r"(?!(?=\.") == 2
    texts = ["Vale 3. 4 y 5. Fin", "El Sr. Paz vino. ¿Sí?! Sí.", "a  b\t\tc.\n\n\n\nd\x01e\x02f. G", "Es así... Fin.\n2\n. 3 x. Y. z", "?!", ""]
    old = spark.createDataFrame([(t,) for t in texts], "t string").select(F.translate("t", "?!", "").alias("p"), T.asks(F.col("t")).alias("n"), F.length("t").alias("len"), T.normalize(F.col("t")).alias("w"), F.regexp_replace(F.regexp_replace("t", r" [ \t]+|\t[ \t]*", " "), r"\n{3,}", "\n\n").alias("o"))
    assert all(r.n == r.len - len(r.p) and r.w == r.o.strip() for r in old.collect())


@pytest.mark.parametrize("name", ["report_rows", "overlap_matches"])
def test_filters_do_not_compute_words_a_second_time(spark, name):
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 27))
    plan = own.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan()
    filters = [str(f.condition().toString()) for f in _nodes(plan) if f.nodeName() == "Filter"]
    assert filters and not any("regexp" in f for f in filters)


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))
