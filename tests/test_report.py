"""Style, report, guidance, signals."""

import math

import pytest
from pyspark.sql import functions as F

from glyphmill.config import EngineConfig
from glyphmill.functions import scores as S
from glyphmill.operators import signals as G, style as O
from glyphmill.plans.report import rejected, report

HUMAN = ("Ayer fui al mercado con mi tía. ¡Qué calor! Compramos tomates, dos sandías enormes y, como siempre, más pan del que íbamos a comer en toda la semana, porque ella nunca calcula bien. ¿Y tú?\n\n"
         "Luego nos sentamos. El viejo del puesto contaba historias larguísimas de cuando el río llegaba hasta la plaza y los niños pescaban desde las ventanas; yo no me creo ni la mitad. Mi tía sí. Se rio tanto que casi tira el café, y "
         "después, ya de vuelta, discutimos un rato sobre si valía la pena arreglar la persiana rota o esperar a que mi primo venga en agosto con las herramientas que le presté hace dos años.")
MACHINE = ("En resumen, cabe destacar que el estudio es importante hoy. Además, es fundamental considerar el contexto actual siempre. Por lo tanto, juega un papel clave en la sociedad. Finalmente, un aspecto clave es la educación moderna.\n\n"
           "Asimismo, en el mundo actual existen desafíos y oportunidades diversas. Sin embargo, es crucial reconocer su enorme impacto social. En consecuencia, a medida que avanza todo cambia mucho. Por último, de manera integral se logra este objetivo.")


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_styles_separate(spark):
    rows = {r.doc_id: r for r in O.features(O.prepare(docs(spark, HUMAN, MACHINE))).collect()}
    assert rows[0]["style"] < 0.35 < 0.65 < rows[1]["style"]
    assert rows[0].features.paragraph_variation is None and rows[1].features.connector_share > 0.5
    assert len(rows[1].style_reasons) == 3


def test_report_shape(spark):
    text = MACHINE + "\n\n" + HUMAN
    r = report(docs(spark, text)).first()
    assert [p.paragraph for p in r.paragraphs] == [0, 1, 2, 3]
    assert "\n\n".join(p.text for p in r.paragraphs) == r.text
    assert all(r.text[s.start : s.end] == s.text for s in r.sentences)
    assert 0 <= r.flagged_fraction <= 1 and r.confidence == "baja" and r.verdict
    assert r.paragraphs[0].reasons and len(r.warnings) == 2


def test_short_texts_are_rejected(spark):
    rows = docs(spark, "muy corto", None, HUMAN * 2)
    assert [r.doc_id for r in report(rows).collect()] == [2]
    assert {r.doc_id: r.message for r in rejected(rows).collect()}[0] == "El texto es demasiado corto (2 palabras). Se necesitan al menos 80."


def test_truncation_warning(spark):
    r = report(docs(spark, "palabra " * 200), config=EngineConfig(max_chars=1000)).first()
    assert len(r.text) <= 1000 and any("1,000" in w for w in r.warnings)


def test_titles_never_exceed_the_document(spark):
    title, long = "Objetivo general", " ".join(["palabra común de relleno"] * 30) + "."
    text = f"{title}\n\n{long}\n\n{HUMAN}"
    signal = spark.createDataFrame([(0, 0.7, 0.5, 0.8, True, None, None, [0.99, 0.99] + [0.1] * 12)], "doc_id long, lm_score double, lm_p double, threshold_low_fpr double, calibrated boolean, classifier_p double, meta_p double, sentence_p array<double>")
    r = report(docs(spark, text), signals=signal).first()
    assert r.sentences[0].p <= r.p and r.sentences[1].p == 0.99
    assert r.reasons[0].startswith("El texto es muy predecible")


def test_inflated_classifier_is_not_cited(spark):
    signal = spark.createDataFrame([(0, None, None, None, None, 0.99)], "doc_id long, lm_score double, lm_p double, threshold_low_fpr double, calibrated boolean, classifier_p double")
    r = report(docs(spark, HUMAN * 2), signals=signal).first()
    assert r.p < 0.65 and not any("clasificador" in x for x in r.reasons) and any("modelo principal" in w for w in r.warnings)


def test_nulls_stay_null(spark):
    row = spark.range(1).select(S.sigmoid(F.lit(None).cast("double")).alias("a"), S.logit(F.lit(None).cast("double")).alias("b"), S.sentence_score(F.lit(None).cast("double"), F.lit(1)).alias("c"), S.sigmoid(F.lit(1e9)).alias("d")).first()
    assert row.a is None and row.b is None and row.c is None and abs(row.d - 1) < 1e-15


def test_exact_rounding(spark):
    rows = spark.createDataFrame([(0.0125,), (0.0625,), (1.0005,), (None,)], "x double")
    assert [r[0] for r in rows.select(S.exact_round(F.col("x"), 3)).collect()] == [round(0.0125, 3), round(0.0625, 3), round(1.0005, 3), None]


def test_meta_is_even_at_the_mean(spark):
    array = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    p = S.stacked([F.lit(0.9), F.lit(0.3)], array(1, 2), F.lit(0.0), array(0.9, 0.3), array(1, 1))
    assert spark.range(1).select(p).first()[0] == 0.5


def test_sentence_windows_widen_until_enough_tokens(spark):
    counts = [3, 10, 2, 40, 1]
    sents = spark.createDataFrame([(1, i, 100 * i) for i in range(5)], "doc_id long, sent_id int, start int")
    tokens = [(1, k, 100 * i + j, 100 * i + j + 1, float(1 + (k * 7) % 5), float(1 + k % 3)) for k, (i, j) in enumerate((i, j) for i, n in enumerate(counts) for j in range(n))]
    frame = spark.createDataFrame(tokens, G.TOKENS)
    got = {r.sent_id: r for r in G.sentence_scores(G.assign(frame, sents), sents).collect()}
    of = [i for i, n in enumerate(counts) for _ in range(n)]
    for i in range(5):
        lo = hi = i
        while sum(counts[lo : hi + 1]) < 30 and (lo > 0 or hi < 4):
            lo, hi = max(lo - 1, 0), min(hi + 1, 4)
        mine = [t for t, s in zip(tokens, of, strict=True) if lo <= s <= hi]
        assert got[i].n_tokens == len(mine)
        assert math.isclose(got[i].score, sum(t[4] for t in mine) / sum(t[5] for t in mine))


def test_calibration_fallbacks(spark):
    rows = spark.createDataFrame([(0, "es"), (1, "en")], "doc_id long, lang string")
    found = spark.createDataFrame([("es", "m", -9.0, 8.0, 0.8)], "lang string, model_id string, slope double, intercept double, threshold_low_fpr double")
    own = {r.doc_id: r for r in G.calibrations(rows, found, "m").collect()}
    assert (own[0].slope, own[0].calibrated, own[1].slope, own[1].calibrated) == (-9.0, True, -9.0, False)
    other = {r.doc_id: r for r in G.calibrations(rows, found, "x").collect()}
    assert {r.slope for r in other.values()} == {-30.0} and not any(r.calibrated for r in other.values())
    assert G.calibrations(rows, None, "m").first().intercept == 27.0


@pytest.mark.parametrize("n", [0, 1, 2, 382, 383, 476, 477, 478, 1000])
def test_windows_and_chunks(spark, n):
    w, c = spark.range(1).select(G.lm_windows(F.lit(n)), G.classifier_chunks(F.lit(n))).first()
    assert sorted(i for x in w for i in range(x.start, x.end)) == list(range(1, n))
    want = [(s, min(s + 382, n)) for s in range(0, max(n, 1), 382)]
    if len(want) > 1 and n - want[-1][0] < 95:
        want[-1] = (n - 382, n)
    assert [tuple(x) for x in c] == want


def test_row_scores_are_ratios_of_means(spark):
    t = [(k, k, k + 1, 3.0, x) for k, x in enumerate((3.0, 3.0, 4.0))]  # sums have the ratio 0.9, means one next to it
    kind = "array<struct<pos:int,start:int,end:int,ppl:double,xppl:double>>"
    rows = spark.createDataFrame([(0, t), (1, [])], f"doc_id long, t {kind}")
    by_row = {r.doc_id: r.s for r in rows.select("doc_id", G.row_score(F.col("t")).alias("s")).collect()}
    (other,) = G.document_scores(rows.select("doc_id", F.explode("t").alias("x")).select("doc_id", "x.*")).collect()
    assert by_row == {0: other.lm_score, 1: None} and other.lm_score < 0.9
