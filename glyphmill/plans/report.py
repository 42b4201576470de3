"""The report of a document as one nested row. Signals are optional tables; what is missing is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as L
from ..config import EngineConfig
from ..functions import scores as S, text as T
from ..operators import style as O


def sentence_rows(sents: Column, probs: Column, doc_p: Column, config: EngineConfig) -> Column:
    """Sentences with `p`, by paragraph: an array of arrays, the short-paragraph cap applied. probs: their probabilities, by position."""
    kept = ("paragraph", "start", "end", "text", "n", "hits", "connector")
    scored = T.let(probs, lambda p: F.transform(sents, lambda s, i: F.struct(*[s[k].alias(k) for k in kept], F.get(p, i).alias("p"))))
    capped = lambda own, n, d: F.transform(own, lambda s: s.withField("p", S.capped(s["p"], n, d, config)))
    one = lambda own, d: T.let(O.total(own, lambda s: s["n"]), lambda n: capped(own, n, d))
    return T.let(doc_p, lambda d: F.transform(T.runs(scored, lambda s: s["paragraph"]), lambda own: one(own, d)))


def paragraph_rows(groups: Column, text: Column, config: EngineConfig) -> Column:
    """(paragraph, text, p, level, guidance) of each paragraph; p weighs sentences by their words. groups: sentences by paragraph."""

    def one(own: Column, bodies: Column) -> Column:
        k = F.get(own, F.lit(0))["paragraph"]
        weight = O.total(own, lambda s: F.greatest(s["n"], F.lit(1)))
        p = F.aggregate(own, F.lit(0.0), lambda a, s: a + s["p"] * F.greatest(s["n"], F.lit(1))) / weight
        # a paragraph's text runs from its first sentence to its last, which is all but white space at its ends
        return T.let(p, lambda q: F.struct(k.alias("paragraph"), T.strip(F.get(bodies, k)).alias("text"), q.alias("p"), S.level(q, config).alias("level"), O.guidance(own, q).alias("guidance")))

    return T.let(T.paragraphs(text), lambda bodies: F.transform(groups, lambda own: one(own, bodies)))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: EngineConfig = EngineConfig(), signals: DataFrame | None = None, lexicons: dict[str, L.Lexicon] | None = None) -> DataFrame:
    """One nested report per document of min_words words or more; see rejected() for the others.

    signals: optional (id, lm_score, lm_p, threshold_low_fpr, calibrated, classifier_p, meta_p, sentence_p), any of
    them null; sentence_p holds a probability by sentence position. Without them every sentence carries the style score.
    config.use_token_stats and use_classifier switch a model's signals off, as if it were not there.
    """
    prepared = O.prepare(docs, id_col, text_col, config, lexicons)
    # as one generated value, else the filter goes down to where it would count words a second time
    whole = T.computed(prepared, **{k: F.col(k) for k in prepared.columns}).where(F.col("n_words") >= config.min_words)
    rows = O.features(whole, config)
    named = {"lm_score": "double", "lm_p": "double", "threshold_low_fpr": "double", "calibrated": "boolean", "classifier_p": "double", "meta_p": "double", "sentence_p": "array<double>"}
    if signals is None:
        rows = rows.withColumns({k: F.lit(None).cast(v) for k, v in named.items()})
    else:
        have = signals.select(F.col(id_col), *[(F.col(k) if k in signals.columns else F.lit(None)).cast(v).alias(k) for k, v in named.items()])
        rows = rows.join(have, id_col, "left")
    off = F.lit(None).cast("double")
    clf = F.when(F.col("lang") == "es", F.col("classifier_p")) if config.use_classifier else off
    rows = rows.withColumns({"classifier_p": clf, "meta_p": F.col("meta_p") if config.use_classifier and config.use_token_stats else off})
    if not config.use_token_stats:  # as if the model were not there
        rows = rows.withColumns({"lm_score": off, "lm_p": off, "sentence_p": F.lit(None).cast("array<double>")})
    rows = rows.withColumn("p", S.combine(F.col("lm_p"), F.col("classifier_p"), F.col("style"), F.col("meta_p")))
    score = lambda s, i, own, style: F.coalesce(S.sentence_score(F.get(own, i), F.size(s["hits"])), style)
    scored = T.let(F.col("style"), lambda style: T.let(F.col("sentence_p"), lambda own: F.transform("sents", lambda s, i: score(s, i, own, style))))
    rows = rows.withColumn("groups", sentence_rows(F.col("sents"), scored, F.col("p"), config))
    rows = rows.withColumns({"rows": F.flatten("groups"), "paragraphs": paragraph_rows(F.col("groups"), F.col("text"), config)})
    flagged = O.total(F.filter(F.col("rows"), lambda s: s["p"] >= config.level_high), lambda s: s["n"]) / F.greatest(O.total(F.col("rows"), lambda s: s["n"]), F.lit(1))
    has_lm, has_clf = F.col("lm_p").isNotNull(), F.col("classifier_p").isNotNull()
    return rows.select(
        id_col,
        F.col("text"),
        F.col("lang"),
        S.exact_round(F.col("p"), 3).alias("p"),
        S.verdict(F.col("p"), config).alias("verdict"),
        S.confidence(F.col("n_words"), has_lm | has_clf, F.col("p"), F.col("style"), config).alias("confidence"),
        S.exact_round(flagged, 3).alias("flagged_fraction"),
        "n_words",
        F.transform("paragraphs", lambda x: F.struct(x["paragraph"].alias("paragraph"), x["text"].alias("text"), S.exact_round(x["p"], 3).alias("p"), x["level"].alias("level"), x["guidance"]["reasons"].alias("reasons"), x["guidance"]["suggestions"].alias("suggestions"))).alias("paragraphs"),
        F.transform("rows", lambda s: F.struct(s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), s["paragraph"].alias("paragraph"), S.exact_round(s["p"], 3).alias("p"), S.level(s["p"], config).alias("level"), s["hits"].alias("hits"))).alias("sentences"),
        S.all_reasons(F.col("style_reasons"), F.col("lm_score"), F.col("threshold_low_fpr"), F.col("classifier_p"), F.col("p")).alias("reasons"),
        F.struct(S.exact_round(F.col("style"), 3).alias("style"), F.col("features"), S.exact_round(F.col("lm_score"), 4).alias("lm_score"), S.exact_round(F.col("lm_p"), 3).alias("lm_p"), "threshold_low_fpr", "calibrated", S.exact_round(F.col("classifier_p"), 3).alias("classifier_p")).alias("signals"),
        S.warnings(F.col("n_words"), F.col("raw_chars"), F.col("lang"), F.coalesce("calibrated", F.lit(False)), has_lm, has_clf, config).alias("warnings"),
        F.lit(L.LEGAL_NOTE).alias("legal_note"),
    )


def rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: EngineConfig = EngineConfig()) -> DataFrame:
    """(id, message) of documents that are too short to report on."""
    n = F.size(T.words(T.truncate(T.normalize(F.col(text_col)), config.max_chars)))
    return docs.select(id_col, S.too_short(n, config).alias("message")).where(F.col("message").isNotNull())
