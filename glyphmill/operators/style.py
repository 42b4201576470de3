"""Documents to sentences and style features, inside each row: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as L
from ..config import EngineConfig
from ..functions import scores as S, text as T


def prepare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: EngineConfig = EngineConfig(), lexicons: dict[str, L.Lexicon] | None = None, lang: str | None = None) -> DataFrame:
    """(id, raw_chars, text, n_words, lang, tokens, sents): sents is an array of (paragraph, start, end, text, n, hits, connector, asks)."""
    base = docs.select(F.col(id_col), F.length(text_col).alias("raw_chars"), T.truncate(T.normalize(F.coalesce(F.col(text_col), F.lit(""))), config.max_chars).alias("text"))
    base = base.withColumn("tokens", T.lower_words(F.col("text")))
    is_en = T.members(F.col("tokens"), L.STOP_EN) > T.members(F.col("tokens"), L.STOP_ES)
    base = base.withColumns({"n_words": F.size("tokens"), "lang": F.lit(lang) if lang else F.when(is_en, "en").otherwise("es"), "__s": T.sentences(F.col("text"))})
    return base.withColumn("sents", sentence_details(F.col("__s"), F.col("lang"), lexicons)).drop("__s")


def sentence_details(sents: Column, lang: Column, lexicons: dict[str, L.Lexicon] | None = None) -> Column:
    def one(s: Column, lang: Column) -> Column:
        t = s["text"]
        return F.struct(
            s["paragraph"].alias("paragraph"), s["start"].alias("start"), s["end"].alias("end"), t.alias("text"), F.size(T.words(t)).alias("n"),
            T.by_language(lang, lambda x: T.phrase_hits(t, x), lexicons).alias("hits"), T.by_language(lang, lambda x: T.connector(t, x), lexicons).alias("connector"), T.asks(t).alias("asks"),
        )

    return T.let(lang, lambda x: F.transform(sents, lambda s: one(s, x)))


def total(array: Column, value=lambda x: x) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(value(x), F.lit(0)).cast("long"))


def variation(counts: Column) -> Column:
    """Population standard deviation over mean of an array of numbers; 0 for fewer than two, or a mean of 0."""

    def of(x: Column, mean: Column) -> Column:
        square = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
        return F.sqrt(square / F.size(x)) / mean

    mean = lambda x: total(x) / F.greatest(F.size(x), F.lit(1))
    return T.let(counts, lambda x: F.when((F.size(x) < 2) | (total(x) == 0), F.lit(0.0)).otherwise(T.let(mean(x), lambda m: of(x, m))))


def paragraph_totals(sents: Column) -> Column:
    """Words of each paragraph that has sentences, in order."""
    return F.transform(T.runs(sents, lambda s: s["paragraph"]), lambda own: total(own, lambda s: s["n"]))


def features(prepared: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """prepared with a struct `features`, the style score `style` and `style_reasons`."""
    s = F.col("sents")
    lens = F.filter(F.transform(s, lambda x: x["n"]), lambda n: n > 0)
    n_sents = F.greatest(F.size(s), F.lit(1))
    rows = prepared.withColumns({
        "__lens": lens,
        "__paras": paragraph_totals(s),
        "__hits": total(s, lambda x: F.size(x["hits"])),
        "__starts": F.size(F.filter(s, lambda x: x["connector"].isNotNull())),
        "__asks": total(s, lambda x: x["asks"]),
    })
    rows = rows.withColumns({
        "__f": F.struct(
            F.col("n_words").alias("words"),
            F.size("__lens").alias("sentences"),
            S.exact_round(F.when(F.size("__lens") > 0, total(F.col("__lens")) / F.greatest(F.size("__lens"), F.lit(1))).otherwise(0.0), 2).alias("mean_length"),
            S.exact_round(variation(F.col("__lens")), 3).alias("burstiness"),
            F.when(F.size("__paras") >= 3, S.exact_round(variation(F.col("__paras")), 3)).alias("paragraph_variation"),
            S.exact_round(T.mattr(F.col("tokens"), config.mattr_window), 3).alias("mattr"),
            S.exact_round(F.col("__hits") * 100.0 / F.greatest(F.col("n_words"), F.lit(1)), 3).alias("phrase_rate"),
            S.exact_round(F.col("__starts") / n_sents, 3).alias("connector_share"),
            F.col("__asks").alias("asks"),
        )
    })
    f = F.col("__f")
    z = S.style_logit(f["burstiness"], f["phrase_rate"], f["connector_share"], f["paragraph_variation"], f["asks"])
    reasons = S.style_reasons(f["burstiness"], f["sentences"], f["phrase_rate"], F.col("__hits"), f["connector_share"], f["paragraph_variation"])
    return rows.withColumns({"features": f, "style": S.sigmoid(z, None), "style_reasons": reasons}).drop("__lens", "__paras", "__hits", "__starts", "__asks", "__f")


def guidance(sents: Column, p: Column) -> Column:
    """(reasons, suggestions) of a paragraph from its sentences and its probability."""
    g = L.GUIDANCE
    phrases = F.sort_array(F.array_distinct(F.transform(F.flatten(F.transform(sents, lambda s: s["hits"])), F.lower)))
    connectors = F.filter(F.transform(sents, lambda s: s["connector"]), lambda x: x.isNotNull())
    lens = F.transform(sents, lambda s: s["n"])
    # the mean counts as 1 at least here, and sentences without words count
    spread = T.let(lens, lambda x: T.let(total(x) / F.greatest(F.size(x), F.lit(1)), lambda m: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.greatest(F.size(x), F.lit(1))) / F.greatest(m, F.lit(1.0))))
    a, b = g["phrases"][0].split("{list}")
    listed = F.concat(F.lit(a), F.array_join(F.transform(F.slice(phrases, 1, 6), lambda x: F.concat(F.lit("«"), x, F.lit("»"))), ", "), F.lit(b))
    c, d = g["connectors"][0].removeprefix("{n}").split("{list}")
    chained = F.concat(F.size(connectors).cast("string"), F.lit(c), F.array_join(F.slice(connectors, 1, 4), ", "), F.lit(d))
    has, many, even = F.size(phrases) > 0, F.size(connectors) >= 2, (F.size(sents) >= 3) & (spread < 0.3)
    own = S._all(F.when(has, listed), F.when(many, chained), F.when(even, g["rhythm"][0]))
    reasons = F.when((p >= 0.65) & (F.size(own) == 0), F.array(F.lit(g["predictable"]))).otherwise(own)
    tips = S._all(F.when(has, g["phrases"][1]), F.when(many, g["connectors"][1]), F.when(even, g["rhythm"][1]), F.when(p >= 0.35, g["voice"]))
    return F.struct(reasons.alias("reasons"), tips.alias("suggestions"))
