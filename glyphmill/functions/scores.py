"""Score functions as Spark columns: probabilities, levels, verdicts, reasons, warnings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import lexicon as L
from ..config import EngineConfig
from .text import let

CONFIG = EngineConfig()


def sigmoid(z: Column, limit: float | None = 50.0) -> Column:
    """1 / (1 + e^-z), z clamped to [-limit, limit] unless limit is None; null for null (least and greatest skip nulls)."""
    held = z if limit is None else F.greatest(F.least(z, F.lit(limit)), F.lit(-limit))
    return F.when(z.isNotNull(), F.lit(1.0) / (F.lit(1.0) + F.exp(-held)))


def logit(p: Column, eps: float = 1e-4) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.when(p.isNotNull(), F.ln(q / (1 - q)))


def exact_round(c: Column, digits: int) -> Column:
    """Half-even on the exact binary value, as IEEE libraries print it; the built-in rounds the shortest decimal, half up.

    Both agree unless the scaled value is next to a tie. There the value is an integer over a power of two, so
    whole numbers decide. Values that take ten digits or more are left to the built-in.
    """
    unit = 10**digits

    def exact(x: Column, e: Column) -> Column:
        # x = m / 2 ** e with m an integer below 2 ** 54; 2 ** e in two factors, each exact
        m = (x * F.pow(F.lit(2.0), e)).cast("long").cast("decimal(18,0)")
        half = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k).cast("decimal(19,0)")
        power = (half(F.shiftright(e, 1)) * half(e - F.shiftright(e, 1))).cast("decimal(25,0)")
        whole = F.floor(x * unit)
        over = (m * F.lit(2 * unit).cast("decimal(10,0)")).cast("decimal(38,0)") - ((whole * 2 + 1).cast("decimal(13,0)") * power).cast("decimal(38,0)")
        return let(over, lambda o: (whole.cast("double") + F.when(o > 0, 1).when(o < 0, 0).otherwise((whole % 2).cast("int"))) / unit)

    def one(v: Column) -> Column:
        size = F.abs(v)
        tie = (size > 1e-6) & (size * unit < float(1 << 31)) & (F.abs(size * unit - F.floor(size * unit) - 0.5) < 1e-6)
        settled = let(F.greatest(F.lit(52) - F.floor(F.log2(size)).cast("int"), F.lit(0)), lambda e: F.signum(v) * exact(size, e))
        return F.when(tie, settled).otherwise(F.round(v, digits))

    return let(c.cast("double"), one)


def style_logit(burst: Column, rate: Column, connectors: Column, paragraphs: Column, asks: Column, w: L.StyleWeights = L.StyleWeights()) -> Column:
    """Of rounded features; paragraphs may be null."""
    z = w.burst[0] * (burst - w.burst[1]) + w.rate[0] * F.least(rate, F.lit(w.rate[1])) + w.base + w.connectors[0] * (connectors - w.connectors[1])
    z = z + F.coalesce(w.paragraphs[0] * (paragraphs - w.paragraphs[1]), F.lit(0.0))
    return z + F.when(asks > 0, w.asks).otherwise(0.0)


def _all(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def style_reasons(burst: Column, n_sentences: Column, rate: Column, n_hits: Column, connectors: Column, paragraphs: Column) -> Column:
    before, after = L.STYLE_REASONS["phrases"].split("{n}")
    return _all(
        F.when((burst < 0.35) & (n_sentences >= 5), L.STYLE_REASONS["uniform_sentences"]),
        F.when(rate >= 1.0, F.concat(F.lit(before), n_hits.cast("string"), F.lit(after))),
        F.when(connectors >= 0.3, L.STYLE_REASONS["connectors"]),
        F.when(paragraphs < 0.2, L.STYLE_REASONS["uniform_paragraphs"]),
    )


def level(p: Column, c: EngineConfig = CONFIG) -> Column:
    return F.when(p < c.level_medium, L.LEVELS[0]).when(p < c.level_high, L.LEVELS[1]).when(p.isNotNull(), L.LEVELS[2])


def verdict(p: Column, c: EngineConfig = CONFIG) -> Column:
    return F.when(p < c.level_medium, L.VERDICTS[0]).when(p < c.level_high, L.VERDICTS[1]).when(p.isNotNull(), L.VERDICTS[2])


def confidence(n_words: Column, has_model: Column, p: Column, style: Column, c: EngineConfig = CONFIG) -> Column:
    sure = (n_words >= c.confident_words) & (F.abs(p - 0.5) > 0.3) & ((p >= 0.5) == (style >= 0.5))
    return F.when(~has_model | (n_words < c.recommended_words), "baja").when(sure, "alta").otherwise("media")


def combine(lm: Column, classifier: Column, style: Column, meta: Column | None = None, m: L.Mixing = L.Mixing()) -> Column:
    """Document probability from what signals there are; the stacked one, if given and not null, wins where both models spoke."""
    all_three = m.lm_classifier_style[0] * lm + m.lm_classifier_style[1] * classifier + m.lm_classifier_style[2] * style
    if meta is not None:
        all_three = F.coalesce(meta, all_three)
    return (
        F.when(lm.isNotNull() & classifier.isNotNull(), all_three)
        .when(lm.isNotNull(), m.lm_style[0] * lm + m.lm_style[1] * style)
        .when(classifier.isNotNull(), m.classifier_style[0] * classifier + m.classifier_style[1] * style)
        .otherwise(style)
    )


def sentence_score(p: Column, n_hits: Column) -> Column:
    """A sentence's probability with a bonus for up to two stock phrases."""
    return F.when(p.isNotNull(), F.least(F.lit(1.0), p + 0.05 * F.least(n_hits, F.lit(2))))


def capped(p: Column, paragraph_words: Column, doc_p: Column, c: EngineConfig = CONFIG) -> Column:
    """Sentences of very short paragraphs (titles) never score above the document."""
    return F.when(paragraph_words < c.min_paragraph_words, F.least(p, doc_p)).otherwise(p)


def all_reasons(style: Column, lm_score: Column, threshold: Column, classifier: Column, doc_p: Column) -> Column:
    first = _all(F.when((classifier >= 0.9) & (doc_p >= 0.65), L.CLASSIFIER_REASON), F.when(lm_score < threshold, L.PREDICTABLE_REASON))
    return F.concat(first, style)


def warnings(n_words: Column, raw_chars: Column, lang: Column, calibrated: Column, has_lm: Column, has_classifier: Column, c: EngineConfig = CONFIG) -> Column:
    w = L.WARNINGS
    return _all(
        F.when(n_words < c.recommended_words, w["short"].format(n=c.recommended_words)),
        F.when(raw_chars > c.max_chars, w["truncated"].format(n=f"{c.max_chars:,}")),
        F.when(lang == "en", w["english"]),
        F.when(has_lm & ~calibrated, w["uncalibrated"]),
        F.when(~has_lm & has_classifier, w["classifier_only"]),
        F.when(~has_lm & ~has_classifier, w["style_only"]),
    )


def too_short(n_words: Column, c: EngineConfig = CONFIG) -> Column:
    """The rejection message of a text with too few words; null otherwise."""
    before, rest = L.TOO_SHORT.format(words="\0", least=c.min_words).split("\0")
    return F.when(n_words < c.min_words, F.concat(F.lit(before), n_words.cast("string"), F.lit(rest)))


def calibrated(score: Column, slope: Column, intercept: Column) -> Column:
    return sigmoid(slope * score + intercept)


def stacked(x: list[Column], coef: Column, intercept: Column, mean: Column, std: Column) -> Column:
    """Sigmoid of intercept + sum of coef * (x - mean) / std, arrays of parameters by feature."""
    z = intercept
    for k, v in enumerate(x):
        z = z + F.get(coef, F.lit(k)) * (v - F.get(mean, F.lit(k))) / F.get(std, F.lit(k))
    return sigmoid(z)
