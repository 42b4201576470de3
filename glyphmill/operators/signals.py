"""Model signals: the token-statistics contract, its assignment to sentences, and what probabilities follow.

Any provider that returns (id, pos, start, end, ppl, xppl) plugs in. ngram_statistics is a provider inside Spark,
a unigram observer and a bigram performer: it keeps the algebra of a two-model score, but its values mean nothing
next to those of neural models.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import lexicon as L
from ..config import EngineConfig
from ..functions import scores as S, text as T
from ..session import stored
from .contexts import dealt

TOKENS = "doc_id long, pos int, start int, end int, ppl double, xppl double"


def ngram_statistics(docs: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", smooth: float = 0.5) -> DataFrame:
    """(id, pos, start, end, ppl, xppl) of each word but the first, under counts from corpus (docs by default).

    p(w | v) = (1 - s) n(v, w) / n(v) + s p(w), p(w) with one added to every count. ppl is -ln p(w | v); xppl is the
    cross entropy of the unigrams with the performer after v, which the bigrams of v alone decide.

    Each word is paired with the one before it inside the row. Words are scanned twice: once to count pairs, from which
    all else follows, and once to look pairs up; in between only tables of pairs move. Those are read several times and
    so written to the shared folder, where a lost executor takes nothing away.
    """
    hashed = lambda table: table.hint("shuffle_hash")  # of unique keys, so parts stay even; sorting all words or pairs would cost more than the rest
    kept = docs.select(F.col(id_col), F.col(text_col).alias("t"))
    train = docs if corpus is None else corpus
    first = T.exploded(train.select(paired(T.lower_words(F.col(text_col))).alias("x")), [], F.col("x"), "x").select("x.v", "x.w")
    pairs = stored(first.groupBy("v", "w").agg(F.count("*").alias("n")))  # v is null before a text's first word
    uni = stored(pairs.groupBy("w").agg(F.sum("n").alias("n")))
    total = uni.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    both = F.lit(float(total[0] + total[1]))
    uni = uni.select("w", ((F.col("n") + 1) / both).alias("p"))
    bi = pairs.where("v is not null")
    after = bi.groupBy("v").agg(F.sum("n").alias("nv"))
    perf = bi.join(hashed(after), "v").join(hashed(uni), "w").select("v", "w", ((1 - smooth) * F.col("n") / F.col("nv") + smooth * F.col("p")).alias("q"), "p")
    perf = stored(perf)
    # sum over all w of -p(w) ln(s p(w)), corrected where the bigram is known
    base = uni.agg(F.sum(-F.col("p") * F.ln(smooth * F.col("p")))).first()[0] or 0.0
    cross = perf.groupBy("v").agg(F.sum(-F.col("p") * (F.ln("q") - F.ln(smooth * F.col("p")))).alias("dh"))
    if corpus is None:
        wanted = perf.join(hashed(cross), "v").select("v", "w", "q", "p", "dh")
    else:
        own = T.exploded(kept.select(paired(T.lower_words(F.col("t"))).alias("x")), [], F.col("x"), "x").select("x.v", "x.w").where("v is not null").distinct()
        wanted = own.join(perf.select("v", "w", "q"), ["v", "w"], "left").join(uni, "w", "left").join(cross, "v", "left")
    p = F.coalesce("p", 1 / both)
    looked = wanted.select("v", "w", (-F.ln(F.coalesce("q", smooth * p))).alias("ppl"), (F.lit(base) + F.coalesce("dh", F.lit(0.0))).alias("xppl"))
    words = T.exploded(kept, [id_col], T.let(with_offsets(F.col("t")), lambda x: placed_pairs(x)), "x").select(id_col, "x.*").where("v is not null")
    return words.join(hashed(looked), ["v", "w"]).select(id_col, "pos", "start", "end", "ppl", "xppl")


def ngram_means(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", smooth: float = 0.5) -> DataFrame:
    """(id, n, ppl, xppl): how many rows `ngram_statistics` has of each text under its own counts, and their means, with a part of the contexts on the way at a time."""
    at = dealt(docs, 1, id_col, text_col)
    both = float(at.total + at.types)
    uni = at.words.select("w", ((F.col("n") + 1) / both).alias("p"))
    base = uni.agg(F.sum(-F.col("p") * F.ln(smooth * F.col("p")))).first()[0] or 0.0

    def looked(rows: DataFrame, _: int) -> DataFrame:
        """What a pair costs the performer, and the cross entropy after its first word."""
        of_v = W.partitionBy("v")
        perf = rows.groupBy("v", "w").agg(at.count().alias("n")).join(uni.hint("shuffle_hash"), "w")
        perf = perf.withColumn("q", (1 - smooth) * F.col("n") / F.sum("n").over(of_v) + smooth * F.col("p"))
        return perf.select("v", "w", (-F.ln("q")).alias("ppl"), (F.lit(base) + F.sum(-F.col("p") * (F.ln("q") - F.ln(smooth * F.col("p")))).over(of_v)).alias("xppl"))

    return at.means(looked, ["v", "w"], ["v", "w"])


def paired(words: Column) -> Column:
    """Array of (v, w): each word with the one before it, null before the first."""
    return T.let(words, lambda x: F.transform(x, lambda w, i: F.struct(F.get(x, i - 1).alias("v"), w.alias("w"))))


def placed_pairs(words: Column) -> Column:
    """Array of (pos, start, end, v, w) from (w, start, end): lower-cased words with the ones before them."""
    low = T.let(F.array_join(F.transform(words, lambda x: x["w"]), "\x01"), lambda t: F.split(F.lower(t), "\x01", -1))
    return T.let(low, lambda l: F.transform(words, lambda x, i: F.struct(i.alias("pos"), x["start"].alias("start"), x["end"].alias("end"), F.get(l, i - 1).alias("v"), F.get(l, i).alias("w"))))


def token_provider(docs: DataFrame, load, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """TOKENS rows from a model: load() runs once per worker and returns a function from a text to (start, end, ppl, xppl) of its tokens.

    Filter by length before this: no predicate passes a Python function.
    """
    import pandas as pd

    def run(frames):
        model = None
        for frame in frames:
            model = model or load()
            rows = [(i, k, *t) for i, text in zip(frame["id"], frame["text"], strict=True) for k, t in enumerate(model(text or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "start", "end", "ppl", "xppl"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, TOKENS)


def text_provider(rows: DataFrame, load, out: str, kind: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, out) from a model: load() runs once per worker and returns a function from a list of texts to a list of values.

    kind is the SQL type of out: a classifier gives double, a paraphraser or generator string.
    """
    import pandas as pd

    def run(frames):
        model = None
        for frame in frames:
            model = model or load()
            yield pd.DataFrame({id_col: frame["id"], out: model([t or "" for t in frame["text"]])})

    id_kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"`{id_col}` {id_kind}, `{out}` {kind}")


def with_offsets(c: Column) -> Column:
    """Array of (w, start, end) of a text's words: text split around words, its parts' lengths summed up."""
    found = T.words(c)
    gaps = F.split(c, T.WORD, -1)

    def place(w: Column, g: Column) -> Column:
        ends = T.running(F.transform(w, lambda x, i: F.length(F.get(g, i)) + F.length(x)))
        return T.let(ends, lambda e: F.transform(w, lambda x, i: F.struct(x.alias("w"), (F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"))))

    return T.let(found, lambda w: T.let(gaps, lambda g: F.when(F.size(w) > 0, place(w, g)).otherwise(F.array().cast("array<struct<w:string,start:int,end:int>>"))))


def assign(tokens: DataFrame, sentences: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """tokens with sent_id: the last sentence that starts at or before them; -1 before the first.

    An as-of join: sentence starts and tokens in one window per document, the last start seen is carried on.
    """
    marks = sentences.select(id_col, F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("sent_id"), F.lit(None).cast("struct<pos:int,start:int,end:int,ppl:double,xppl:double>").alias("t"))
    body = tokens.select(id_col, F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("sent_id"), F.struct(F.col("pos").cast("int").alias("pos"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("ppl").cast("double").alias("ppl"), F.col("xppl").cast("double").alias("xppl")).alias("t"))
    order = W.partitionBy(id_col).orderBy("at", "kind", "sent_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = marks.unionByName(body).withColumn("__s", F.last("sent_id", ignorenulls=True).over(order))
    return both.where("kind = 1").select(id_col, "t.*", F.coalesce("__s", F.lit(-1)).alias("sent_id"))


def document_scores(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, lm_score): mean ppl over mean xppl; null without tokens or where that mean is 0."""
    return tokens.groupBy(id_col).agg((F.avg("ppl") / F.nullif(F.avg("xppl"), F.lit(0.0))).alias("lm_score"))


def row_score(tokens: Column) -> Column:
    """document_scores of an array of (ppl, xppl) tokens, inside the row: a ratio of means, which next to a threshold may differ from that of sums."""
    mean = lambda t, k: F.aggregate(t, F.lit(0.0), lambda a, x: a + x[k]) / F.nullif(F.size(t), F.lit(0))
    return T.let(tokens, lambda t: mean(t, "ppl") / F.nullif(mean(t, "xppl"), F.lit(0.0)))


def least_radius(m: Column, enough: Callable[[Column], Column], tried: int = 4) -> Column:
    """The least r in [0, m) for which enough(r), which holds for all that follow; m if for none. Most are small, so the first few are tried before bisection."""
    out = T.bisect(m, enough)
    for r in reversed(range(tried)):
        out = F.when(enough(F.lit(r)) & (m > r), r).otherwise(out)
    return out


def row_sentence_scores(tokens: Column, sents: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Array of (sent_id, lo, hi, n_tokens, score), a sentence each, inside the row: for tokens that come from the row's own text.

    tokens: array of (start, ppl, xppl) by start; sents: array of (start) by start. A token belongs to the last sentence
    that starts at or before it. Each sentence is widened on both sides until it holds 30 tokens, or all. Sums of tokens
    up to each sentence make every window a difference; where sentences begin among the tokens follows from merging both
    by their starts, and the least radius that suffices is found by bisection.
    """
    need = config.min_sentence_tokens

    def sums(t: Column, first: Column, k: str) -> Column:
        own = lambda i: F.slice(t, F.get(first, i) + 1, F.get(first, i + 1) - F.get(first, i))
        each = F.transform(F.sequence(F.lit(0), F.size(first) - 2), lambda i: F.aggregate(own(i), F.lit(0.0), lambda a, x: a + x[k].cast("double")))
        return F.concat(F.array(F.lit(0.0)), T.running(each, zero=0.0))

    def each(first: Column, a: Column, b: Column) -> Column:
        m = F.size(first) - 1  # first: where each sentence's tokens begin, and how many tokens there are

        def one(i: Column) -> Column:
            held = lambda r: F.get(first, F.least(i + r, m - 1) + 1) - F.get(first, F.greatest(i - r, F.lit(0)))
            return T.let(least_radius(m, lambda r: held(r) >= need), lambda r: window(i, F.greatest(i - r, F.lit(0)), F.least(i + r, m - 1)))

        def window(i: Column, lo: Column, hi: Column) -> Column:
            n = F.get(first, hi + 1) - F.get(first, lo)
            diff = lambda c: F.get(c, hi + 1) - F.get(c, lo)
            return F.struct(i.alias("sent_id"), lo.alias("lo"), hi.alias("hi"), n.cast("long").alias("n_tokens"), F.when(n > 0, diff(a) / F.nullif(diff(b), F.lit(0.0))).alias("score"))

        return F.transform(F.sequence(F.lit(0), m - 1), one)

    # twice the starts, tokens' odd: a sentence's place in the merged order is its number and the tokens that precede it; sorting two sorted runs is one pass
    both = lambda t, s: F.sort_array(F.concat(F.transform(s, lambda x: x["start"].cast("long") * 2), F.transform(t, lambda x: x["start"].cast("long") * 2 + 1)))
    places = lambda x: F.filter(F.transform(x, lambda v, i: F.when(v % 2 == 0, i)), lambda i: i.isNotNull())
    begins = lambda t, s: F.concat(F.transform(places(both(t, s)), lambda at, k: at - k), F.array(F.size(t)))
    both_sums = lambda t, first: F.struct(sums(t, first, "ppl").alias("a"), sums(t, first, "xppl").alias("b"))
    bound = lambda t, s: T.let(begins(t, s), lambda first: T.let(both_sums(t, first), lambda c: each(first, c["a"], c["b"])))
    none = F.array().cast("array<struct<sent_id:int,lo:int,hi:int,n_tokens:bigint,score:double>>")
    # both in one binding: each level of nesting costs the analyzer passes, of which it makes a hundred
    return T.let(F.struct(tokens.alias("t"), sents.alias("s")), lambda x: F.when(F.size(x["s"]) > 0, bound(x["t"], x["s"])).otherwise(none))


def sentence_scores(assigned: DataFrame, sentences: DataFrame, id_col: str = "doc_id", config: EngineConfig = EngineConfig()) -> DataFrame:
    """(id, sent_id, lo, hi, n_tokens, score): each sentence widened on both sides until it holds 30 tokens or all.

    For tokens of a provider outside the row (see row_sentence_scores for others). Per document, sums up to each
    sentence are gathered in one array, which every window is a difference of; only results leave the row.
    """
    per = assigned.where("sent_id >= 0").groupBy(id_col, "sent_id").agg(F.count("*").alias("n"), F.sum("ppl").alias("a"), F.sum("xppl").alias("b"))
    rows = sentences.select(id_col, "sent_id").join(per, [id_col, "sent_id"], "left").na.fill({"n": 0, "a": 0.0, "b": 0.0})
    arrays = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("sent_id", "n", "a", "b"))).alias("s"))
    sums = lambda k, kind, zero: F.concat(F.array(F.lit(zero)), T.running(F.transform("s", lambda x: x[k].cast(kind)), zero=zero))
    arrays = arrays.select(id_col, F.transform("s", lambda x: x["sent_id"]).alias("ids"), sums("n", "int", 0).alias("n"), sums("a", "double", 0.0).alias("a"), sums("b", "double", 0.0).alias("b"))
    need = config.min_sentence_tokens

    def windows(ids: Column, n: Column, a: Column, b: Column) -> Column:
        m = F.size(ids)

        def one(i: Column) -> Column:
            held = lambda r: F.get(n, F.least(i + r, m - 1) + 1) - F.get(n, F.greatest(i - r, F.lit(0)))
            return T.let(least_radius(m, lambda r: held(r) >= need), lambda r: window(i, F.greatest(i - r, F.lit(0)), F.least(i + r, m - 1)))

        def window(i: Column, lo: Column, hi: Column) -> Column:
            diff = lambda c: F.get(c, hi + 1) - F.get(c, lo)
            return F.struct(F.get(ids, i).alias("sent_id"), lo.alias("lo"), hi.alias("hi"), diff(n).cast("long").alias("n_tokens"), F.when(diff(n) > 0, diff(a) / F.nullif(diff(b), F.lit(0.0))).alias("score"))

        return F.transform(F.sequence(F.lit(0), m - 1), one)

    bound = T.let(F.col("ids"), lambda i: T.let(F.col("n"), lambda n: T.let(F.col("a"), lambda a: T.let(F.col("b"), lambda b: windows(i, n, a, b)))))
    return T.exploded(arrays, [id_col], bound, "x").select(id_col, "x.*")


def lm_windows(n: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Scoring windows of a text of n tokens: (context_start, start, end); token 0 is never scored."""
    starts = lambda n: F.when(n > 1, F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)), F.lit(config.lm_chunk))).otherwise(F.array().cast("array<int>"))
    return T.let(n, lambda n: F.transform(starts(n), lambda s: F.struct(F.greatest(s - config.lm_context, F.lit(0)).alias("context_start"), s.alias("start"), F.least(s + config.lm_chunk, n).alias("end"))))


def classifier_chunks(n: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Chunks (start, end) of n tokens for a classifier; a last chunk under a quarter is replaced by the last full chunk's worth."""
    size = config.classifier_chunk
    starts = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1, F.lit(size))
    short = lambda s, n: (s > 0) & (n - s < size // 4)
    return T.let(n, lambda n: F.transform(starts(n), lambda s: F.struct(F.when(short(s, n), F.greatest(n - size, F.lit(0))).otherwise(s).alias("start"), F.least(s + size, n).alias("end"))))


def chunk_probability(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, classifier_p) from (id, p, len): the mean weighted by chunk length."""
    return chunks.groupBy(id_col).agg((F.sum(F.col("p") * F.col("len")) / F.nullif(F.sum("len"), F.lit(0))).alias("classifier_p"))


def calibrations(rows: DataFrame, found: DataFrame | None, model_id: str) -> DataFrame:
    """rows (with lang) and slope, intercept, threshold_low_fpr, calibrated of the model in that language.

    found: (lang, model_id, slope, intercept, threshold_low_fpr). A language without an entry takes the Spanish one
    as not calibrated; an entry of another model, or none at all, gives the defaults.
    """
    d = L.Calibration()
    names = ("slope", "intercept", "threshold_low_fpr")
    default = {k: F.lit(float(getattr(d, k))) for k in names}
    if found is None:
        return rows.withColumns(default | {"calibrated": F.lit(False)})
    known = F.broadcast(found.select(F.col("lang").alias("__l"), F.col("model_id").alias("__m"), *[F.col(k).alias(f"__{k}") for k in names]))
    spanish = F.broadcast(found.where("lang = 'es'").select(F.lit(1).alias("__one"), F.col("model_id").alias("__em"), *[F.col(k).alias(f"__e{k}") for k in names]))
    wide = rows.join(known, rows["lang"] == F.col("__l"), "left").join(spanish, F.lit(1) == F.col("__one"), "left")
    has, own = F.col("__l").isNotNull(), F.coalesce(F.col("__m") == model_id, F.lit(False))
    es = F.coalesce(F.col("__em") == model_id, F.lit(False))
    pick = {k: F.when(has & own, F.col(f"__{k}")).when(~has & es, F.col(f"__e{k}")).otherwise(default[k]) for k in names}
    return wide.withColumns(pick | {"calibrated": has & own}).select(*rows.columns, *names, "calibrated")


def document_signals(scores: DataFrame, found: DataFrame | None, model_id: str, meta: DataFrame | None = None, classifier_id: str = "") -> DataFrame:
    """scores (id, lang, lm_score, style, classifier_p) with lm_p, meta_p and the calibration's columns.

    meta: at most one row (binoculars, clasificador, coef, intercept, mean, std); used where both ids match.
    """
    rows = calibrations(scores, found, model_id)
    rows = rows.withColumn("lm_p", S.calibrated(F.col("lm_score"), F.col("slope"), F.col("intercept")))
    if meta is None:
        return rows.withColumn("meta_p", F.lit(None).cast("double"))
    one = F.broadcast(meta.where((F.col("binoculars") == model_id) & (F.col("clasificador") == classifier_id)).select(F.struct("coef", "intercept", "mean", "std").alias("__m")).limit(1))
    m = F.col("__m")
    x = [F.col("lm_score"), F.col("style"), S.logit(F.col("classifier_p"))]
    return rows.join(one, F.lit(True), "left").withColumn("meta_p", S.stacked(x, m["coef"], m["intercept"], m["mean"], m["std"])).drop("__m")
