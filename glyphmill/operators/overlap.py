"""Overlap with open sources: keywords, queries, and the n-gram join of sentences against sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as L
from ..config import EngineConfig
from ..functions import scores as S, text as T


def keywords(paragraph: Column, k: int = 6) -> Column:
    """The k most telling words: most frequent, then longest, then first; folded for counting, shown as first written."""
    letters = F.regexp_extract_all(F.coalesce(paragraph, F.lit("")), F.lit(rf"{T.LETTER}{{4,}}"), 0)
    stop = sorted(set(L.KEYWORD_STOP))

    def placed(words: Column) -> Column:
        # folded and lower-cased in one call for all words
        apart = lambda c: F.split(c, "\x01", -1)
        pairs = lambda keys, low: F.transform(keys, lambda x, i: F.struct(x.alias("key"), i.alias("at"), F.get(low, i).alias("word")))
        joined = F.array_join(words, "\x01")
        return T.let(apart(F.lower(joined)), lambda low: F.filter(pairs(apart(T.fold(joined)), low), lambda x: ~x["key"].isin(*stop)))

    def entry(own: Column) -> Column:
        first = F.get(own, F.lit(0))
        return F.struct((-F.size(own)).alias("n"), (-F.length(first["key"])).alias("len"), first["at"].alias("at"), first["word"].alias("word"))

    # sorted by key and place, the occurrences of a word stand together
    together = T.runs(F.sort_array(T.let(letters, placed)), lambda x: x["key"])
    ranked = F.sort_array(F.transform(together, entry))
    return F.when(F.size(letters) > 0, F.transform(F.slice(ranked, 1, k), lambda x: x["word"])).otherwise(F.array().cast("array<string>"))


def queries(text: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Distinct keyword queries of the longest paragraphs (of 25 words or more; the whole text without any)."""
    sized = F.transform(T.paragraphs(text), lambda p, i: F.struct((-T.count_blank_words(p)).alias("n"), i.alias("at"), p.alias("text")))
    long = F.filter(sized, lambda p: p["n"] <= -config.query_paragraph_words)
    chosen = T.let(long, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), text.alias("text")))))
    best = F.slice(F.array_sort(chosen), 1, config.max_queries)
    return F.array_distinct(F.transform(best, lambda p: F.array_join(keywords(p["text"], config.keywords_per_query), " ")))


def unique_sources(sources: DataFrame) -> DataFrame:
    """One source per url: the place of its first row, the values of its last. sources: (url, title, kind, text, ord)."""
    last = F.max_by(F.struct("title", "kind", "text"), "ord")
    return sources.groupBy("url").agg(F.min("ord").alias("ord"), last.alias("v")).select("url", "v.title", "v.kind", "v.text", "ord")


def grams(c: Column, n: int = 5) -> Column:
    return T.ngrams(T.fold_tokens(c), n)


def compared(mine: Column, theirs: Column) -> Column:
    """(shared, only_mine, share) of two arrays of distinct grams: what both hold, what only the first, and the first's share."""
    return F.struct(F.array_intersect(mine, theirs).alias("shared"), F.array_except(mine, theirs).alias("only_mine"), (F.size(F.array_intersect(mine, theirs)) / F.nullif(F.size(mine), F.lit(0))).alias("share"))


def matches(sentences: DataFrame, sources: DataFrame, id_col: str = "doc_id", config: EngineConfig = EngineConfig()) -> DataFrame:
    """(id, sent_id, text, paragraph, url, title, kind, overlap, words): sentences a source covers.

    sentences: (id, sent_id, paragraph, text). A sentence of 8 folded tokens or more matches the source that holds
    most of its distinct 5-grams, the earlier source on ties, if that is 40 % or more. An equi-join on the gram:
    the grams of both sides are distinct per row, pairs are counted with map-side partial sums, and a gram that
    many sentences share is a skewed join key that adaptive execution splits.
    """
    own = T.computed(sentences, id_col, "sent_id", __t=T.fold_tokens(F.col("text"))).where(F.size("__t") >= config.overlap_min_words)
    own = own.select(id_col, "sent_id", F.size("__t").alias("words"), T.ngrams(F.col("__t"), config.ngram).alias("__g"))
    asked = T.exploded(own.withColumn("n", F.size("__g")), [id_col, "sent_id", "words", "n"], F.col("__g"), "gram")
    held = T.exploded(unique_sources(sources), ["url", "ord"], grams(F.col("text"), config.ngram), "gram")
    shared = asked.join(held, "gram").groupBy(id_col, "sent_id", "words", "n", "url", "ord").agg(F.count("*").alias("k"))
    best = shared.groupBy(id_col, "sent_id", "words").agg(F.max(F.struct((F.col("k") / F.col("n")).alias("overlap"), (-F.col("ord")).alias("o"), F.col("url"))).alias("b"))
    best = best.where(F.col("b.overlap") >= config.overlap_threshold).select(id_col, "sent_id", "words", F.col("b.url").alias("url"), F.col("b.overlap").alias("overlap"))
    named = unique_sources(sources).select("url", "title", "kind")
    return best.join(named, "url").join(sentences.select(id_col, "sent_id", "paragraph", "text"), [id_col, "sent_id"]).select(id_col, "sent_id", "paragraph", "text", "url", "title", "kind", S.exact_round(F.col("overlap"), 3).alias("overlap"), "words")


def totals(sentences: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, fraction, sources): the share of words in matching sentences; sources with their shares, largest first."""
    all_words = sentences.groupBy(id_col).agg(F.sum(F.size(T.fold_tokens(F.col("text")))).alias("all"))
    per = found.groupBy(id_col, "url", "title", "kind").agg(F.sum("words").alias("w"), F.min("sent_id").alias("first"))
    rows = per.join(all_words, id_col, "right")
    share = S.exact_round(F.col("w") / F.greatest("all", F.lit(1)), 4)
    listed = F.array_sort(F.collect_list(F.when(F.col("w").isNotNull(), F.struct((-F.col("w")).alias("o"), "first", "url", "title", "kind", share.alias("fraction")))))
    return rows.groupBy(id_col).agg(S.exact_round(F.coalesce(F.sum("w"), F.lit(0)) / F.greatest(F.max("all"), F.lit(1)), 4).alias("fraction"), F.transform(listed, lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title"), x["kind"].alias("kind"), x["fraction"].alias("fraction"))).alias("sources"))


def check(docs: DataFrame, search, id_col: str = "doc_id", text_col: str = "text", config: EngineConfig = EngineConfig()) -> DataFrame:
    """(id, fraction, sources, queries, sources_seen, notice): what a search for each document's queries turns up.

    search: a callable from a DataFrame (query) to a DataFrame of sources (url, title, kind, text, ord), or such a
    DataFrame itself. Only the queries leave.
    """
    base = docs.where(T.count_blank_words(F.col(text_col)) >= config.similarity_min_words).select(id_col, T.normalize(T.truncate(F.col(text_col), config.max_chars)).alias("text"))
    asked = base.select(id_col, queries(F.col("text"), config).alias("queries"))
    sources = search(T.exploded(asked, [], F.col("queries"), "query").distinct()) if callable(search) else search
    sents = T.exploded(base, [id_col], T.sentences(F.col("text")), "s", "sent_id").select(id_col, "sent_id", "s.paragraph", "s.text")
    seen = unique_sources(sources).agg(F.count("*").alias("sources_seen"))
    return totals(sents, matches(sents, sources, id_col, config), id_col).join(asked, id_col).crossJoin(F.broadcast(seen)).withColumn("notice", F.lit(L.OVERLAP_NOTE))


def failover(*searches):
    """A search that asks each of several in turn and unites what those return that work; errors are logged.

    A search that cannot be planned is left out here. One that fails while it runs must catch that itself, query by
    query, as the services of sources.web do.
    """

    def run(asked: DataFrame) -> DataFrame:
        import logging

        found = []
        for k, search in enumerate(searches):
            try:
                found.append(search(asked).select("url", "title", "kind", "text", (F.col("ord") + F.lit(k * (1 << 40))).alias("ord")))
            except Exception as e:  # a source that is down must not stop the others
                logging.getLogger(__name__).warning("search %s failed: %s", k, e)
        if not found:
            return asked.sparkSession.createDataFrame([], "url string, title string, kind string, text string, ord long")
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    return run
