"""A pair of back-off language models inside Spark: an observer of one word of context and a performer of two.

Both are interpolated Kneser-Ney models of one discount, trained by counting: words are scanned once to count the
triples of each text, and all else are aggregates of the triples' table. The cross entropy of the observer with the
performer is a sum over the whole vocabulary; all words that a context was never seen with share closed forms, so only
words that followed it are visited. Nothing is collected, broadcast or cached but single rows; tables of counts, which are read
several times, are written to the shared folder, else each use would scan all words again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T

from ..session import stored
from .contexts import BEGIN, dealt
from .signals import with_offsets


def triples(text: Column) -> Column:
    """Array of (pos, start, end, u, v, w): each lower-cased word with the two before it."""

    def placed(words: Column) -> Column:
        low = T.let(F.array_join(F.transform(words, lambda x: x["w"]), "\x01"), lambda t: F.split(F.lower(t), "\x01", -1))
        before = lambda l, i: F.coalesce(F.get(l, i), F.lit(BEGIN))
        return T.let(low, lambda l: F.transform(words, lambda x, i: F.struct(i.alias("pos"), x["start"].alias("start"), x["end"].alias("end"), before(l, i - 2).alias("u"), before(l, i - 1).alias("v"), F.get(l, i).alias("w"))))

    return T.let(with_offsets(text), placed)


def counted(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(u, v, w, c): how often w follows u and v."""
    before = lambda l, i: F.coalesce(F.get(l, i), F.lit(BEGIN))
    plain = T.let(T.lower_words(F.col(text_col)), lambda l: F.transform(l, lambda w, i: F.struct(before(l, i - 2).alias("u"), before(l, i - 1).alias("v"), w.alias("w"))))
    found = T.exploded(texts.select(plain.alias("x")), [], F.col("x"), "x")
    return found.groupBy("x.u", "x.v", "x.w").agg(F.count("*").alias("c"))


def fitted(tri: DataFrame, discount: float = 0.75) -> DataFrame:
    """(u, v, w, ppl, xppl) of each triple of `counted`: what its last word costs the performer, and the cross entropy after its first two.

    One unseen word stands for all. With p1 the share of distinct left neighbours, p2 and p3 discounted and interpolated
    with the order below: ppl is -ln p3(w | u, v), xppl is -sum over all words of p2(. | v) ln p3(. | u, v).
    """
    d = F.lit(discount)
    tri = stored(tri)
    bi = stored(tri.groupBy("v", "w").agg(F.count("*").cast("double").alias("k")))
    uni = stored(bi.groupBy("w").agg(F.count("*").cast("double").alias("m")))
    size = uni.agg(F.sum("m").alias("all"), F.count("*").cast("double").alias("types"))
    spread1 = d * F.col("types") / F.col("all") / (F.col("types") + 1)  # what is taken off, for each word and the unseen one
    uni = uni.crossJoin(F.broadcast(size)).select("w", ((F.col("m") - d) / F.col("all") + spread1).alias("p1"), spread1.alias("least"))
    # sum over all words of p1 ln p1
    h1 = uni.agg((F.sum(F.col("p1") * F.ln("p1")) + F.max(F.col("least") * F.ln("least"))).alias("h1"))
    of_v = bi.groupBy("v").agg(F.sum("k").alias("kv"), (d * F.count("*") / F.sum("k")).alias("l2"))
    second = stored(bi.join(of_v, "v").join(uni, "w").select("v", "w", ((F.col("k") - d) / F.col("kv") + F.col("l2") * F.col("p1")).alias("p2"), (F.col("l2") * F.col("p1")).alias("rest"), "l2"))
    h2 = second.groupBy("v").agg(F.sum(F.col("p2") * F.ln("p2") - F.col("rest") * F.ln("rest")).alias("seen"), F.first("l2").alias("l2"))
    h2 = h2.crossJoin(F.broadcast(h1)).select("v", (F.col("seen") + F.col("l2") * (F.ln("l2") + F.col("h1"))).alias("h2"))
    of_uv = tri.groupBy("u", "v").agg(F.sum("c").alias("cuv"), (d * F.count("*") / F.sum("c")).alias("l3"))
    third = tri.join(second.select("v", "w", "p2").join(h2, "v"), ["v", "w"]).join(of_uv, ["u", "v"])
    third = stored(third.select("u", "v", "w", "p2", "h2", "l3", ((F.col("c") - d) / F.col("cuv") + F.col("l3") * F.col("p2")).alias("p3")))
    after = third.groupBy("u", "v").agg((-(F.ln(F.first("l3")) + F.first("h2")) - F.sum(F.col("p2") * (F.ln("p3") - F.ln(F.col("l3") * F.col("p2"))))).alias("xppl"))
    return third.join(after, ["u", "v"]).select("u", "v", "w", (-F.ln("p3")).alias("ppl"), "xppl")


def backoff_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", discount: float = 0.75) -> DataFrame:
    """(id, pos, start, end, ppl, xppl) of each word but a text's first, by models of the same texts."""
    looked = fitted(counted(docs, text_col), discount)
    words = T.exploded(docs.select(F.col(id_col), triples(F.col(text_col)).alias("x")), [id_col], F.col("x"), "x").select(id_col, "x.*").where("pos > 0")
    return words.join(looked, ["u", "v", "w"]).select(id_col, "pos", "start", "end", "ppl", "xppl")


def backoff_means(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", discount: float = 0.75) -> DataFrame:
    """(id, n, ppl, xppl): how many rows `backoff_statistics` has of each text, and their means, with a part of the contexts on the way at a time."""
    d = F.lit(discount)
    at = dealt(docs, 2, id_col, text_col)
    for i in range(at.parts):
        # equal pairs come together with all that stood before them, so a pair counts once for each
        triples = at.part(i).select("u", "v", "w").repartition("v", "w").distinct()
        like = at.folder.put(f"pairs/part={i}", triples.groupBy("v", "w").agg(F.count("*").alias("k")))
    together = at.folder.read("pairs", like)
    uni = at.folder.put("uni", together.groupBy("w").agg(F.count("*").cast("double").alias("m")))
    whole, types = uni.agg(F.coalesce(F.sum("m"), F.lit(1.0)), F.count("*")).first()
    least = discount * types / whole / (types + 1)  # what is taken off, for each word and the unseen one
    uni = uni.select("w", ((F.col("m") - d) / whole + least).alias("p1"))
    h1 = (uni.agg(F.sum(F.col("p1") * F.ln("p1"))).first()[0] or 0.0) + (least * math.log(least) if least else 0.0)  # sum over all words of p1 ln p1

    def looked(rows: DataFrame, i: int) -> DataFrame:
        """What `fitted` has, for contexts of the part."""
        of_v, of_uv = W.partitionBy("v", "s"), W.partitionBy("v", "s", "u")
        second = at.folder.read(f"pairs/part={i}", like).join(uni.hint("shuffle_hash"), "w").join(F.broadcast(at.shares), "v", "left")
        # each share of a word has all of the word's pairs
        second = second.select("v", "w", "k", "p1", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("s"))
        second = second.withColumn("kv", F.sum("k").over(of_v)).withColumn("l2", d * F.count("*").over(of_v) / F.col("kv"))
        second = second.withColumn("rest", F.col("l2") * F.col("p1")).withColumn("p2", (F.col("k") - d) / F.col("kv") + F.col("rest"))
        h2 = F.sum(F.col("p2") * F.ln("p2") - F.col("rest") * F.ln("rest")).over(of_v) + F.col("l2") * (F.ln("l2") + h1)
        third = rows.groupBy("v", "s", "u", "w").agg(at.count().alias("c")).join(second.select("v", "s", "w", "p2", h2.alias("h2")).hint("shuffle_hash"), ["v", "s", "w"])
        third = third.withColumn("cuv", F.sum("c").over(of_uv)).withColumn("l3", d * F.count("*").over(of_uv) / F.col("cuv"))
        third = third.withColumn("p3", (F.col("c") - d) / F.col("cuv") + F.col("l3") * F.col("p2"))
        after = -(F.ln("l3") + F.col("h2")) - F.sum(F.col("p2") * (F.ln("p3") - F.ln(F.col("l3") * F.col("p2")))).over(of_uv)
        past = lambda c: F.when(F.col("v") != at.begin, c)  # noqa: E731  # a text's first word only counts
        return third.select("v", "s", "u", "w", past(-F.ln("p3")).alias("ppl"), past(after).alias("xppl"))

    return at.means(looked, ["v", "s"], ["v", "s", "u", "w"])
