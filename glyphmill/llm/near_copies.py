"""Near copies: texts whose sets of five-word shingles have Jaccard similarity 0.8 or more, as one group.

Candidates come from SimHash fingerprints within 3 bits (see simhash) and from MinHash bands: a pair of similarity
0.8 shares none of BANDS bands of ROWS minima with probability (1 - 0.8 ** ROWS) ** BANDS, 3 in a million, and more
similar pairs still less often. Every candidate is decided by its words.

Fingerprints first meet the leaders of the cells that they reach, and texts of a bucket two leaders: the one that shares most buckets with others, which is near the middle of a
group of copies, and one that a hash draws. Fingerprints whose texts are then still in different groups meet pair by pair. Buckets whose texts are, are of two kinds. In
small ones all pairs across groups meet. Texts of large ones (heavily edited copies, or texts with one passage in
common) are joined by prefix filter: shingles in order of rarity among these texts, a prefix that every similar pair
must share a shingle of, and a bound on their overlap by the places of that shingle. No similar pair of a bucket escapes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import ship
from . import simhash
from .common import cut, hot_join, with_row_key
from .graph import components
from .wordblocks import Words, gram_hashes, mix, pieces, within_text

SHINGLE, PARTS, OF = 5, 4, 5  # similarity of at least PARTS / OF
BANDS, ROWS = 24, 4
#: Texts of a bucket up to which all pairs across groups meet.
SMALL = 16


def band_keys(texts: pa.Array) -> np.ndarray:
    """A row of BANDS keys for each text; zeros for a text without words."""
    words = Words(texts, "space_fold")
    hashes, out = words.hashes(), np.zeros((len(words.counts), BANDS), np.uint64)
    for width in range(1, SHINGLE + 1):  # a shorter text is one shingle
        own = words.counts >= SHINGLE if width == SHINGLE else words.counts == width
        if not own.any():
            continue
        at = np.flatnonzero(within_text(words, width) & own[words.text_of()[: len(hashes) - width + 1]])
        grams = gram_hashes(hashes, width)[at]
        counts = words.counts[own] - width + 1
        starts = np.cumsum(counts) - counts
        for band in range(BANDS):
            key = np.full(len(counts), band + 1, np.uint64)
            for row in range(ROWS):
                odd, shift = mix(np.array([2 * (band * ROWS + row) + 1, 2 * (band * ROWS + row) + 2], np.uint64))
                key = mix(key + np.minimum.reduceat(grams * (odd | np.uint64(1)) + shift, starts))
            out[own, band] = key
    return out


def _marks_map(batches):
    for piece in pieces(batches, "__text"):
        texts = piece.column("__text")
        raw = [(t.as_py() or "").encode() for t in texts]
        same = [xxhash.xxh3_128_digest(b" ".join(r.lower().split())) for r in raw]
        prints = np.array([simhash.majority(simhash.shingle_hashes(r, simhash.SHINGLE)) for r in raw], np.uint64).view(np.int64)
        bands = [k.tolist() if k.any() else [] for k in band_keys(texts).view(np.int64)]
        yield pa.RecordBatch.from_arrays([piece.column("__id"), piece.column("__key"), pa.array(same, pa.binary()), pa.array(prints), pa.array(bands, pa.list_(pa.int64()))], names=["__id", "__key", "d", "f", "bands"])


def shingle_set(text: str | None) -> frozenset[bytes]:
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1) if words else 0))


def similar(a: frozenset, b: frozenset) -> bool:
    both = len(a & b)
    return OF * both >= PARTS * (len(a) + len(b) - both)


def _similar_map(batches):
    of = lru_cache(maxsize=8)(shingle_set)
    for b in batches:
        ok = [similar(of(x.as_py()), of(y.as_py())) for x, y in zip(b.column("ta"), b.column("tb"), strict=True)]
        yield b.select(["a", "b", "p", "q"]).filter(pa.array(ok, pa.bool_()))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(p, q) of those of pairs (a, b, p, q) whose texts (node, text) are similar."""
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "p", "q", "ta", "tb")
    return cut(both.mapInArrow(_similar_map, "a long, b long, p long, q long").select("p", "q"))


def _grams_map(batches):
    """(node, root, n, grams): the distinct shingle hashes of each text."""
    for piece in pieces(batches, "text"):
        words = Words(piece.column("text"), "space_fold")
        hashes, sets = words.hashes(), []
        for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
            own = hashes[lo:hi]
            sets.append(np.unique(gram_hashes(own, min(SHINGLE, len(own)))).view(np.int64) if len(own) else np.zeros(0, np.int64))
        sizes = np.cumsum([0, *map(len, sets)])
        flat = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(sets)))
        yield pa.RecordBatch.from_arrays([piece.column("node"), piece.column("root"), pa.array(np.diff(sizes), pa.int64()), flat], names=["node", "root", "n", "grams"])


def prefix_pairs(wide: DataFrame) -> DataFrame:
    """(a, b, p, q) of texts (node, root, text) in different groups p < q that may be similar: all that are, and few others."""
    sets = cut(wide.mapInArrow(_grams_map, "node long, root long, n long, grams array<long>"))
    occurs = sets.select("node", F.explode("grams").alias("g"))
    held = cut(occurs.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    lists = hot_join(occurs, held, ["g"], "df", total).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("own"))
    # shingles that no other text has come first in the order, so the k-th of the others stands at n - size(own) + k
    spots = F.expr(f"filter(transform(own, (x, k) -> struct(x.g AS g, n - size(own) + k AS at)), x -> x.at <= n - ({PARTS} * n + {OF - 1}) div {OF})")
    tokens = lists.join(sets.select("node", "root", "n"), "node").select("node", "root", "n", F.explode_outer(spots).alias("x")).where("x is not null").select("x.g", "node", "root", "n", "x.at")
    tokens = cut(tokens)
    mixed = tokens.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("g")
    tokens = tokens.join(mixed, "g", "left_semi")
    left, right = tokens.toDF("g", "a", "p", "na", "ia"), tokens.toDF("g", "b", "q", "nb", "ib")
    # of similar texts the first shingle in common leaves room for the overlap that they need
    fits = (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) * (PARTS + OF)) >= (F.col("na") + F.col("nb")) * PARTS
    return left.join(right, "g").where((F.col("p") < F.col("q")) & fits).select("a", "b", "p", "q").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __key, component_id) of every row: component_id is the smallest id that near copies reach.

    Texts of equal words are one node. Null and empty texts are copies of each other; a text of fewer than five
    words is one shingle. Rows that repeat an id are one document, linked by it. A null id takes no part: its
    component is null. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    rows = with_row_key(docs, id_col, text_col)
    marks = cut(rows.mapInArrow(_marks_map, "__id long, __key long, d binary, f long, bands array<long>"))
    own = marks.where(F.col("__id").isNotNull())
    nodes = own.groupBy("d").agg(F.min("__id").alias("rep"), F.min_by("__key", "__id").alias("__key"), F.first("f").alias("f"), F.first("bands").alias("bands"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))

    keyed = nodes.select("node", F.explode("bands").alias("key"))
    held = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = cut(hot_join(keyed, held, ["key"], "n", nodes.count() * BANDS))
    ranked = shared.join(shared.groupBy("node").agg(F.sum("n").alias("degree")), "node")
    leaders = ranked.groupBy("key").agg(F.first("n").alias("n"), F.max_by("node", F.struct("degree", "node")).alias("central"), F.min_by("node", F.xxhash64("node", "key")).alias("drawn"))
    led = hot_join(shared.select("key", "node"), cut(leaders), ["key"], "n", nodes.count() * BANDS)
    prints = cut(nodes.groupBy("f").agg(F.min("node").alias("node"), F.count("*").alias("n")))
    at_print = prints.select("f", "node")
    close = simhash.stars(prints.select("f", "n")).join(at_print.toDF("a", "x"), "a").join(at_print.toDF("b", "y"), "b").select("x", "y")
    alike = nodes.join(at_print.toDF("f", "x"), "f").select("x", F.col("node").alias("y"))
    ordered = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    stars = led.select(*ordered("node", "central")).union(led.select(*ordered("node", "drawn"))).union(close.select(*ordered("x", "y"))).union(alike.select(*ordered("x", "y")))
    tried = cut(stars.where("a <> b").distinct())
    need = shared.select("node").union(tried.select("a")).union(tried.select("b")).distinct()
    wanted = nodes.join(need, "node", "left_semi").select("node", F.col("rep").alias("__id"), "__key")
    texts = cut(rows.join(wanted, ["__id", "__key"]).dropDuplicates(["__id", "__key"]).select("node", F.col("__text").alias("text")))  # the only shuffle of all texts
    first = _verified(tried.select("a", "b", F.col("a").alias("p"), F.col("b").alias("q")), texts)

    placed = cut(marks.join(nodes.select("d", "node"), "d", "left").select("__id", "__key", "node"))
    several = placed.where(F.col("__id").isNotNull()).groupBy("__id").agg(F.min("node").alias("u"), F.max("node").alias("last"), F.collect_set("node").alias("all")).where("u < last")
    roots = components(first.toDF("u", "v").union(several.select("u", F.explode("all").alias("v"))))
    at = cut(nodes.select("node", "rep").join(roots.toDF("node", "root"), "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root")))

    entries = shared.join(at.select("node", "root"), "node")
    mixed = entries.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    entries = cut(entries.join(mixed, "key", "left_semi").select("key", "node", "n", "root"))
    few = entries.where(F.col("n") <= SMALL).select("key", "node", "root")
    few = few.toDF("key", "a", "p").join(few.toDF("key", "b", "q"), "key").where("p < q").select("a", "b", "p", "q").distinct()
    wide = prefix_pairs(entries.where(F.col("n") > SMALL).select("node", "root").distinct().join(texts, "node"))
    # fingerprints that are near, one pair of texts each, where their texts are in different groups
    rooted = cut(at_print.join(at.select("node", "root"), "node"))
    ends = lambda f, node, root: rooted.select(F.col("f").alias(f), F.col("node").alias(node), F.col("root").alias(root))
    near = simhash.links(rooted.select("f", "root"), group="root").toDF("fa", "fb").join(ends("fa", "a", "p"), "fa").join(ends("fb", "b", "q"), "fb").select("a", "b", "p", "q")
    rest = few.union(wide).union(near).select(*ordered("a", "b"), "p", "q").distinct().join(tried, ["a", "b"], "left_anti")
    merged = components(_verified(cut(rest), texts).toDF("u", "v"))
    final = at.join(merged.toDF("root", "last"), "root", "left").select("node", "rep", F.coalesce("last", "root").alias("root"))
    least = final.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = placed.join(final.select("node", "root"), "node", "left").join(least, "root", "left")
    return found.select("__id", "__key", F.when(F.col("__id").isNotNull(), F.col("component_id")).alias("component_id"))
