"""Approximate nearest neighbours: coarse lists, product-quantised residuals, asymmetric tables, exact reranking.

Coarse centroids and the residual codebooks are fitted on a bounded sample; every row is indexed. How many lists
a query probes is set by measurement: brute force over the sample tells how many lists hold the true neighbours of
queries, which are drawn from the real ones, since those may lie apart from the other rows. Rows farther from their centre
than any of the sample are a list of their own that every query visits: the sample says nothing about them. How many
candidates are reranked follows from how far codes are off in the query's own direction.
Lists are dealt into groups of about BLOCK_ROWS rows; a query travels once to each group that holds a list it probes,
and only its best few rows of the whole group come back. Groups and their queries meet in blocks bounded on both sides, so
a list that holds a third of all rows, or one that a third of all queries probe, is many small tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from ..session import ship
from .common import cut

#: Rows that centroids and codebooks are fitted on at most, bytes of their vectors at most (and of all centroids), and rows and queries of the recall measurement.
SAMPLE_ROWS, SAMPLE_BYTES, PROBE_ROWS, PROBE_QUERIES = 20_000, 64 << 20, 8_000, 256
#: Share of the sample's true neighbours that the probed lists must hold.
PROBE_RECALL = 0.99
#: Standard deviations of a code's error within which a row may still be among the best, and of a list's rows that count for its place (the best one is measured).
SLACK, SPREADS = 4.0, (0.0, 1.0, 2.0, 3.0, 4.0)
SUBSPACES, CODES, ROUNDS = 16, 256, 8
#: Rows of a block, queries of a query block, and candidates that a block reranks for a query at least, beside those asked for and those that tie with the last.
BLOCK_ROWS, BLOCK_QUERIES, RERANK = 8_192, 2_048, 400
MAX_LISTS = 16_384


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centers = distinct[rng.permutation(len(distinct))[: min(k, len(distinct))]].astype(np.float64)
    for _ in range(rounds):
        near = _nearest(x, centers)
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        size = np.bincount(near, minlength=len(centers))
        centers[size > 0] = total[size > 0] / size[size > 0, None]
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = 0.5 * (centers**2).sum(axis=1)
    return np.concatenate([np.argmin(half - x[lo : lo + 4096] @ centers.T, axis=1) for lo in range(0, max(1, len(x)), 4096)])


@dataclass
class Index:
    """centers of the lists, the last one that of far rows; books: residual codebooks by subspace; wide: how far a list's scores spread for a query of length 1; far: the sample's largest residual; probes: lists that a query visits beside the far one."""

    centers: np.ndarray
    books: list[np.ndarray]
    cuts: np.ndarray
    wide: np.ndarray
    far: float
    probes: int

    def lists(self, x: np.ndarray) -> np.ndarray:
        near = _nearest(x, self.centers[:-1])
        near[np.linalg.norm(x - self.centers[near], axis=1) > self.far] = len(self.centers) - 1
        return near

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.centers[lists]
        return np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with every code word: (query, subspace, code)."""
        out = np.full((len(queries), len(self.books), CODES), -np.inf)
        for m, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)):
            out[:, m, : len(book)] = queries[:, a:b] @ book.T
        return out

    def decoded(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        return self.centers[lists] + np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)

    def order(self, queries: np.ndarray) -> np.ndarray:
        """All lists but the far one for each query, by the inner product that their better rows may have."""
        return np.argsort(-(queries @ self.centers[:-1].T + np.linalg.norm(queries, axis=1)[:, None] * self.wide), axis=1, kind="stable")

    def visit(self, queries: np.ndarray) -> np.ndarray:
        """The lists that each query probes."""
        last = np.full((len(queries), 1), len(self.centers) - 1)
        return np.concatenate([self.order(queries)[:, : self.probes], last], axis=1)


def fit(sample: np.ndarray, rows: int, k: int, asked: np.ndarray | None = None) -> Index:
    """sample: vectors in an order that says nothing about them; rows: how many rows the index will hold; asked: queries to measure by, rows of the sample by default."""
    dim = sample.shape[1]
    lists = max(1, min(MAX_LISTS, SAMPLE_BYTES // (8 * dim), round(math.sqrt(rows) / 4), len(sample)))
    centers = _kmeans(sample, lists, ROUNDS, 1)
    near = _nearest(sample, centers)
    rest = sample - centers[near]
    cuts = np.unique(np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int))
    books = [_kmeans(rest[:, a:b], CODES, ROUNDS, 2) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    apart = np.linalg.norm(rest, axis=1)
    far = float(apart.max()) * (1 + 1e-9)
    held = np.bincount(near, minlength=len(centers))
    spread = np.sqrt(np.bincount(near, (apart / (far or 1.0)) ** 2, minlength=len(centers)) / np.maximum(held, 1) / dim) * far
    index = Index(np.concatenate([centers, sample.mean(axis=0, keepdims=True)]), books, cuts, spread, far, len(centers))
    base = sample[:PROBE_ROWS]
    if asked is None or not len(asked):
        asked = base[:: max(1, len(base) // PROBE_QUERIES)][:PROBE_QUERIES]
    # three times as many as asked for: where all queries have the same few neighbours, those of the sample are too few to tell
    true = np.argsort(-(asked @ base.T), axis=1, kind="stable")[:, : 3 * (k + 1)]
    _, row = np.unique(true, return_inverse=True)
    found = []
    for width in SPREADS:
        index.wide = width * spread
        rank = np.take_along_axis(np.argsort(index.order(asked), axis=1), near[: len(base)][true], axis=1)
        by_row = np.bincount(row.reshape(-1), rank.reshape(-1)) / np.bincount(row.reshape(-1))
        needed = max(np.quantile(rank, PROBE_RECALL, method="higher"), np.quantile(by_row, PROBE_RECALL, method="higher"))
        found.append((min(len(centers), 1 + math.ceil(needed)), width))
    index.probes, width = min(found)
    index.wide = width * spread
    return index


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _assign_map(index: Index, dim: int):
    def run(batches):
        for b in batches:
            x = _vectors(b.column("v"), dim)
            near = index.lists(x)
            codes = index.codes(x, near)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "v", "list", "codes"])

    return run


def dealt(sizes: dict[int, int]) -> dict[int, int]:
    """The group of each list: lists that follow each other, up to BLOCK_ROWS rows in all; a larger list is a group of its own."""
    out, group, held = {}, 0, 0
    for name in sorted(sizes):
        if held and held + sizes[name] > BLOCK_ROWS:
            group, held = group + 1, 0
        out[name] = group
        held += sizes[name]
    return out


def _visit_map(index: Index, dim: int, group_of: np.ndarray):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                lists = index.visit(_vectors(part.column("v"), dim))
                row, name = np.repeat(np.arange(len(lists)), lists.shape[1]), lists.reshape(-1)
                row, name = row[group_of[name] >= 0], name[group_of[name] >= 0]  # lists that hold rows
                order = np.lexsort((group_of[name], row))
                row, name = row[order], name[order]
                first = np.flatnonzero(np.diff(row * (len(group_of) + 1) + group_of[name], prepend=-1))
                at, bounds = pa.array(row[first]), pa.array(np.append(first, len(name)), pa.int32())
                probed = pa.ListArray.from_arrays(bounds, pa.array(name.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("v").take(at), pa.array(group_of[name[first]].astype(np.int32)), probed], names=["id", "v", "part", "lists"])

    return run


def _search(index: Index, dim: int, k: int):
    def run(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if rows.num_rows and asked.num_rows:
            ids = rows.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")  # equal scores keep the smaller ids
            ids = ids[order]
            x = _vectors(rows.column("v").combine_chunks(), dim)[order]
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            names, of = np.unique(rows.column("list").to_numpy()[order], return_inverse=True)
            centers = index.centers[names]
            middle = centers.mean(axis=0)  # what all rows share says nothing about their order
            wrong = x - index.decoded(codes, names[of])
            gap = np.linalg.norm(wrong, axis=1)
            turned = wrong[gap > 0] / gap[gap > 0, None]
            leaning = turned.T @ turned / max(1, len(turned))  # which directions codes are off in
            q_ids, q = asked.column("id").to_numpy(), _vectors(asked.column("v").combine_chunks(), dim)
            probed = np.zeros((len(q), len(names)), bool)
            lists = asked.column("lists").combine_chunks()
            flat, of_query = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
            spot = np.minimum(np.searchsorted(names, flat), len(names) - 1)
            probed[of_query[names[spot] == flat], spot[names[spot] == flat]] = True
            take = min(len(ids), RERANK + k)
            for lo in range(0, len(q), 64):
                part = q[lo : lo + 64]
                tables = index.tables(part)
                rough = np.where(probed[lo : lo + 64], part @ (centers - middle).T, -np.inf)[:, of]
                for m in range(codes.shape[1]):
                    rough += tables[:, m, :][:, codes[:, m]]
                least = np.partition(rough, len(ids) - take, axis=1)[:, len(ids) - take]
                off = np.minimum(SLACK * np.sqrt(np.maximum(0, np.einsum("ij,ij->i", part @ leaning, part))), np.linalg.norm(part, axis=1))
                for j in range(len(rough)):
                    own = np.flatnonzero((rough[j] >= least[j]) & (rough[j] > -np.inf))  # all that tie with the last one too
                    own = own[ids[own] != q_ids[lo + j]]
                    score = np.einsum("ij,j->i", x[own], q[lo + j])
                    if len(own) > k:  # those that may still beat the last of k
                        last = np.partition(score, len(score) - k)[len(score) - k] - middle @ q[lo + j]
                        more = np.flatnonzero((rough[j] < least[j]) & (rough[j] + off[j] * gap >= last))
                        more = more[ids[more] != q_ids[lo + j]]
                        if len(more):
                            own = np.sort(np.concatenate([own, more]))
                            score = np.einsum("ij,j->i", x[own], q[lo + j])
                    top = np.argsort(-score, kind="stable")[:k]
                    out[0].append(np.full(len(top), q_ids[lo + j]))
                    out[1].append(ids[own[top]])
                    out[2].append(score[top])
        flat = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query_id": pa.array(flat[0].astype(np.int64)), "vec_id": pa.array(flat[1].astype(np.int64)), "score": pa.array(flat[2].astype(np.float64))})

    return run


def _kind(vectors: DataFrame, vec_col: str) -> str:
    """The type that vectors travel in: single precision stays single, which is half the bytes; all sums are of doubles."""
    return "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) with one row per id: rows that have an id and a vector of finite components, not all zero, of the commonest dimension.

    Of rows that repeat an id the smallest vector stays; of dimensions that are as common, the smaller.
    """
    v = F.col("v")
    good = F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(_kind(vectors, vec_col)).alias("v")).where(F.col("id").isNotNull() & v.isNotNull()).where(F.coalesce(good, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else -1)).groupBy("id").agg(F.min("v").alias("v"))


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each row that is_query(id) picks, itself excepted.

    Scores are exact, in double precision; ties go to the smaller id; all candidates if there are fewer than k.
    Vectors that are null, all zero, or hold null or non-finite components take no part, nor do rows without an id
    (see usable for repeated ids and odd dimensions). An empty table gives an empty table; other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = cut(usable(vectors, id_col, vec_col))
    n = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    dim = len(rows.first()["v"])
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    part = F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") / float(1 << 53)
    drawn = rows.where(part <= min(1.0, 1.2 * most / n)).select(F.xxhash64("id").alias("h"), "v").toArrow()
    fitted = _vectors(drawn.column("v").combine_chunks(), dim)[np.argsort(drawn.column("h").to_numpy(), kind="stable")[:most]] if drawn.num_rows else np.array([rows.first()["v"]], np.float64)
    queries = rows.where(is_query(F.col("id")))
    asking = queries.count()
    some = queries.where(part <= min(1.0, 1.5 * PROBE_QUERIES / max(1, asking))).select(F.xxhash64("id").alias("h"), "v").toArrow() if asking else None
    probing = _vectors(some.column("v").combine_chunks(), dim)[np.argsort(some.column("h").to_numpy(), kind="stable")[:PROBE_QUERIES]] if some is not None and some.num_rows else None
    index = fit(fitted, n, k, probing)
    kind = _kind(vectors, vec_col)
    held = cut(rows.mapInArrow(_assign_map(index, dim), f"id long, v {kind}, list int, codes binary"))
    sizes = {r[0]: r[1] for r in held.groupBy("list").count().collect()}  # a row per list: bounded by MAX_LISTS
    group_of = np.full(len(index.centers), -1, np.int64)
    for name, group in dealt(sizes).items():
        group_of[name] = group
    blocks = {int(g): -(-sum(sizes[x] for x in np.flatnonzero(group_of == g)) // BLOCK_ROWS) for g in np.unique(group_of[group_of >= 0])}
    asked = cut(queries.mapInArrow(_visit_map(index, dim, group_of), f"id long, v {kind}, part int, lists array<int>"))
    turns = {r[0]: -(-r[1] // BLOCK_QUERIES) for r in asked.groupBy("part").count().collect()}
    parts = F.broadcast(spark.createDataFrame([(a, b, turns.get(a, 0)) for a, b in sorted(blocks.items())], "part int, blocks int, turns int"))
    lists = F.broadcast(spark.createDataFrame([(x, int(group_of[x])) for x in sorted(sizes)], "list int, part int"))
    mine = lambda of: F.pmod(F.xxhash64(F.lit(7), "id"), F.col(of)).cast("int")
    left = held.join(lists, "list").join(parts, "part").where("turns > 0").select("part", mine("blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "id", "v", "list", "codes")
    right = asked.join(parts, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), mine("turns").alias("turn"), "id", "v", "lists")
    found = left.groupBy("part", "block", "turn").cogroup(right.groupBy("part", "block", "turn")).applyInArrow(_search(index, dim, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_vector_search(embeddings: DataFrame) -> DataFrame:
    """The columns of the query: the 20 nearest found of every row whose id 20 divides."""
    return search(embeddings, lambda c: c % 20 == 0)
