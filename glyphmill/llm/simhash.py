"""SimHash near-dedup in a segment-popcount embedding.

A fingerprint's halves are embedded as the bit counts of their two-bit segments. The Manhattan distance of two
embeddings never exceeds the Hamming distance of the fingerprints. Of two fingerprints within 3 bits, one half
differs in at most one bit, so its embeddings are the same grid cell or neighbours: a join on grid cells within
Manhattan radius 1 meets every pair. The join tests the whole embedding in byte segments, then the exact distance.
Fingerprints first meet the leader of each cell they reach; pairs are made only across what is then still apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship
from .common import column, cut, with_row_key
from .graph import components
from .wordblocks import pieces

SHINGLE, MAX_BITS = 3, 3
CHUNK = 1 << 16
#: Every second bit of a half: where a two-bit segment's count is kept.
EVENS = 0x55555555


def shingle_hashes(raw: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined word shingles of a text, repeats included; of the whole text if it has fewer words."""
    words = raw.lower().split()  # bytes: only A-Z change, only ASCII white space cuts
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :].tolist())), np.uint64)


def majority(h: np.ndarray) -> int:
    """The number whose bits are those set in over half of h; 0 for none."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(h), CHUNK):
        total += np.unpackbits(h[lo : lo + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big")


def _fingerprint_map(shingle: int):
    def run(batches):
        for piece in pieces(batches, "__text"):
            found = np.array([majority(shingle_hashes((t.as_py() or "").encode(), shingle)) for t in piece.column("__text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([piece.column("__id"), piece.column("__key"), pa.array(found)], names=["__id", "__key", "__f0"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(__id, __key, __f0): the SimHash of each row's text."""
    ship(docs.sparkSession)
    return with_row_key(docs, id_col, text_col).mapInArrow(_fingerprint_map(shingle), "__id long, __key long, __f0 long")


def _cell(half: Column) -> Column:
    """Grid cell of a 32-bit half: the counts (0 to 2) of its 16 two-bit segments, two bits each."""
    return half - F.shiftright(half, 1).bitwiseAND(F.lit(EVENS))


def _manhattan(a: str, b: str) -> Column:
    """Distance of two fingerprints' bit counts by byte: at most their Hamming distance."""
    byte = lambda c, k: F.bit_count(F.shiftrightunsigned(F.col(c), 8 * k).bitwiseAND(F.lit(255)))
    total = F.lit(0)
    for k in range(8):
        total = total + F.abs(byte(a, k) - byte(b, k))
    return total


def _cells(prints: DataFrame) -> DataFrame:
    """prints (f, and more) once for each half: with its number g and its grid cell."""
    f = F.col("f")
    halves = F.array(F.struct(F.lit(0).alias("g"), _cell(f.bitwiseAND(F.lit(0xFFFFFFFF))).alias("cell")), F.struct(F.lit(1).alias("g"), _cell(F.shiftrightunsigned(f, 32)).alias("cell")))
    return prints.select("*", F.explode(halves).alias("at")).select(*prints.columns, F.col("at.g").alias("g"), F.col("at.cell").alias("cell"))


def _probes(cells: DataFrame) -> DataFrame:
    """cells with each neighbouring cell whose counts are higher by one in one segment (up = 1) beside the own one (up = 0)."""
    steps = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.struct(F.expr("1L").alias("up"), F.call_function("shiftleft", F.lit(1).cast("long"), j * 2).alias("step"), F.call_function("shiftright", F.col("cell"), j * 2).bitwiseAND(F.lit(3)).alias("count"))),
        lambda s: s["count"] < 2,
    )
    near = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("up"), F.col("cell").alias("cell"))), F.transform(steps, lambda s: F.struct(s["up"].alias("up"), (F.col("cell") + s["step"]).alias("cell"))))
    others = [c for c in cells.columns if c != "cell"]
    return cells.select(*others, F.explode(near).alias("at")).select(*others, F.col("at.up").alias("up"), F.col("at.cell").alias("cell"))


def _within(max_bits: int):
    """Whether a and b differ in max_bits bits at most: first by the bound on their embeddings, then exactly."""
    return (_manhattan("a", "b") <= max_bits) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def _checked(max_bits: int) -> None:
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3: one of two halves must differ in at most one bit")


def links(prints: DataFrame, max_bits: int = MAX_BITS, group: str | None = None) -> DataFrame:
    """(a, b), a <> b: every pair of distinct fingerprints of prints (f) within max_bits (3 at most) bits; each pair once.

    With group, a column of prints, only pairs of different groups: a cell whose fingerprints are all of one group is
    not visited by that group, so a large cluster that is one group already costs no pairs.
    """
    _checked(max_bits)
    cells = _cells(prints.select("f", *([F.col(group).alias("p")] if group else [])))
    probes = _probes(cells).withColumnRenamed("f", "a")
    apart = (F.col("up") == 1) | (F.col("a") < F.col("b"))
    if group:
        held = cells.groupBy("g", "cell").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
        probes = probes.join(held, ["g", "cell"]).where((F.col("lo") != F.col("p")) | (F.col("hi") != F.col("p"))).drop("lo", "hi")
        apart = apart & (F.col("p") != F.col("q"))
    index = cells.withColumnsRenamed({"f": "b", "p": "q"})
    met = probes.join(index, ["g", "cell"]).where(apart & (F.col("a") != F.col("b")) & _within(max_bits))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def stars(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) of fingerprints a within max_bits bits of the leader b of a cell they reach: the one that most rows (n) have.

    At most one link for each cell visited. Copies of one text lie around its fingerprint, which leads its cells.
    """
    _checked(max_bits)
    cells = _cells(prints.select("f", "n"))
    leaders = cells.groupBy("g", "cell").agg(F.max_by("f", F.struct("n", "f")).alias("b"))
    return _probes(cells.drop("n")).withColumnRenamed("f", "a").join(leaders, ["g", "cell"]).where((F.col("a") != F.col("b")) & _within(max_bits)).select("a", "b").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(__id, __key, fingerprint, component_id) of every row: component_id is the smallest id that links reach.

    Rows with equal fingerprints are one node, so copies of any number never meet pair by pair. Distinct fingerprints
    first link to the leaders of cells; only those that are then still in different components meet pair by pair. Null
    or empty texts have fingerprint 0 and link like any other. Rows that repeat an id are one document, linked by it. A
    null id takes no part: its component is null. An empty table gives an empty table.
    """
    found = cut(fingerprints(docs, id_col, text_col, shingle))
    own = found.where(F.col("__id").isNotNull())
    held = cut(own.groupBy(F.col("__f0").alias("f")).agg(F.min("__id").alias("rep"), F.count("*").alias("n")))
    at = held.select("f", "rep")

    def edges(pairs: DataFrame, node: DataFrame) -> DataFrame:
        return pairs.join(node.toDF("a", "u"), "a").join(node.toDF("b", "v"), "b").select("u", "v")

    several = own.join(at, own["__f0"] == at["f"]).groupBy("__id").agg(F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
    first = components(edges(stars(held, max_bits), at).union(several.select(F.col("__id").alias("u"), F.explode("reps").alias("v"))))
    rooted = cut(held.join(first.toDF("rep", "root"), "rep", "left").select("f", F.coalesce("root", "rep").alias("root")))
    last = components(edges(links(rooted, max_bits, "root"), rooted))
    whole = rooted.join(last.toDF("root", "end"), "root", "left").select("f", F.coalesce("end", "root").alias("component_id"))
    return found.join(whole, found["__f0"] == whole["f"], "left").select("__id", "__key", F.col("__f0").alias("fingerprint"), F.when(F.col("__id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs without all but one row of each group of near copies: the smallest id stays.

    Rows that repeat an id: the one whose text hashes lowest stays, once. Rows with a null id all stay. Columns pass
    through, whatever their names.
    """
    return first_of_groups(docs, near_groups(docs, id_col, text_col, shingle, max_bits), id_col, text_col)


def first_of_groups(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of groups (__id, __key, component_id), as near_dedup keeps it."""
    stay = groups.where("component_id = __id").groupBy("__id").agg(F.min("__key").alias("__key"))
    # the caller's columns travel as one, so their names meet none of those made here
    keyed = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("__row"), F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__key"))
    one = keyed.where(F.col("__id").isNotNull()).join(stay, ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"])
    return one.unionByName(keyed.where(F.col("__id").isNull())).select("__row.*")


def op3_simhash(docs: DataFrame) -> DataFrame:
    """The columns of the query: doc_id, fingerprint (16 hex digits), component_id."""
    out = near_groups(docs.select("doc_id", "text"))
    return out.select(F.col("__id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
