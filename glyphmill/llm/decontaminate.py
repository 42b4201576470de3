"""Benchmark decontamination: a prefix-filtered set join with exact verification over item-sized windows.

Each benchmark window is a set of word shingles. A first pass counts in how many documents each benchmark
shingle occurs; a window's prefix is its rarest shingle (exact containment needs one). The second pass looks
up prefix shingles in the documents, places the window by the shingle's offset, drops places that do not fit
the text (length and position), and compares the window's words exactly. Documents are never shuffled.

The benchmark goes to executors as arrays, about eight bytes for each byte of its text. It is cut into blocks by
measured size; all blocks are counted in one pass and looked up in one pass, a stage of Python for each block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship
from .common import beside, packed
from .wordblocks import Words, byte_classes, gram_hashes, pieces

SHINGLE, WINDOW = 5, 10
#: Bytes of benchmark text in a block, and shingles that are counted in one pass at most.
BLOCK_BYTES, COUNTED = 8 << 20, 1 << 24


@dataclass
class Block:
    """Distinct windows of a block of items, by number: start and size in its words, and the items that hold it.

    text: the folded words joined by blanks; begin: where each word begins in it, and where one more would. grams: shingle hashes by width
    and start word. items: ids; of, first: items of window w are of[first[w]:first[w + 1]].
    """

    text: bytes
    begin: np.ndarray
    grams: dict[int, np.ndarray]
    start: np.ndarray
    size: np.ndarray
    items: list
    of: np.ndarray
    first: np.ndarray

    def window(self, w: int) -> bytes:
        return self.text[self.begin[self.start[w]] : self.begin[self.start[w] + self.size[w]] - 1]

    def width(self) -> np.ndarray:
        return np.minimum(self.size, SHINGLE)

    def shingles(self) -> dict[int, np.ndarray]:
        """The distinct shingle hashes of all windows, sorted, by width."""
        out = {}
        for n in np.unique(self.width()).tolist():
            own = self.width() == n
            spots = [self.start[own & (self.size == m)][:, None] + np.arange(m - n + 1) for m in np.unique(self.size[own]).tolist()]
            out[n] = np.unique(np.concatenate([self.grams[n][x].reshape(-1) for x in spots]))
        return out


def item_windows(ids: list, texts: pa.Array, window: int = WINDOW) -> Block:
    words = Words(texts, "alnum_fold")
    sizes = words.ends - words.starts
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text = np.full(begin[-1], 32, np.uint8)
    text[np.repeat(begin[:-1], sizes) + within] = byte_classes("alnum_fold")[1][words.data[np.repeat(words.starts, sizes) + within]]
    hashes, other = words.hashes(0), words.hashes(1)
    size = np.minimum(words.counts, window)
    many = np.where(size > 0, words.counts - size + 1, 0)  # windows by item
    item = np.repeat(np.arange(len(ids)), many)
    start = words.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
    size = size[item]
    digest = np.zeros((len(start), 2), np.uint64)
    for n in np.unique(size).tolist():
        own = size == n
        digest[own] = np.stack([gram_hashes(hashes, n)[start[own]], gram_hashes(other, n, 1)[start[own]]], axis=1)
    order = np.lexsort((digest[:, 1], digest[:, 0], size))
    same = np.zeros(len(order), bool)
    same[1:] = (size[order][1:] == size[order][:-1]) & (digest[order][1:] == digest[order][:-1]).all(axis=1)
    one = order[~same]
    pairs = np.unique((np.cumsum(~same) - 1) * max(1, len(ids)) + item[order])  # (window, item) as one number
    of, held = np.divmod(pairs, max(1, len(ids)))
    first = np.searchsorted(of, np.arange(len(one) + 1))
    grams = {n: gram_hashes(hashes, n) for n in np.unique(np.minimum(size, SHINGLE)).tolist()}
    return Block(text.tobytes(), begin, grams, start[one], size[one], ids, held, first)


class Lookup:
    """Membership of 64-bit hashes in a sorted array, behind a bitmap that answers most misses."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = np.uint64((1 << min(26, max(20, (16 * len(keys)).bit_length()))) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[(keys & self.mask).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, their keys' indices)."""
        at = np.flatnonzero(self.bits[(h & self.mask).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[k] == h[at]
        return at[ok], k[ok]


def _count_map(shared):
    def run(batches):
        keys = shared.value
        look = {n: Lookup(k) for n, k in keys.items()}
        total = {n: np.zeros(len(k), np.int64) for n, k in keys.items()}
        for piece in pieces(batches, "text"):
            words = Words(piece.column("text"), "alnum_fold")
            hashes, of = words.hashes(), words.text_of()
            for n, f in look.items():
                at, k = f(gram_hashes(hashes, n))
                ok = of[at] == of[at + n - 1]
                pairs = np.unique(of[at[ok]].astype(np.int64) * len(keys[n]) + k[ok])
                total[n] += np.bincount(pairs % len(keys[n]), minlength=len(keys[n]))
        for n, t in total.items():
            k = np.flatnonzero(t)
            for lo in range(0, len(k), 1 << 16):
                part = k[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), n), pa.int32()), pa.array(part, pa.int64()), pa.array(t[part], pa.int64())], names=["width", "k", "docs"])

    return run


def _counted(docs: DataFrame, text_col: str, keys: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """In how many rows of docs each of keys (shingle hashes by width) occurs, in one pass."""
    out = {n: np.zeros(len(k), np.int64) for n, k in keys.items()}
    if any(map(len, keys.values())):
        shared = docs.sparkSession.sparkContext.broadcast(keys)
        found = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_map(shared), "width int, k long, docs long")
        got = found.groupBy("width", "k").agg(F.sum("docs").alias("docs")).toArrow()  # at most one row per key
        width, k, docs_of = (got.column(c).to_numpy() for c in ("width", "k", "docs"))
        for n in out:
            out[n][k[width == n]] = docs_of[width == n]
    return out


def _prefixes(block: Block, keys: dict[int, np.ndarray], docs: dict[int, np.ndarray]) -> dict[int, tuple]:
    """By shingle width: (sorted prefix hashes, start of each one's windows, windows, offsets). Windows with a shingle that no document holds are left out.

    Of shingles in as many documents the one of the smallest hash is the prefix.
    """
    found: dict[int, list] = {}
    for m in np.unique(block.size).tolist():
        n = min(SHINGLE, m)
        w = np.flatnonzero(block.size == m)
        h = block.grams[n][block.start[w][:, None] + np.arange(m - n + 1)]
        held = docs[n][np.searchsorted(keys[n], h)]
        use = held.min(axis=1) > 0
        w, h, held = w[use], h[use], held[use]
        offset = np.where(held == held.min(axis=1, keepdims=True), h, np.uint64((1 << 64) - 1)).argmin(axis=1) if len(w) else np.zeros(0, np.int64)
        found.setdefault(n, []).append((h[np.arange(len(w)), offset], w, offset))
    out = {}
    for n, parts in found.items():
        h, w, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((w, h))
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        out[n] = (h[first], np.append(first, len(h)), w[order], offset[order])
    return out


def _hits(words: Words, block: Block, prefixes: dict[int, tuple], look: dict[int, Lookup]):
    """(start word, window, its size) of every exact occurrence."""
    hashes, of = words.hashes(), words.text_of()
    for n, (_, first, windows, offsets) in prefixes.items():
        at, k = look[n](gram_hashes(hashes, n))
        for lo in range(0, len(at), 1 << 16):  # a common prefix may stand for many windows
            p, key = at[lo : lo + (1 << 16)], k[lo : lo + (1 << 16)]
            many = first[key + 1] - first[key]
            which = np.repeat(first[key], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            p, w = np.repeat(p, many), windows[which]
            size, start = block.size[w], p - offsets[which]
            ok = (start >= words.first[of[p]]) & (start + size <= words.first[of[p] + 1])
            for s, x, m in zip(start[ok].tolist(), w[ok].tolist(), size[ok].tolist(), strict=True):
                if b" ".join(words.words(s, s + m)) == block.window(x):
                    yield s, x, m


def _hit_map(shared, names: list[str]):
    text_name, words_name, items_name, spans_name = names

    def run(batches):
        block, prefixes = shared.value
        look = {n: Lookup(v[0]) for n, v in prefixes.items()}
        for piece in pieces(batches, text_name):
            words = Words(piece.column(text_name), "alnum_fold")
            of = words.text_of()
            items: list[set] = [set(x or ()) for x in piece.column(items_name).to_pylist()]
            spans: list[list] = [list(x or ()) for x in piece.column(spans_name).to_pylist()]
            for s, w, m in _hits(words, block, prefixes, look):
                text = int(of[s])
                items[text].update(block.items[i] for i in block.of[block.first[w] : block.first[w + 1]])
                spans[text].append((s - int(words.first[text]), s - int(words.first[text]) + m))
            out = {n: piece.column(n) for n in piece.schema.names}
            out[words_name] = pa.array(words.counts, pa.int64())
            out[items_name] = pa.array([sorted(x, key=str) or None for x in items], piece.schema.field(items_name).type)
            out[spans_name] = pa.array([_merged(x) if x else None for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def _merged(spans: list) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) if isinstance(s, dict) else s for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, counted: int = COUNTED) -> DataFrame:
    """Every row of docs with n_words, n_hit, spans (merged word ranges that windows cover), items (ids of items with occurring windows), contaminated.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. A window is 10 consecutive item words; a
    shorter item that has words is one window. Null texts have no words; items with a null id take no part; items
    that repeat an id count once; ties in rarity go to the smaller hash. Empty tables: no hits. Columns of docs pass
    through, whatever their names (result columns replace input columns of the same name).

    The benchmark's size is measured first. It is broadcast in blocks of about block_bytes of text, so what a Python
    worker holds is bounded; up to `counted` shingles take one counting pass, and the look-ups of all blocks one more.
    """
    spark = docs.sparkSession
    ship(spark)
    bench = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    kind = bench.schema["item"].dataType.simpleString()

    def block_of(b: int) -> Block:
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).distinct().toArrow()
        return item_windows(part.column("item").to_pylist(), part.column("text").combine_chunks() if part.num_rows else pa.array([], pa.string()))

    made = ("n_words", "n_hit", "spans", "items", "contaminated")
    old = beside(docs.columns, *made)
    names = ("__text", "__words", "__items", "__spans")
    fresh = (F.lit(0).cast("long"), F.lit(None).cast(f"array<{kind}>"), F.lit(None).cast("array<struct<start:bigint,end:bigint>>"))
    rows, back = packed(docs, old, F.col(text_col).alias(names[0]), *[x.alias(n) for x, n in zip(fresh, names[1:], strict=True)])
    group: list[int] = []
    keys: dict[int, np.ndarray] = {}
    for b in range(blocks):
        group.append(b)
        block = block_of(b)
        own = block.shingles()
        keys = {n: np.union1d(keys.get(n, np.zeros(0, np.uint64)), own.get(n, np.zeros(0, np.uint64))) for n in {*keys, *own}}
        if b == blocks - 1 or sum(map(len, keys.values())) >= counted:
            docs_of = _counted(docs, text_col, keys)
            for g in group:
                held = block if g == b else block_of(g)  # two blocks at a time are held here at most
                shared = spark.sparkContext.broadcast((held, _prefixes(held, keys, docs_of)))
                rows = rows.mapInArrow(_hit_map(shared, names), rows.schema)
            group, keys = [], {}
    hit = F.aggregate(names[3], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return back(
        rows,
        F.col(names[1]).alias("n_words"),
        F.coalesce(hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(names[3], F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.coalesce(names[2], F.array().cast(f"array<{kind}>")).alias("items"),
        F.col(names[3]).isNotNull().alias("contaminated"),
    )


def op8_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    out = decontaminate(docs.select("doc_id", "text"), benchmark)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ispots AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS t, least(len(w), 10) AS n FROM ispots),
sizes AS (SELECT DISTINCT n FROM windows),
dspots AS (SELECT d.doc_id, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS i FROM dw d, sizes s WHERE len(d.w) >= s.n),
found AS (SELECT d.doc_id, d.i, d.n, v.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM dspots) d JOIN windows v ON d.t = v.t AND d.n = v.n),
hits AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hits h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""
