"""Substring dedup by difference-cover anchors.

A word window of `window` words is a repeat if it also starts in a text of a smaller id. Instead of moving
every window, only anchors move: hashes of `window - period + 1` words that start at positions whose
remainder modulo `period` lies in a difference cover. For any two places i, j of one window some shift below
`period` puts both i + shift and j + shift on the cover, so each repeated window holds an aligned anchor that
occurs twice. Windows that hold such an anchor are extended to full length and compared by 80-bit hashes.

Rows between tasks are numpy arrays packed per (piece of the input, bucket of the hash), about seven bytes an anchor;
answers come back the same way. Each piece sends a hash once however often it holds it, so a passage in a third of all texts
costs its bucket one entry per piece of 8 MB. A piece that sees a repeat itself settles it. There is a bucket for every
BUCKET_BYTES of text, so what a task unpacks is bounded: about 60 bytes an anchor, or four times BUCKET_BYTES.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship
from .common import partitions, with_row_key
from .wordblocks import Words, gram_hashes, mix, pieces, planes, unplanes, within_text

PLACES = "bucket int, ids binary, keys binary, sizes binary, gaps binary"
PACKED = PLACES + ", tag binary, extra binary, known binary"
FOUND = "__id long, __key long, __pos binary"
LOW40 = np.uint64((1 << 40) - 1)
#: Bytes of text whose hashes make a bucket, on average.
BUCKET_BYTES = 64 << 20


def cover(window: int) -> tuple[int, tuple[int, ...]]:
    """(period, difference cover) for a window; anchors have window - period + 1 words."""
    if window >= 13:
        return 7, (0, 1, 3)
    return (3, (0, 1)) if window >= 5 else (1, (0,))


def _columns(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False)


def _ids(b: pa.RecordBatch) -> np.ndarray:
    """(id, low half of the text hash) by row."""
    return np.stack([_columns(b, "__id"), _columns(b, "__key") & 0xFFFFFFFF], axis=1).astype(np.int64)


def pack_places(ids: np.ndarray, owner: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """(ids, keys, sizes, gaps) of places that are sorted by owner (a row of ids) and position: differences, which compress."""
    used, first, sizes = np.unique(owner, return_index=True, return_counts=True)
    gaps = np.diff(pos, prepend=0)
    gaps[first] = pos[first]
    step = np.diff(ids[used, 0], prepend=0)
    return planes(((step << 1) ^ (step >> 63)).view(np.uint64), 8), planes(ids[used, 1], 4), planes(sizes, 4), planes(gaps, 4)


def unpack_places(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, owner, position) of a packed row."""
    step, sizes, gaps = unplanes(r["ids"], 8), unplanes(r["sizes"], 4).astype(np.int64), unplanes(r["gaps"], 4).astype(np.int64)
    ids = np.cumsum((step >> np.uint64(1)).view(np.int64) ^ -(step & np.uint64(1)).view(np.int64))
    first = np.cumsum(sizes) - sizes
    total = np.cumsum(gaps)
    return np.stack([ids, unplanes(r["keys"], 4).view(np.int64)], axis=1), np.repeat(np.arange(len(sizes)), sizes), total - np.repeat(total[first] - gaps[first], sizes)


def _edges(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket, bounds of each bucket's run in it)."""
    order = np.argsort(bucket, kind="stable")
    return order, np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32(), *[pa.binary()] * (len(names) - 1)]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _entries(ids: np.ndarray, buckets: int, bucket: np.ndarray, tag: np.ndarray, extra: np.ndarray | None, owner: np.ndarray, pos: np.ndarray, known: np.ndarray) -> list[tuple]:
    """Packed rows of one piece, one for each bucket of the hashes; entries come sorted by owner and position."""
    order, edges = _edges(bucket, buckets)
    out = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        at = order[lo:hi]
        out.append((int(bucket[at[0]]), *pack_places(ids, owner[at], pos[at]), planes(tag[at], 8 if extra is not None else 5), None if extra is None else planes(extra[at], 2), np.packbits(known[at]).tobytes()))
    return out


def _settled(ids: np.ndarray, buckets: int, owner: np.ndarray, pos: np.ndarray) -> list[tuple]:
    """A row of places that need no answer from elsewhere (it has no tags)."""
    return [(int(ids[0, 0] % buckets), *pack_places(ids, owner, pos), None, None, None)] if len(owner) else []


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start of each run of equal keys in it, run of each sorted entry)."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _answers(ids: np.ndarray, owner: np.ndarray, pos: np.ndarray, buckets: int) -> list[tuple]:
    """Places packed by bucket of their ids."""
    order = np.lexsort((pos, owner))
    owner, pos = owner[order], pos[order]
    bucket = (mix(ids[:, 0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)[owner]
    order, edges = _edges(bucket, buckets)
    return [(int(bucket[order[lo]]), *pack_places(ids, owner[order[lo:hi]], pos[order[lo:hi]])) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def _reduce(decide, buckets: int):
    """Answers of a partition: settled places, and the entries that decide picks, packed by bucket of their ids."""

    def run(batches):
        ids, owners, poss, entries, n = [], [], [], [], 0
        for b in batches:
            for r in b.to_pylist():
                own, owner, pos = unpack_places(r)
                owner = owner + n
                n += len(own)
                ids.append(own)
                if r["tag"] is None:
                    owners.append(owner)
                    poss.append(pos)
                    continue
                size = len(owner)
                extra = np.zeros(size, np.uint64) if r["extra"] is None else unplanes(r["extra"], 2)
                known = np.unpackbits(np.frombuffer(r["known"], np.uint8), count=size).astype(bool)
                entries.append((owner, pos, unplanes(r["tag"], 5 if r["extra"] is None else 8), extra, np.full(size, r["bucket"], np.uint64), known))
        if not ids:
            return
        all_ids = np.concatenate(ids)
        if entries:
            owner, pos, *keys = (np.concatenate(x) for x in zip(*entries, strict=True))
            hit = decide(all_ids[owner, 0], *keys)
            owners.append(owner[hit])
            poss.append(pos[hit])
        owner, pos = np.concatenate(owners), np.concatenate(poss)
        if len(owner):
            yield _batch(_answers(all_ids, owner, pos, buckets), PLACES)

    return run


def _anchor_repeats(own, tag, extra, bucket, known) -> np.ndarray:
    order, begin, run_of = _runs((bucket << np.uint64(40)) | tag)
    return order[(np.diff(begin, append=len(order)) > 1)[run_of] & ~known[order]]


def _window_repeats(own, tag, extra, bucket, known) -> np.ndarray:
    order, begin, run_of = _runs(tag, (bucket << np.uint64(16)) | extra)
    return order[own[order] > np.minimum.reduceat(own[order], begin)[run_of]]


def _merge(batches):
    """One row for each id and key of the partition, with its positions."""
    ids, owners, poss, n = [], [], [], 0
    for b in batches:
        for r in b.to_pylist():
            own, owner, pos = unpack_places(r)
            ids.append(own)
            owners.append(owner + n)
            poss.append(pos)
            n += len(own)
    if not ids:
        return
    all_ids, owner, pos = np.concatenate(ids), np.concatenate(owners), np.concatenate(poss)
    order = np.lexsort((all_ids[owner, 1], all_ids[owner, 0]))
    key, pos = all_ids[owner[order]], pos[order].astype("<u4")
    begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
    for lo in range(0, len(begin), 4096):
        at = begin[lo : lo + 4096]
        ends = np.append(begin[lo + 1 : lo + 4097], len(key))[: len(at)]
        yield pa.RecordBatch.from_arrays([pa.array(key[at, 0]), pa.array(key[at, 1]), pa.array([pos[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())], names=["__id", "__key", "__pos"])


def _anchor_map(window: int, buckets: int):
    period, at = cover(window)

    def run(batches):
        for piece in pieces(batches, "__text"):
            words = Words(piece.column("__text"), "space")
            n = window - period + 1
            hashes = gram_hashes(words.hashes(), n)
            of = words.text_of()[: len(hashes)]
            pos = np.arange(len(hashes)) - words.first[of]
            use = np.flatnonzero(within_text(words, n) & (words.counts[of] >= window) & np.isin(pos % period, at))
            h, of, pos = hashes[use], of[use], pos[use]
            if not len(h):
                continue
            order, begin, run_of = _runs(h)
            many = np.diff(begin, append=len(h)) > 1
            here = np.sort(order[many[run_of]])  # repeats that this piece sees itself
            one = order[begin]
            back = np.argsort(one)
            one, many = one[back], many[back]
            ids = _ids(piece)
            ids[:, 1] = 0  # a place too many is harmless here: no need to tell rows of one id apart
            rows = _entries(ids, buckets, ((h[one] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), h[one] & LOW40, None, of[one], pos[one], many)
            yield _batch(rows + _settled(ids, buckets, of[here], pos[here]), PACKED)

    return run


def _marked(words: Words, lists: list[list[bytes]], back: int, span: int) -> np.ndarray:
    """Per word, whether it lies in [p - back, p - back + span) of a listed position p of its text, cut to the text."""
    lo, hi = [], []
    for text, found in enumerate(lists):
        if found:
            p = np.frombuffer(b"".join(found), "<u4").astype(np.int64) + words.first[text]
            lo.append(np.maximum(p - back, words.first[text]))
            hi.append(np.minimum(p - back + span, words.first[text + 1]))
    if not lo:
        return np.zeros(len(words), bool)
    size = len(words) + 1
    return np.cumsum(np.bincount(np.concatenate(lo), minlength=size) - np.bincount(np.concatenate(hi), minlength=size))[:-1] > 0


def _window_map(window: int, buckets: int):
    period, _ = cover(window)

    def run(batches):
        for piece in pieces(batches, "__text"):
            words = Words(piece.column("__text"), "space")
            if len(words) < window:
                continue
            begin = _marked(words, piece.column("__found").to_pylist(), period - 1, period)[: len(words) - window + 1]
            use = np.flatnonzero(begin & within_text(words, window))
            if not len(use):
                continue
            w1, w2 = gram_hashes(words.hashes(0), window)[use], gram_hashes(words.hashes(1), window, 1)[use]
            of = words.text_of()[use]
            pos, ids = use - words.first[of], _ids(piece)
            order, starts, run_of = _runs(w1, w2)
            own = ids[of[order], 0]
            least = np.minimum.reduceat(own, starts)[run_of]
            keep, gone = np.sort(order[own == least]), np.sort(order[own > least])
            rows = _entries(ids, buckets, ((w2[keep] >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64), w1[keep], w2[keep] & np.uint64(0xFFFF), of[keep], pos[keep], np.zeros(len(keep), bool))
            yield _batch(rows + _settled(ids, buckets, of[gone], pos[gone]), PACKED)

    return run


def _cut_map(window: int):
    def run(batches):
        for piece in pieces(batches, "__text"):
            words = Words(piece.column("__text"), "space")
            keys, lists = _ids(piece)[:, 1], []
            for key, found in zip(keys, piece.column("__gone").to_pylist(), strict=True):
                lists.append([x["__pos"] for x in found or () if x["__key"] == key])
            gone = _marked(words, lists, 0, window)
            removed, kept = [], []
            for i, found in enumerate(lists):
                raw = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes().split()
                if found:
                    flags = gone[words.first[i] : words.first[i + 1]]
                    raw = [raw[k] for k in np.flatnonzero(~flags)]
                removed.append(int(words.counts[i]) - len(raw))
                kept.append(b" ".join(raw))
            yield pa.RecordBatch.from_arrays([piece.column("__id"), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["__id", "n_words", "n_removed", "kept"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept (its remaining words joined by one space).

    Words are [^\\x20\\x09-\\x0D]+, unchanged. A word goes if a window of `window` words covers it whose sequence
    also starts in a row with a smaller id; windows are judged on the input. Null text has no words. A null id
    takes no part: its rows keep all their words. Rows that repeat an id never remove each other's words. Other
    columns are not read, so their names can't clash; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    base = with_row_key(docs, id_col, text_col).where(F.col("__id").isNotNull())
    size = base.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    buckets = max(partitions(spark), -(-size // BUCKET_BYTES))

    def exchange(rows: DataFrame, decide) -> DataFrame:
        answers = rows.repartitionById(buckets, F.col("bucket")).mapInArrow(_reduce(decide, buckets), PLACES)
        return answers.repartitionById(buckets, F.col("bucket")).mapInArrow(_merge, FOUND)

    found = exchange(base.mapInArrow(_anchor_map(window, buckets), PACKED), _anchor_repeats).groupBy("__id").agg(F.collect_list("__pos").alias("__found"))
    windows = base.join(found, "__id").mapInArrow(_window_map(window, buckets), PACKED)
    gone = exchange(windows, _window_repeats).groupBy("__id").agg(F.collect_list(F.struct("__key", "__pos")).alias("__gone"))
    out = "__id long, n_words long, n_removed long, kept string"
    whole = base.join(gone, "__id", "left").mapInArrow(_cut_map(window), out)
    loose = with_row_key(docs, id_col, text_col).where(F.col("__id").isNull()).withColumn("__gone", F.lit(None).cast("array<struct<__key:bigint,__pos:binary>>"))
    return whole.union(loose.mapInArrow(_cut_map(window), out)).withColumnRenamed("__id", id_col)


def op9_substring_dedup(docs: DataFrame) -> DataFrame:
    """The digest columns of the query: doc_id, n_words, n_removed, kept_sha256."""
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM spots),
least AS (SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN least USING (h) WHERE doc_id > first_id),
gone_of AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM words),
kept AS (SELECT e.doc_id, string_agg(e.x, ' ' ORDER BY e.p) AS t FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p WHERE g.p IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(g.ps), 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN gone_of g USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
