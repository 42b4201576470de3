"""Models with a limited context run over texts of any length: windows and chunks as rows, batched across documents.

A text's tokens are cut inside the row; each window travels as a row of its own, so a text of a million tokens is many
small units of work and short texts share a batch. Windows of a batch are of similar length, so a model that pads wastes
little. What a model returns is put in its place by token position; a text is scored as if in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..config import EngineConfig
from ..functions import text as T
from ..session import ship
from .signals import TOKENS, chunk_probability, classifier_chunks, lm_windows

TOKEN = "array<struct<token:int,start:int,end:int>>"
#: Tokens of a batch, padding included.
BATCH_TOKENS = 16_384


def tokenized(docs: DataFrame, load: Callable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens) by a model's own tokenizer: load() runs once per worker and returns a function from a text to (token, start, end) of its tokens."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = None
        for b in batches:
            cut = cut or load()
            rows = [[dict(zip(("token", "start", "end"), t, strict=True)) for t in cut(x.as_py() or "")] for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, pa.list_(pa.struct([("token", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))], names=["id", "tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, tokens {TOKEN}").withColumnRenamed("id", id_col)


def batches_of(sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of items in batches of rising size whose padded total stays within `most`; an item above it is a batch of its own."""
    order = np.argsort(sizes, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and sizes[order[hi]] * (hi + 1 - lo) <= most:
            hi += 1
        yield order[lo:hi]
        lo = hi


def _units(rows: DataFrame, spans: Column, id_col: str) -> DataFrame:
    """A row for each span (first, start, end) of a text's tokens, dealt over all tasks; tokens are those from `first` on."""
    units = T.exploded(rows.select(id_col, "tokens"), [id_col, "tokens"], spans, "w", "unit")
    own = units.select(F.col(id_col).alias("id"), "unit", "w.start", "w.first", F.slice("tokens", F.col("w.first") + 1, F.col("w.end") - F.col("w.first")).alias("tokens"))
    return own.repartition("id", "unit")


def window_statistics(rows: DataFrame, load: Callable, id_col: str = "doc_id", config: EngineConfig = EngineConfig(), batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """TOKENS rows of every token but a text's first, from a pair of language models with a limited context.

    rows: (id, tokens), tokens an array of (token, start, end). load() runs once per worker and returns a function from a
    list of windows (arrays of tokens) to a (ppl, xppl) pair of arrays each: one value for each token but the first,
    from no more than the tokens before it. A window brings config.lm_context tokens that are not scored again.
    Texts of fewer than two tokens have no rows.
    """
    ship(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            model = model or load()
            lists = b.column("tokens")
            flat, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            ids, begin, end = (flat.field(k).to_numpy() for k in ("token", "start", "end"))
            fresh = b.column("start").to_numpy()
            skip = fresh - b.column("first").to_numpy()  # tokens of context
            for own in batches_of(np.diff(bounds), batch_tokens):
                found = model([ids[bounds[i] : bounds[i + 1]] for i in own])
                out: list[list[np.ndarray]] = [[], [], [], [], [], []]
                for i, (ppl, xppl) in zip(own.tolist(), found, strict=True):
                    n, at = int(bounds[i + 1] - bounds[i]) - skip[i], slice(bounds[i] + skip[i], bounds[i + 1])
                    for column, values in zip(out, (np.full(n, i), fresh[i] + np.arange(n), begin[at], end[at], np.asarray(ppl, float)[skip[i] - 1 :], np.asarray(xppl, float)[skip[i] - 1 :]), strict=True):
                        column.append(values)
                of, pos, lo, hi, ppl, xppl = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(of)), *(pa.array(x.astype(np.int32)) for x in (pos, lo, hi)), pa.array(ppl), pa.array(xppl)], names=["doc_id", "pos", "start", "end", "ppl", "xppl"])

    spans = F.transform(lm_windows(F.size("tokens"), config), lambda w: F.struct(w["context_start"].alias("first"), w["start"].alias("start"), w["end"].alias("end")))
    units = _units(rows, spans, id_col)
    return units.mapInArrow(run, TOKENS.replace("doc_id long", f"doc_id {kind}")).withColumnRenamed("doc_id", id_col)


def chunk_probabilities(rows: DataFrame, load: Callable, id_col: str = "doc_id", config: EngineConfig = EngineConfig(), batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """(id, chunk, len, p) of every chunk of a text's tokens, from a classifier of limited length.

    load() runs once per worker and returns a function from a list of chunks (arrays of tokens) to their probabilities.
    A last chunk under a quarter of the length is replaced by the text's last full length of tokens.
    """
    ship(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            model = model or load()
            lists = b.column("tokens")
            ids, sizes = lists.flatten().field("token").to_numpy(), lists.value_lengths().to_numpy()
            bounds, p = np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(sizes))
            for own in batches_of(sizes, batch_tokens):
                p[own] = model([ids[bounds[i] : bounds[i + 1]] for i in own])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("unit"), pa.array(sizes.astype(np.int32)), pa.array(p)], names=["id", "chunk", "len", "p"])

    spans = F.transform(classifier_chunks(F.size("tokens"), config), lambda w: F.struct(w["start"].alias("first"), w["start"].alias("start"), w["end"].alias("end")))
    return _units(rows, spans, id_col).mapInArrow(run, f"id {kind}, chunk int, len int, p double").withColumnRenamed("id", id_col)


def text_probability(rows: DataFrame, load: Callable, id_col: str = "doc_id", config: EngineConfig = EngineConfig()) -> DataFrame:
    """(id, classifier_p): the chunks' probabilities, weighted by length; null for a text without tokens."""
    return chunk_probability(chunk_probabilities(rows, load, id_col, config), id_col)
