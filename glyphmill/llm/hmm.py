"""Texts scored by a hidden Markov language model, beside a smoothed unigram one.

Every word of every text is counted. Words that hold an OWN-th of all tokens or more are symbols of their own; the others
are symbols by their ending, and a word's share of its ending's tokens follows from the counts. So the model is a distribution
over all words, while what tasks hold of it is bounded by counting: at most OWN + ENDINGS symbols. The counts themselves are
a table that no task holds: words of a LOOKUP-th of all tokens or more (at most LOOKUP) travel to the tasks, the rest
meet their counts in a shuffle, in which by the same counting no word is frequent.

Baum-Welch: each pass sums the expected transitions and emissions of all training texts over tasks; a few passes over
one training text in WARM come first, from which the passes over all of them start. Within a task texts are cut into
chunks that run side by side; chunks of one text are tied together by their transfer matrices, so likelihoods and counts
are those of the whole text and no long text holds up its task.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship
from .common import shared_dir
from .wordblocks import Words, byte_classes, pieces

#: Latent states; bounds of the words that are symbols and of those that tasks look up; symbols of word endings, and bytes of an ending.
STATES, OWN, LOOKUP, ENDINGS, ENDING = 8, 1 << 17, 1 << 20, 4096, 3
#: One training text in WARM starts the model, in WARM_PASSES passes; then PASSES over all. Share of the unigram distribution in each state's.
WARM, WARM_PASSES, PASSES, SHARE = 32, 10, 2, 0.01
#: Tokens of a chunk, tokens that a task works on at once in passes, bytes of text that are split at once, distinct words counted before they are sent on.
CHUNK, BATCH, PIECE, HELD_WORDS = 2048, 400_000, 1 << 21, 750_000
#: The end of a text as a token; no word holds a blank.
END = b" "
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def _parts(texts: pa.Array) -> Iterator[tuple[pa.Array, bool]]:
    """(texts, whether they end there): a text longer than PIECE alone in parts that are cut at white space, others as they are."""
    text = texts[0].as_py() or b""
    if len(texts) > 1 or len(text) <= PIECE:
        yield texts, True
        return
    at = 0
    while len(text) - at > PIECE and (found := _BLANK.search(text, at + PIECE)):
        yield pa.array([text[at : found.start()]], pa.binary()), False
        at = found.start()
    yield pa.array([text[at:]], pa.binary()), True


def tokens(texts: pa.Array, ends: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct tokens, the end of a text first; which of them is each token; tokens of each text): words, A-Z lower-cased, then the end."""
    found = Words(texts, "space_fold")
    is_word, fold = byte_classes("space_fold")
    places = np.concatenate([[0], np.cumsum(found.ends - found.starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(places), pa.py_buffer(fold[found.data[is_word[found.data]]])]).dictionary_encode()
    distinct = pa.concat_arrays([pa.array([END], pa.large_binary()), words.dictionary]).cast(pa.binary())
    sizes = found.counts + int(ends)
    which, is_end = np.zeros(int(sizes.sum()), np.int64), np.zeros(int(sizes.sum()), bool)
    is_end[np.cumsum(sizes)[: len(sizes) * int(ends)] - 1] = True
    which[~is_end] = words.indices.to_numpy() + 1
    return distinct, which, sizes


def ending(word: bytes) -> int:
    return zlib.crc32(word[-ENDING:]) % ENDINGS


def _ending(word: Column) -> Column:
    return (F.crc32(F.substring(word, -ENDING, ENDING)) % ENDINGS).cast("int")


def held_out(id_col: str = "doc_id", of: int = 7, left: int = 2) -> Column:
    """Whether crc32 of the id as text leaves `left` modulo `of`; null for a null id, which is neither held out nor learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of == left


def _stored(df: DataFrame, *by: str) -> DataFrame:
    """df written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hmm-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def summed() -> pa.Table:
        out = pa.Table.from_batches(held)
        return (out.group_by("word", use_threads=False).aggregate([("c", "sum"), ("a", "sum")]) if len(held) > 1 else out).rename_columns(["word", "c", "a"]).combine_chunks()

    for own in pieces(batches, "text", PIECE):
        train = own.column("train").to_numpy(zero_copy_only=False)
        for texts, ends in _parts(own.column("text")):
            words, which, sizes = tokens(texts, ends)
            a, c = (np.bincount(x, minlength=len(words)) for x in (which, which[np.repeat(train, sizes)]))
            some = np.flatnonzero(a)
            held.append(pa.RecordBatch.from_arrays([words.take(pa.array(some)), pa.array(c[some]), pa.array(a[some])], names=["word", "c", "a"]))
            size += len(some)
            if size > HELD_WORDS:
                held = summed().to_batches()
                size = sum(x.num_rows for x in held)
                if size > HELD_WORDS // 2:  # so that what is held is not summed up again with every piece
                    yield from held
                    held, size = [], 0
    if held:
        yield from summed().to_batches()


def vocabulary(docs: DataFrame, train: Column, text_col: str = "text") -> DataFrame:
    """(word, c, a): each word of docs, how often it is in training texts and in all; ends of texts are the word END."""
    rows = docs.select(F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_count, "word binary, c long, a long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


@dataclass
class Lexicon:
    """What tasks know of the words: those of a LOOKUP-th of all tokens or more, and totals.

    blob: those words; count: their training counts; own: which are symbols of their own (their number, else -1);
    tokens and types of the training texts; by ending: tokens and types of words that are not symbols; known: training
    tokens of each symbol.
    """

    blob: bytes
    count: np.ndarray
    own: np.ndarray
    tokens: int
    types: int
    ending_tokens: np.ndarray
    ending_types: np.ndarray
    known: np.ndarray

    @cached_property
    def words(self) -> list[bytes]:
        return self.blob.split(b"\n") if len(self.count) else []

    @cached_property
    def place(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    @cached_property
    def symbol(self) -> np.ndarray:
        return np.where(self.own >= 0, self.own, [ending(w) for w in self.words]).astype(np.int32)

    @cached_property
    def base(self) -> np.ndarray:
        return np.log10((self.count + 1) / (self.tokens + self.types + 1))

    @cached_property
    def share(self) -> np.ndarray:
        """log10 of a word's share of its symbol; 0 for a symbol of its own."""
        e = np.where(self.own >= 0, 0, self.symbol)
        return np.where(self.own >= 0, 0.0, np.log10((self.count + 1) / (self.ending_tokens[e] + self.ending_types[e] + 1)))


def lexicon(counts: DataFrame) -> Lexicon:
    """The lexicon of a vocabulary. Collected are words that hold a LOOKUP-th of all tokens or more, the end, and totals by ending."""
    n = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.coalesce(F.sum("a"), F.lit(0)).alias("a")).first()
    own = _own(n["a"])
    few = counts.where((F.col("a") * LOOKUP >= n["a"]) | own).select("word", "c", own.alias("own")).toArrow()
    order = sorted(range(few.num_rows), key=few.column("word").to_pylist().__getitem__)
    words = [few.column("word")[i].as_py() for i in order]
    count, mine = (few.column(c).to_numpy()[order] if order else np.zeros(0, np.int64) for c in ("c", "own"))
    number = np.where(mine, ENDINGS + np.cumsum(mine) - 1, -1) if order else np.zeros(0, np.int64)
    by = counts.where(~own & (F.col("c") > 0)).groupBy(_ending(F.col("word")).alias("e")).agg(F.sum("c").alias("t"), F.count("*").alias("v")).collect()
    size, kinds = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for r in by:
        size[r["e"]], kinds[r["e"]] = r["t"], r["v"]
    known = np.concatenate([size, count[number >= 0]])
    return Lexicon(b"\n".join(words), count, number, n["n"], n["v"], size, kinds, known)


def _own(total: int) -> Column:
    """Symbols of their own are words of an OWN-th of all tokens or more that training texts hold twice, and the end."""
    return ((F.col("a") * OWN >= total) & (F.col("c") >= 2)) | (F.col("word") == F.lit(END))


def encoded(docs: DataFrame, lex: Lexicon, train: Column, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id, held_out, part, n_tokens, n_known, base, share, ids, rare): texts as symbols, what the lexicon knows summed up, the other words listed.

    part: warm or rest for training texts, else none; a folder each, so passes read no more than they use.
    """
    warm = F.pmod(F.xxhash64(F.lit(13), F.col(id_col).cast("string")), F.lit(WARM)) == 0
    part = F.when(~F.coalesce(train, F.lit(False)), "none").when(warm, "warm").otherwise("rest")
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), F.coalesce(held, F.lit(False)).alias("held_out"), part.alias("part"), F.col(text_col).cast("binary").alias("text"))

    def coded(own: pa.RecordBatch) -> pa.RecordBatch:
        words, which, sizes = tokens(own.column("text"))
        get, bounds = lex.place.get, np.concatenate([[0], np.cumsum(sizes)])
        # of distinct words first: their place in the lexicon, -1 for others, and their symbols
        names = words.to_pylist()
        at = np.fromiter((get(w, -1) for w in names), np.int64, len(names))
        found, lost = at >= 0, np.flatnonzero(at < 0)
        symbols = np.empty(len(at), np.int32)
        symbols[found] = lex.symbol[at[found]]
        symbols[lost] = [ending(names[i]) for i in lost.tolist()]
        # what the lexicon knows of each token, 0 for others; summed up by text
        each = [np.where(found, x[at], 0) for x in (lex.count > 0, lex.base, lex.share)] if len(lex.count) else [np.zeros(len(at))] * 3
        known, base, share = (np.add.reduceat(x[which], bounds[:-1]) for x in each)
        rare = np.flatnonzero(~found[which])
        rows = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, bounds), pa.int32()), words.take(pa.array(which[rare])))
        columns = [pa.array(sizes.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base.astype(float)), pa.array(share.astype(float)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(symbols[which])), rows]
        return pa.RecordBatch.from_arrays([*(own.column(c) for c in ("key", "id", "held_out", "part")), *columns], names=["key", "id", "held_out", "part", "n_tokens", "n_known", "base", "share", "ids", "rare"])

    def run(batches):
        yield from map(coded, pieces(batches, "text", PIECE))

    return rows.mapInArrow(run, "key long, id long, held_out boolean, part string, n_tokens long, n_known long, base double, share double, ids array<int>, rare array<binary>")


@dataclass
class Model:
    """start and moves: probabilities of states; emit: of symbols (rows) in each state."""

    start: np.ndarray
    moves: np.ndarray
    emit: np.ndarray

    def log10(self, ids: np.ndarray, offsets: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
        """The log10 probability of each text: symbols ids[offsets[i]:offsets[i + 1]]."""
        return Sweep(self, ids, offsets, columns).likelihoods() / math.log(10)


@dataclass
class Expected:
    """Expected numbers of first states, of moves, and of symbols by state; log likelihood."""

    start: np.ndarray
    moves: np.ndarray
    emit: np.ndarray
    likelihood: float = 0.0

    @classmethod
    def none(cls, states: int, symbols: int) -> Expected:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))


class Sweep:
    """One batch of texts under a model, ids[offsets[i]:offsets[i + 1]] each, cut into chunks.

    Chunks run side by side, longest first, so those that still run are always the first ones. Of a text of several
    chunks the first and the last are run as they are; those between give a transfer matrix each, which tells what enters
    the chunks after them. States are rows and lanes columns, so sums over states add whole rows. columns: the model's
    emissions, a row a state, for callers with many batches.
    """

    def __init__(self, model: Model, ids: np.ndarray, offsets: np.ndarray, columns: np.ndarray | None = None):
        size = np.diff(offsets)
        many = -(-size // CHUNK)
        of = np.repeat(np.arange(len(size)), many)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        begin = offsets[:-1][of] + nth * CHUNK
        length = np.minimum(CHUNK, offsets[1:][of] - begin)
        order = np.argsort(-length, kind="stable")
        self.model, self.ids, self.texts = model, ids, len(size)
        self.of, self.nth, self.begin, self.length = of[order], nth[order], begin[order], length[order]
        self.last = self.nth == many[self.of] - 1
        self.long = many[self.of] > 1
        self.entry = np.tile(model.start, (len(of), 1))
        self.columns = np.ascontiguousarray(model.emit.T) if columns is None else columns

    def _steps(self, lanes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """(places of the lanes' symbols, step after step; where in them each step's begin and end). Lanes are in order of length."""
        begin, length = self.begin[lanes], self.length[lanes]
        live = np.searchsorted(-length, -np.arange(length.max(initial=0)), side="left")
        bounds = np.concatenate([[0], np.cumsum(live)])
        step = np.repeat(np.arange(len(live)), live)
        return begin[np.arange(bounds[-1]) - bounds[step]] + step, list(zip(bounds.tolist(), bounds[1:].tolist(), strict=False))

    def _emitted(self, at: np.ndarray) -> np.ndarray:
        """Probabilities of the symbols at these places, a row a state."""
        symbols = self.ids[at]
        return np.stack([column[symbols] for column in self.columns])

    def _forward(self, lanes: np.ndarray, keep: bool = False):
        """(states expected after the lanes, a row a state; log likelihoods; if kept the places and bounds of _steps, emissions, filtered states and scales)."""
        at, steps = self._steps(lanes)
        emit, back = self._emitted(at), np.ascontiguousarray(self.model.moves.T)
        states, scales = emit.copy() if keep else emit, np.empty(len(at))
        state = np.ascontiguousarray(self.entry[lanes].T)
        for lo, hi in steps:
            now = states[:, lo:hi]
            now *= state[:, : hi - lo]
            scale = np.add.reduce(now, axis=0, out=scales[lo:hi])
            now /= scale
            state[:, : hi - lo] = back @ now
        total = np.bincount(np.arange(len(at)) - np.repeat([lo for lo, _ in steps], [hi - lo for lo, hi in steps]), weights=np.log(scales), minlength=len(lanes)) if steps else np.zeros(len(lanes))
        return state, total, (at, steps, emit, states, scales)

    def _backward(self, lanes: np.ndarray) -> np.ndarray:
        """What whole lanes, each the end of its text, say of their first state, of sum 1; a row a lane."""
        at, steps = self._steps(lanes)
        emit, moves = self._emitted(at), self.model.moves
        rest = np.ones((len(moves), len(lanes)))
        done = 0
        for lo, hi in reversed(steps):
            b = hi - lo
            rest[:, :done] = moves @ rest[:, :done]
            rest[:, :b] *= emit[:, lo:hi]
            rest[:, :b] /= rest[:, :b].sum(axis=0)
            done = b
        return rest.T

    def _through(self, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(transfer matrices, logarithms of what they are to be multiplied by)."""
        emit, moves, ids = self.model.emit, self.model.moves, self.ids
        states = len(moves)
        through, logs = np.tile(np.eye(states), (len(lanes), 1, 1)), np.zeros((len(lanes), states))
        places, steps = self._steps(lanes)
        for lo, hi in steps:
            b, at = hi - lo, places[lo:hi]
            now = through[:b] * emit[ids[at]][:, None, :]
            scale = now.sum(axis=2)
            now /= scale[:, :, None]
            logs[:b] += np.log(scale)
            through[:b] = (now.reshape(-1, states) @ moves).reshape(b, states, states)
        most = logs.max(axis=1)
        return through * np.exp(logs - most[:, None])[:, :, None], most

    def _tie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What enters every chunk, into self.entry; (log likelihoods by text but for last chunks, lanes between, their matrices)."""
        found = np.zeros(self.texts)
        heads, between = np.flatnonzero(self.long & (self.nth == 0)), np.flatnonzero((self.nth > 0) & ~self.last)
        state, total, _ = self._forward(heads)
        found[self.of[heads]] = total
        through, most = self._through(between)
        after = np.zeros((self.texts, len(self.model.start)))
        after[self.of[heads]] = state.T
        place = np.full(len(self.of), -1)
        place[between] = np.arange(len(between))
        later = np.flatnonzero(self.nth > 0)
        for lane in later[np.lexsort((self.nth[later], self.of[later]))].tolist():
            text, k = self.of[lane], place[lane]
            self.entry[lane] = after[text]
            if k >= 0:
                now = after[text] @ through[k]
                total = now.sum()
                found[text] += math.log(total) + most[k]
                after[text] = now / total
        return found, between, through

    def likelihoods(self) -> np.ndarray:
        """The log likelihood of each text."""
        found = self._tie()[0] if self.long.any() else np.zeros(self.texts)
        ends = np.flatnonzero(self.last)
        found[self.of[ends]] += self._forward(ends)[1]
        return found

    def count(self, into: Expected) -> None:
        """Forward and backward over all chunks; expected numbers are added to into."""
        moves, ids = self.model.moves, self.ids
        lanes = np.arange(len(self.of))
        after = np.ones((len(lanes), len(moves)))  # what the rest of the text says of the state after the chunk
        if self.long.any():
            _, between, through = self._tie()
            ends = np.flatnonzero(self.long & self.last)
            rest = np.zeros((self.texts, len(moves)))
            rest[self.of[ends]] = self._backward(ends)
            place = np.full(len(lanes), -1)
            place[between] = np.arange(len(between))
            earlier = np.flatnonzero(~self.last)
            for lane in earlier[np.lexsort((-self.nth[earlier], self.of[earlier]))].tolist():
                text, k = self.of[lane], place[lane]
                after[lane] = rest[text]
                if k >= 0:
                    rest[text] = through[k] @ rest[text]
                    rest[text] /= rest[text].sum()
        _, total, (at, steps, emit, states, scales) = self._forward(lanes, keep=True)
        come = emit / scales  # what a step says of what comes before it, once what comes after it is known
        ended = np.where(self.last, 1.0, moves @ after.T)  # of each lane's last state
        enters = np.where(self.last, 0.0, after.T)
        weights, turns, back, done = states, np.zeros_like(moves), None, 0  # states become weights, last step first
        for t in range(len(steps) - 1, -1, -1):
            lo, hi = steps[t]
            b, now = hi - lo, states[:, lo:hi]
            ahead = np.empty((len(moves), b))
            if done:
                ahead[:, :done] = back
            if b > done:  # chunks that end here
                weight = (now[:, done:] * ended[:, done:b]).sum(axis=0)
                ahead[:, done:] = ended[:, done:b] / weight
                turns += now[:, done:] @ (enters[:, done:b] / weight).T
            if t:
                before = steps[t - 1][0]
                come[:, lo:hi] *= ahead
                turns += states[:, before : before + b] @ come[:, lo:hi].T
                back = moves @ come[:, lo:hi]
            now *= ahead
            if not t:
                into.start += now[:, self.nth[:b] == 0].sum(axis=1)
            done = b
        into.moves += turns * moves
        flat = ids[at]
        for k in range(len(moves)):
            into.emit[:, k] += np.bincount(flat, weights=weights[k], minlength=len(into.emit))
        into.likelihood += float(total.sum())


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their symbols, offsets), about BATCH tokens at a time; texts of like lengths go together, so that most run to the last step."""
    for b in batches:
        b = b.take(pa.array(np.argsort(b.column("ids").value_lengths().to_numpy(zero_copy_only=False), kind="stable")))
        sizes = b.column("ids").value_lengths().to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // BATCH
        for lo, hi in zip(first := np.flatnonzero(np.diff(part, prepend=-1)), [*first[1:], len(part)], strict=True):
            own = b.slice(lo, hi - lo)
            yield own, own.column("ids").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes[lo:hi])])


def expected(rows: DataFrame, model: Model) -> Expected:
    """The sum of what all texts of rows (ids) are expected to hold, one row a symbol from each task."""
    states, symbols = len(model.start), len(model.emit)

    def run(batches):
        total, columns = Expected.none(states, symbols), np.ascontiguousarray(model.emit.T)
        for _, ids, offsets in _batched(batches):
            Sweep(model, ids, offsets, columns).count(total)
        # symbols from 0; below them the likelihood, the first states and the moves
        rest = np.vstack([np.full(states, total.likelihood), total.start, total.moves])
        some = np.flatnonzero(total.emit.any(axis=1))
        names = np.concatenate([some, -1 - np.arange(len(rest))]).astype(np.int32)
        values = np.vstack([total.emit[some], rest])
        yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(np.ascontiguousarray(c)) for c in values.T)], names=["symbol", *(f"k{k}" for k in range(states))])

    kind = ", ".join(["symbol int", *(f"k{k} double" for k in range(states))])
    sums = rows.select("ids").mapInArrow(run, kind).groupBy("symbol").agg(*[F.sum(f"k{k}").alias(f"k{k}") for k in range(states)]).toArrow()
    out = Expected.none(states, symbols)
    if sums.num_rows:
        names, values = sums.column("symbol").to_numpy(), np.column_stack([sums.column(f"k{k}").to_numpy() for k in range(states)])
        out.emit[names[names >= 0]] = values[names >= 0]
        rest = values[names < 0][np.argsort(-names[names < 0])]
        out.likelihood, out.start, out.moves = float(rest[0, 0]), rest[1], rest[2:]
    return out


def unigrams(known: np.ndarray) -> np.ndarray:
    return (known + 1) / (known.sum() + len(known))


def begun(known: np.ndarray, states: int = STATES, seed: int = 13) -> Model:
    """A model to start from: lasting states, unigram emissions with noise that tells the states apart."""
    emit = unigrams(known)[:, None] * (0.5 + np.random.default_rng(seed).random((len(known), states)))
    return Model(np.full(states, 1 / states), 0.8 * np.eye(states) + 0.2 / states, emit / emit.sum(axis=0))


def improved(seen: Expected, known: np.ndarray) -> Model:
    """The model that the expected numbers speak for; each state keeps SHARE of the unigram distribution, so nothing is impossible."""
    states, base = len(seen.start), unigrams(known)[:, None]
    held = seen.emit.sum(axis=0)
    own = np.where(held > 0, seen.emit / np.where(held > 0, held, 1.0), base)
    moves = seen.moves + 1 / states
    start = seen.start + 1 / states
    return Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), (1 - SHARE) * own + SHARE * base)


def trained(rows: DataFrame, lex: Lexicon, states: int = STATES) -> Model:
    """A model of the training texts of rows (part, ids)."""
    model = begun(lex.known, states)
    for part, passes in (("warm", WARM_PASSES), (None, PASSES)):
        used = rows.where(F.col("part") == part) if part else rows.where("part <> 'none'")
        for _ in range(passes):
            seen = expected(used, model)
            if seen.start.sum() > 0:
                model = improved(seen, lex.known)
    return model


def scored(rows: DataFrame, counts: DataFrame, lex: Lexicon, model: Model) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of encoded texts."""

    def run(batches):
        columns = np.ascontiguousarray(model.emit.T)
        for own, ids, offsets in _batched(batches):
            yield pa.RecordBatch.from_arrays([own.column("key"), pa.array(model.log10(ids, offsets, columns))], names=["key", "hmm"])

    likely = rows.select("key", "ids").mapInArrow(run, "key long, hmm double")
    words = counts.where(F.col("a") * LOOKUP < F.lit(int(counts.agg(F.coalesce(F.sum("a"), F.lit(0))).first()[0]))).select("word", "c")
    endings = F.broadcast(rows.sparkSession.createDataFrame([(i, int(t), int(v)) for i, (t, v) in enumerate(zip(lex.ending_tokens, lex.ending_types, strict=True))], "e int, t long, v long"))
    rare = rows.select("key", F.explode("rare").alias("word"))
    met = rare.join(words.withColumn("e", _ending(F.col("word"))).join(endings, "e").hint("shuffle_hash"), "word")
    ten = lambda top, below: F.log10(top / below)
    sums = met.groupBy("key").agg(
        F.sum((F.col("c") > 0).cast("long")).alias("k0"),
        F.sum(ten(F.col("c") + 1, F.lit(lex.tokens + lex.types + 1))).alias("b0"),
        F.sum(ten(F.col("c") + 1, F.col("t") + F.col("v") + 1)).alias("s0"),
    )
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = rows.drop("ids", "rare").join(likely, "key").join(sums, "key", "left")
    return whole.select("id", "held_out", "n_tokens", (F.col("n_known") + none("k0")).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"), (F.col("base") + none("b0")).alias("base_score"), (F.col("hmm") + F.col("share") + none("s0")).alias("score"))


def score(docs: DataFrame, held: Column | None = None, id_col: str = "doc_id", text_col: str = "text", states: int = STATES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text, by models of those that are not held out.

    Both scores are log10 probabilities of all tokens, the end of the text included. n_known: tokens that training texts
    hold. A null text is the empty one, whose only token is its end. A row with a null id is scored and not learned from;
    rows that repeat an id count and are scored each by its own text. Without training texts all words are equally
    likely. An empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    held = held_out(id_col) if held is None else held
    counts = _stored(vocabulary(docs, ~held, text_col))
    lex = lexicon(counts)
    rows = _stored(encoded(docs, lex, ~held, held, id_col, text_col), "part")
    return scored(rows, counts, lex, trained(rows, lex, states)).withColumnRenamed("id", id_col)


def op13_language_model(docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    return score(docs)
