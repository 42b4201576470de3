"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is cut into the longest phrases that
occur in that text (a byte that starts none is a phrase of its own): the language that needs the fewest phrases,
normalised by the size of its sample, wins. Texts are parsed whole. All segments of a batch and all languages go in
step, as array look-ups; a segment starts in the state that it reaches from WARM bytes before it, and is parsed
again wherever the segment before it turns out to end in another state. So phrases cross segments as if there were none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import ship
from .common import beside, packed
from .wordblocks import pieces, text_buffer

#: Bytes of text per language that the automata hold at most, and rows per language that they come from at most.
#: A row gives an eighth of the bytes at most: its beginning, if it is longer.
SAMPLE_BYTES, SAMPLE_ROWS = 24_000, 48
#: Bytes that the tables of all languages may take: with many languages each one's sample shrinks, to LEAST_BYTES at least.
TABLE_BYTES = 256 << 20
#: Texts of fewer bytes are learned from only where a language has no longer one.
LEAST_BYTES = 300
#: Bytes of a segment, bytes before it that tell its first state, and rounds of parsing again before what is left goes byte by byte.
SEGMENT, WARM, AGAIN = 256, 32, 8
UNKNOWN = "und"
DEAD, ROOT = 0, 1
SPACE, OTHER, PAD = 0, 1, 2


def _is_letter_byte() -> np.ndarray:
    out = np.zeros(256, bool)
    out[97:123] = True
    out[128:] = True
    return out


def normal_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): lower case, every run of what is no letter one space."""
    data, offsets = text_buffer(pc.utf8_lower(pc.fill_null(texts, "")))
    letter = _is_letter_byte()[data]
    keep = letter.copy()
    if len(keep):
        keep[1:] |= letter[:-1]  # the first of a run of other bytes stands for it
        inner = offsets[:-1][offsets[:-1] < len(keep)]
        keep[inner] |= letter[inner]
    out = np.where(letter, data, np.uint8(32))[keep]
    return out, np.concatenate([[0], np.cumsum(keep)])[offsets]


def automaton(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix automaton of text as edges (state, byte, next state); states from 1, the root."""
    step, link, size = [{}, {}], [0, 0], [0, 0]
    last = ROOT
    for c in text:
        cur = len(step)
        step.append({})
        link.append(ROOT)
        size.append(size[last] + 1)
        p = last
        while p and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    edges = [(s, c, t) for s, out in enumerate(step) for c, t in out.items()]
    found = np.array(edges, np.int32).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


class Parser:
    """Phrase counts of texts under every language's automaton. learned: sample text by language."""

    def __init__(self, learned: dict[str, bytes]):
        self.langs = sorted(learned)
        self.weights = np.array([math.log2(max(2, len(learned[x]))) for x in self.langs])
        self.edges = [automaton(learned[x]) for x in self.langs]
        seen = np.unique(np.concatenate([e[1] for e in self.edges])) if self.edges else np.zeros(0, np.int32)
        self.classes = np.full(256, OTHER, np.int32)
        self.classes[seen] = np.arange(3, 3 + len(seen))
        self.classes[32] = SPACE if 32 not in seen else self.classes[32]
        self.width = 3 + len(seen)
        self.table = None

    def _build(self) -> None:
        """Next states by state and class. Where no phrase goes on, a new one starts: the state it starts in, inverted."""
        sizes = [int(e[2].max(initial=ROOT)) + 1 for e in self.edges]
        self.base = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int32)
        self.table = np.zeros((sum(sizes), self.width), np.int32)
        for b, n, (s, c, t) in zip(self.base, sizes, self.edges, strict=True):
            begin = np.full(self.width, b + DEAD, np.int32)
            begin[self.classes[c[s == ROOT]]] = t[s == ROOT] + b
            self.table[b : b + n] = ~begin
            self.table[b + s, self.classes[c]] = t + b
            self.table[b : b + n, PAD] = np.arange(b, b + n)
        self.flat = self.table.reshape(-1)

    def _run(self, state: np.ndarray, at: np.ndarray, end: np.ndarray, steps: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states after, phrases begun) from the states at each place of the last axis, up to its end, `steps` at most."""
        count, width = np.zeros(state.shape, np.int32), np.int32(self.width)
        for t in range(steps):
            c = classes[np.where(at + t < end, at + t, len(classes) - 1)]
            found = np.take(self.flat, state * width + c)
            miss = found >> 31
            count -= miss
            state = found ^ miss
        return state, count

    def _rest(self, state: int, classes: np.ndarray) -> int:
        """Phrases begun in a run of bytes, one byte after the other."""
        flat, width, count = memoryview(self.flat), self.width, 0
        for c in classes.tolist():
            state = flat[state * width + c]
            if state < 0:
                state, count = ~state, count + 1
        return count

    def phrases(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by text and language, normalised bytes of each text)."""
        if self.table is None:
            self._build()
        data, offsets = normal_bytes(texts)
        size = np.diff(offsets)
        many = -(-size // SEGMENT)
        last = np.cumsum(many)
        total = int(many.sum())
        out = np.zeros((len(size), len(self.langs)))
        if not total:
            return out, size
        of = np.repeat(np.arange(len(size)), many)
        begin = offsets[:-1][of]
        start = begin + (np.arange(total) - (last - many)[of]) * SEGMENT
        end = np.minimum(start + SEGMENT, offsets[1:][of])
        classes = np.append(self.classes[data], PAD)
        fresh = np.broadcast_to((self.base + DEAD)[:, None], (len(self.langs), total)).astype(np.int32)
        warm = np.maximum(begin, start - WARM)
        entry = self._run(fresh, warm, start, WARM, classes)[0]
        left, count = self._run(entry, start, end, SEGMENT, classes)
        inner = np.flatnonzero(start > begin)
        for _ in range(AGAIN):
            lang, k = np.nonzero(entry[:, inner] != left[:, inner - 1])
            k = inner[k]
            if not len(k):
                break
            entry[lang, k] = left[lang, k - 1]
            left[lang, k], count[lang, k] = self._run(entry[lang, k], start[k], end[k], SEGMENT, classes)
        lang, k = np.nonzero(entry[:, inner] != left[:, inner - 1])
        for x, text in np.unique(np.stack([lang, of[inner[k]]], axis=1), axis=0).tolist():  # phrases that never fall into step
            first = int(inner[k[(lang == x) & (of[inner[k]] == text)]].min())
            count[x, first : last[text]] = 0
            count[x, first] = self._rest(int(left[x, first - 1]), classes[start[first] : offsets[text + 1]])
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(of, weights=count[k], minlength=len(size))
        return out, size


def _predict_map(parser: Parser | None, text_name: str):
    def run(batches):
        for piece in pieces(batches, text_name, 4 << 20):
            texts = piece.column(text_name)
            n = piece.num_rows
            ascii_letter = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False).to_numpy(zero_copy_only=False)
            letter = np.array([bool(x) or any(map(str.isalpha, t or "")) for x, t in zip(ascii_letter, (None if x else t.as_py() for x, t in zip(ascii_letter, texts, strict=True)), strict=True)], bool)
            lang, score, rate = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n)
            if parser is not None:
                found, size = parser.phrases(texts)
                cost = found * parser.weights
                order = np.argsort(cost, axis=1, kind="stable")
                best = order[:, 0]
                rows = np.arange(n)
                low = cost[rows, best]
                high = cost[rows, order[:, 1]] if cost.shape[1] > 1 else low * np.inf
                lang = np.where(letter, np.array(parser.langs, object)[best], UNKNOWN)
                with np.errstate(invalid="ignore", divide="ignore"):
                    score = np.where(letter, np.where(np.isinf(high), 1.0, high / (high + low)), 0.0)
                    rate = np.where(letter, found[rows, best] / np.maximum(size, 1), 1.0)
            extra = {k: piece.column(k) for k in piece.schema.names if k != text_name}
            yield pa.RecordBatch.from_arrays([*extra.values(), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=[*extra, "lang_pred", "score", "phrase_rate"])

    return run


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_bytes: int = SAMPLE_BYTES, sample_rows: int = SAMPLE_ROWS) -> Parser | None:
    """A parser learned from rows that are not held out and have an id, a language and a text; None if there are none.

    Sampled: about 2 * sample_rows texts per language, by hash of the id at a rate that follows the number of rows. Of
    those, in order of the hash, the first sample_rows distinct ones that fit sample_bytes; of a text of more than an
    eighth of sample_bytes its beginning. What is collected is so much a language, however large the table.
    """
    key = F.xxhash64(F.col(id_col).cast("string"))
    use = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(lang_col).cast("string").alias("l"), key.alias("k"), F.col(text_col).alias("t")).where("octet_length(t) > 0")
    counts = use.groupBy("l").count().collect()  # a row a language
    if not counts:
        return None
    sample_bytes = max(LEAST_BYTES, min(sample_bytes, TABLE_BYTES // (8 * 64 * len(counts))))
    rates = docs.sparkSession.createDataFrame([(r["l"], min(1.0, 2 * sample_rows / r["count"])) for r in counts], "l string, rate double")
    part = F.shiftrightunsigned("k", 11).cast("double") / float(1 << 53)
    rows = use.where(part <= F.lit(max(min(1.0, 2 * sample_rows / r["count"]) for r in counts))).join(F.broadcast(rates), "l").where(part <= F.col("rate"))
    learned: dict[str, list[str]] = {}
    short: dict[str, list[str]] = {}
    for r in sorted(rows.select("l", "k", F.substring("t", 1, max(LEAST_BYTES, sample_bytes // 8)).alias("t")).collect(), key=lambda r: (r["l"], r["k"], r["t"])):
        into = learned if len(r["t"].encode()) >= LEAST_BYTES else short
        if r["t"] not in (own := into.setdefault(r["l"], [])) and len(own) < sample_rows:
            own.append(r["t"])
    raw: dict[str, list[bytes]] = {}
    for name in sorted({*learned, *short}):
        own = [normal_bytes(pa.array([t]))[0].tobytes() for t in learned.get(name) or short[name]]
        if own := [x for x in own if x.strip()]:
            raw[name] = own
    width = 3 + len({c for own in raw.values() for x in own for c in x})
    limit = max(LEAST_BYTES, min(sample_bytes, TABLE_BYTES // (8 * width * max(1, len(raw)))))
    out = {}
    for name, own in raw.items():
        text_of, size = [], 0
        for x in own:
            if size and size + len(x) > limit:
                continue
            text_of.append(x[:limit])
            size += len(x) + 1
        out[name] = b" ".join(text_of)
    return Parser(out) if out else None


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parser: Parser | None = None, sample_bytes: int = SAMPLE_BYTES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every row of docs with held_out, lang_pred, score and phrase_rate (phrases a byte in that language).

    lang_pred is a learned value of lang_col, or `und` if the text is null, has no letter, or nothing could be
    learned; ties go to the smaller name. score is the runner-up's share of both best costs: 0.5 undecided, 1 sure;
    0 with `und`. Learns only from rows with an id, a text and a language that are not held out. Rows that repeat
    an id are judged each by its own text. An empty table gives an empty table. Columns of docs pass through,
    whatever their names (result columns replace input columns of the same name).
    """
    ship(docs.sparkSession)
    parser = parser or learn(docs, id_col, text_col, lang_col, sample_bytes, sample_rows)
    made = ("held_out", "lang_pred", "score", "phrase_rate")
    old = beside(docs.columns, *made)
    rows, back = packed(docs, old, held_out(id_col).alias("held_out"), F.col(text_col).alias("__text"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text"]
    return back(rows.mapInArrow(_predict_map(parser, "__text"), ", ".join([*kinds, "lang_pred string", "score double", "phrase_rate double"])), *made)


def op2_language_id(docs: DataFrame) -> DataFrame:
    """The columns of the query: doc_id, held_out, lang_pred, score."""
    parser = learn(docs)
    out = identify(docs.select("doc_id", "text"), parser=parser) if parser else identify(docs.select("doc_id", "text", "lang"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "lang_pred", "score")
