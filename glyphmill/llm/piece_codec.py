"""SentencePiece encoding and decoding by a streaming Viterbi pass.

For a BPE vocabulary the best path is the one whose every adjacent pair of pieces is what the merge order
itself makes of their joined text (an encoding's prefixes are encodings of their texts). Each position thus has
one surviving backpointer: the piece that ends there and agrees with the piece before it. Only positions within
the longest piece of the end can still be continued; once the paths from all of them meet in one boundary,
the ids up to it are final, are given out, and their part of the window is dropped.

A text is cut into units that no piece crosses (words, mostly). The distinct units of a batch go side by side, one
position after the other, as arrays; only units of more than LONG characters are streamed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import ship
from .common import beside, packed
from .wordblocks import KEPT, pieces, text_buffer

SPACE = "▁"
NORMAL, UNKNOWN, BYTE, BPE = 1, 2, 6, 2
#: Positions after which the window tries to commit, characters of a unit that goes side by side with others, characters that do so at once.
STRIDE, LONG, AT_ONCE = 64, 256, 1 << 18
#: Pairs of pieces and units that a worker keeps at most; units take about 40 bytes each.
PAIRS, CACHE = 400_000, 1 << 19


class Numbers:
    """Small whole numbers by keys of 0 or more, as arrays."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.size = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32), 0

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for keys that are not held."""
        at = self._first(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        todo = np.flatnonzero((held != keys) & (held >= 0))
        at = at[todo]
        while len(todo):
            at = at + 1 & self.mask
            held, wanted = self.keys[at], keys[todo]
            found = held == wanted
            out[todo[found]] = self.values[at[found]]
            on = ~found & (held >= 0)
            todo, at = todo[on], at[on]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Hold distinct keys that are not held yet."""
        self.size += len(keys)
        at = self._first(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], at[~mine] + 1 & self.mask


class Codec:
    """Encoder and decoder of a sentencepiece BPE model (its bytes) with an identity normaliser."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type != BPE or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only BPE models without normalisation rules are supported")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.number = {p: i for p, (i, _) in self.pieces.items()}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.longest = max(map(len, self.pieces))
        self.out = [b""] * len(proto.pieces)
        for i, p in enumerate(proto.pieces):
            self.out[i] = bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else " ⁇ ".encode() if p.type == UNKNOWN else b""
        inner = {c for p in self.pieces if len(p) > 1 for c in p}
        self.joined = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.alone = [ord(c) for c in "\n\t\r" if c not in inner]  # no piece crosses these: each is a unit
        self._symbols(inner)
        ends: dict[str, set[int]] = {}  # by last two or three characters: lengths of the pieces that end in them
        for p in self.pieces:
            for tail in {p[-2:], p[-3:]} - {p[-1:]}:
                ends.setdefault(tail, {1}).add(len(p))
        for tail in ends:
            if len(tail) == 3:
                ends[tail] |= {n for n in ends.get(tail[1:], ()) if n < 3}
        self.ends = {tail: tuple(sorted(n, reverse=True)) for tail, n in ends.items()}
        self.agree: dict[str, dict[str, bool]] = {p: {} for p in self.pieces}  # by piece: whether it may follow another
        self.single: dict[str, dict[str, bool]] = {}  # the same for characters that are no piece
        self.agreed = 0
        self.cache: tuple[pa.Array, np.ndarray, np.ndarray] | tuple[()] = ()  # units, their ids one after the other, where each one's begin and end
        self.spoken = pa.array(self.out, pa.binary())

    def _symbols(self, inner: set[str]) -> None:
        """Symbols are pieces and characters inside pieces, by number; `none` is a character of no piece, or what is before a unit.

        Numbers of transitions follow from a prefix and the next character's class: each prefix of a symbol is a state.
        """
        self.names = [*self.pieces, *sorted(inner - self.pieces.keys()), ""]
        self.none = len(self.names) - 1
        self.ids = np.array([self.number.get(p, -1) for p in self.names], np.int32)
        self.byte_ids = np.array([self.bytes.get(b, self.unknown) for b in range(256)], np.int32)
        classes = {c: i for i, c in enumerate(sorted({c for p in self.names for c in p}), 1)}
        self.classes = np.zeros(max(map(ord, classes)) + 2, np.int64)
        for c, i in classes.items():
            self.classes[ord(c)] = i
        self.width = len(classes) + 1
        states: dict[int, int] = {}
        symbol = [-1]
        for k, p in enumerate(self.names[:-1]):
            state = 0
            for c in p:
                key = state * self.width + classes[c]
                state = states.setdefault(key, len(symbol))
                if state == len(symbol):
                    symbol.append(-1)
            symbol[state] = k
        self.symbol = np.array(symbol, np.int32)
        self.states = Numbers(len(states).bit_length() + 2)
        self.states.put(np.fromiter(states, np.int64, len(states)), np.fromiter(states.values(), np.int32, len(states)))
        self.pairs = Numbers((2 * PAIRS).bit_length())

    def _merged(self, text: str) -> list[str]:
        """What the merge order makes of a short text: the best-scored neighbours join first, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.pieces.get(parts[i] + parts[i + 1])
                if found and (best is None or found[1] > best):
                    best, at = found[1], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, known: dict[str, bool], before: str, piece: str) -> bool:
        if self.agreed >= PAIRS:
            for found in self.agree.values():
                found.clear()
            self.single.clear()
            self.agreed = 0
        self.agreed += 1
        found = known[before] = self._merged(before + piece) == ([before, piece] if before else [piece])
        return found

    def _stream(self, text: str) -> Iterator[str]:
        """Pieces of a text in order, committed as soon as they are final."""
        agree, single, ends, fits, size = self.agree, self.single, self.ends, self._fits, len(text)
        done = 0  # everything before is given out
        back: list[int] = [0]  # start of the piece that ends at done + index; absolute
        last: list[str] = [""]  # that piece
        for end in range(1, size + 1):
            for length in (ends.get(text[end - 3 : end]) if end > 2 else None) or (ends.get(text[end - 2 : end]) if end > 1 else None) or (1,):
                start = end - length
                if start < done:
                    continue
                piece = text[start:end]
                known = agree.get(piece)
                if known is None:
                    if length > 1:
                        continue
                    known = single.setdefault(piece, {})
                before = last[start - done]
                ok = known.get(before)
                if ok or ok is None and fits(known, before, piece):
                    back.append(start)
                    last.append(piece)
                    break
            else:
                raise AssertionError("a position has no encoding")
            if end - done >= STRIDE and end < size:
                live = set(range(max(done, end - self.longest + 1), end + 1))
                while len(live) > 1:
                    top = max(live)
                    live.remove(top)
                    live.add(back[top - done] if top > done else done)
                meet = live.pop()
                if meet > done:
                    yield from self._path(back, last, done, meet)
                    back, last = back[meet - done :], last[meet - done :]
                    done = meet
        yield from self._path(back, last, done, size)

    @staticmethod
    def _path(back: list[int], last: list[str], done: int, end: int) -> list[str]:
        out = []
        while end > done:
            out.append(last[end - done])
            end = back[end - done]
        return out[::-1]

    def _agree(self, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Whether the merge order makes just these two of their joined text; none before: of the symbol's text only it."""
        keys = before.astype(np.int64) * len(self.names) + symbol
        found = self.pairs.get(keys)
        lost = np.flatnonzero(found < 0)
        if len(lost):
            new, which = np.unique(keys[lost], return_inverse=True)
            two = [(self.names[k // len(self.names)], self.names[k % len(self.names)]) for k in new.tolist()]
            fits = np.array([self._merged(a + b) == ([a, b] if a else [b]) for a, b in two], np.int32)
            if self.pairs.size + len(new) > PAIRS:
                self.pairs.clear()
            for lo in range(0, min(len(new), PAIRS), PAIRS):
                self.pairs.put(new[lo : lo + PAIRS], fits[lo : lo + PAIRS])
            found[lost] = fits[which]
        return found == 1

    def _matches(self, classes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, lengths, symbols) of all symbols inside units, the longest first; ends: of the unit of each character."""
        start = np.flatnonzero(classes)
        state, found = np.zeros(len(start), np.int64), []
        for length in range(1, self.longest + 1):
            state = self.states.get(state * self.width + classes[start + length - 1])
            on = state >= 0
            start, state = start[on], state[on]
            symbol = self.symbol[state]
            is_one = symbol >= 0
            found.append((start[is_one], np.full(int(is_one.sum()), length), symbol[is_one]))
            on = start + length < ends[start]
            start, state = start[on], state[on].astype(np.int64)
            if not len(start):
                break
        return tuple(map(np.concatenate, zip(*found[::-1], strict=True)))

    def _side_by_side(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each unit) of units that are not empty: characters codes[first[i]:first[i + 1]]."""
        size, n = np.diff(first), len(codes)
        begin, classes = np.repeat(first[:-1], size), self.classes[np.minimum(codes, len(self.classes) - 1)]
        start, length, symbol = self._matches(classes, np.repeat(first[1:], size))
        end = start + length - 1  # a position is known by the last character before it
        step = (end - begin[end]) * (self.longest + 1) + self.longest - length
        order = np.argsort(step.astype(np.min_scalar_type(int(step.max(initial=0)))), kind="stable")
        step, start, end, symbol = step[order], start[order], end[order], symbol[order]
        before = np.where(start == begin[start], n, start - 1)
        last = np.where(np.append(classes, 0) == 0, np.int32(self.none), np.int32(-1))  # the piece that ends there
        back = np.arange(n)  # where it starts
        turns = np.flatnonzero(np.diff(step, prepend=-1))
        for lo, hi in zip(turns.tolist(), [*turns[1:].tolist(), len(step)], strict=False):  # by position, the longest pieces first
            k = lo + np.flatnonzero(last[end[lo:hi]] < 0)
            if len(k):
                k = k[self._agree(last[before[k]], symbol[k])]
                last[end[k]] = symbol[k]
                back[end[k]] = start[k]
        if (last < 0).any():
            raise AssertionError("a position has no encoding")
        on_path, at = np.zeros(n, bool), first[1:] - 1
        while len(at):
            on_path[at] = True
            at = (back[at] - 1)[back[at] > begin[at]]
        where = np.flatnonzero(on_path)
        ids, of = self.ids[last[where]], np.repeat(np.arange(len(size)), size)[where]
        lost = ids < 0
        if lost.any() and self.bytes:  # characters that are no piece go as their bytes
            text = codes[where[lost]].astype("<u4").tobytes().decode("utf-32-le")
            wide = np.ones(len(ids), np.int64)
            wide[lost] = [len(c.encode()) for c in text]
            ids, of, lost = np.repeat(ids, wide), np.repeat(of, wide), np.repeat(lost, wide)
            ids[lost] = self.byte_ids[np.frombuffer(text.encode(), np.uint8)]
        elif lost.any():  # a run of them in a unit is unknown once
            ids[lost] = self.unknown
            keep = ~lost
            keep[1:] |= ~lost[:-1] | (of[1:] != of[:-1])
            keep[0] = True
            ids, of = ids[keep], of[keep]
        return ids, np.bincount(of, minlength=len(size))

    def _streamed(self, unit: str) -> np.ndarray:
        ids: list[int] = []
        for p in self._stream(unit):
            found = self.number.get(p)
            if found is not None:
                ids.append(found)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in p.encode())
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return np.array(ids, np.int32)

    def _coded(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of distinct units, none of them empty."""
        size = pc.utf8_length(units).to_numpy(zero_copy_only=False)
        counts, parts, places = np.zeros(len(units), np.int64), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        short = np.flatnonzero(size <= LONG)
        block = np.cumsum(size[short]) // AT_ONCE
        for own in np.split(short, np.flatnonzero(np.diff(block)) + 1):
            if len(own):
                text = text_buffer(units.take(pa.array(own)))[0].tobytes().decode().replace(" ", SPACE)
                ids, counts[own] = self._side_by_side(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(size[own])]))
                parts.append(ids)
                places.append(np.repeat(own, counts[own]))
        for k in np.flatnonzero(size > LONG).tolist():
            parts.append(self._streamed(units[k].as_py().replace(" ", SPACE)))
            counts[k] = len(parts[-1])
            places.append(np.full(counts[k], k))
        return np.concatenate(parts)[np.argsort(np.concatenate(places), kind="stable")], counts

    def _begun(self, texts: pa.Array) -> pa.Array:
        """Texts that are not empty after the blank that the model puts before them; nulls are empty."""
        texts = pc.fill_null(texts, "")
        return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(" ", texts, "")) if self.prefix else texts

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): of text i ids[offsets[i]:offsets[i + 1]]. Units that earlier calls have met are looked up."""
        data, offsets = text_buffer(pc.replace_substring(self._begun(texts), SPACE, " "))
        starts = np.zeros(len(data), bool)
        if not self.joined:
            space = data == 32
            starts |= space
            starts[1:] &= ~space[:-1]
            for c in self.alone:
                is_one = data == c
                starts |= is_one
                starts[1:] |= is_one[:-1]
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        bounds = np.append(np.flatnonzero(starts), len(data))
        found = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        units, which = found.dictionary, found.indices.to_numpy()
        known, ids, ends = self.cache or (units[:0], np.zeros(0, np.int32), np.zeros(1, np.int64))
        place = pc.fill_null(pc.index_in(units, value_set=known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        place[new] = len(known) + np.arange(len(new))
        more, counts = self._coded(units.take(pa.array(new)))
        ids, ends = np.concatenate([ids, more]), np.concatenate([ends, ends[-1] + np.cumsum(counts)])
        if len(known) + len(new) <= CACHE:
            self.cache = (pa.concat_arrays([known, units.take(pa.array(new))]), ids, ends)
        else:  # what this call met, from its beginning
            own = place[:CACHE]
            self.cache = (pa.concat_arrays([units[:CACHE]]), *_gathered(ids, ends, own))
        out, at = _gathered(ids, ends, place[which])
        return out, at[np.searchsorted(bounds, offsets)]

    def round_trips(self, texts: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether the ids of each text decode to it."""
        said = self.spoken.take(pa.array(ids))
        data, ends = said.buffers()[2], np.frombuffer(said.buffers()[1], np.int32)[: len(ids) + 1]
        whole = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(ends[offsets])), data])
        same = pc.equal(whole, self._begun(texts).cast(pa.binary())).to_numpy(zero_copy_only=False).copy()
        for k in np.flatnonzero(~same).tolist():
            same[k] = self.decode(ids[offsets[k] : offsets[k + 1]]) == (texts[k].as_py() or "").encode()
        return same

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def decode(self, ids: np.ndarray) -> bytes:
        out = self.out
        raw = b"".join([out[i] for i in ids.tolist() if 0 <= i < len(out)])
        return raw[1:] if self.prefix and raw.startswith(b" ") else raw


def _gathered(ids: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends) of the runs ids[ends[i]:ends[i + 1]] that `which` lists."""
    sizes = (ends[1:] - ends[:-1])[which]
    at = np.concatenate([[0], np.cumsum(sizes)])
    return ids[np.arange(at[-1]) + np.repeat(ends[which] - at[:-1], sizes)], at


def _codec(model: bytes) -> Codec:
    """One codec per worker process and model: its caches serve all tasks of the worker, until another operator's task comes."""
    key = ("codec", hash(model))
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = Codec(model)
    return KEPT[key]


def _encode_map(model: bytes, name: str):
    def run(batches):
        codec = _codec(model)
        for piece in pieces(batches, name, 2 << 20, kept=True):
            texts = piece.column(name)
            ids, sizes = codec.encode_all(texts)
            flat, same = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(ids)), codec.round_trips(texts, ids, sizes)
            rest = {k: piece.column(k) for k in piece.schema.names if k != name}
            yield pa.RecordBatch.from_arrays([*rest.values(), pa.array(np.diff(sizes), pa.int64()), flat, pa.array(same, pa.bool_())], names=[*rest, "n_ids", "ids", "round_trip"])

    return run


def _decode_map(model: bytes, name: str):
    def run(batches):
        codec = _codec(model)
        for b in batches:
            text = [None if x is None else codec.decode(np.array([i for i in x if i is not None], np.int32)).decode("utf-8", "replace") for x in b.column(name).to_pylist()]
            rest = {k: b.column(k) for k in b.schema.names if k != name}
            yield pa.RecordBatch.from_arrays([*rest.values(), pa.array(text, pa.string())], names=[*rest, "decoded"])

    return run


def _mapped(rows: DataFrame, inner: str, run, made: str) -> DataFrame:
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != inner]
    return rows.mapInArrow(run, ", ".join([*kinds, made]))


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row of docs without its text, with n_ids, ids (array of int) and round_trip (whether the ids decode to the text).

    model_path: a sentencepiece BPE model on the driver; its bytes go to the executors. keep: the columns that
    stay (all but the text by default; result columns replace input columns of the same name). Null or empty text:
    no ids, which decode to the empty text. U+2581 is the model's own mark of a space and decodes to a space,
    so a text that holds it has round_trip false.
    Nulls, repeated rows and empty tables need no special case: each row is coded by itself.
    """
    ship(docs.sparkSession)
    old = beside(keep if keep is not None else docs.columns, text_col, "n_ids", "ids", "round_trip")
    rows, back = packed(docs, old, F.col(text_col).alias("__text"))
    coded = _mapped(rows, "__text", _encode_map(Path(model_path).read_bytes(), "__text"), "n_ids long, ids array<int>, round_trip boolean")
    return back(coded, "n_ids", "ids", "round_trip")


def decode(coded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """Every row of coded with `decoded`, the text of its ids; null for null ids. Null elements and ids that the model lacks are skipped."""
    ship(coded.sparkSession)
    rows, back = packed(coded, beside(coded.columns, "decoded"), F.col(ids_col).alias("__ids"))
    return back(_mapped(rows, "__ids", _decode_map(Path(model_path).read_bytes(), "__ids"), "decoded string"), "decoded")


def op7_piece_codec(docs: DataFrame, model_path: str) -> DataFrame:
    """The columns of the query: doc_id, n_ids, ids, round_trip."""
    return encode(docs.select("doc_id", "text"), model_path)
