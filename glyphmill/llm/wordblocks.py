"""Words of whole Arrow text columns as numpy arrays: bounds, 64-bit hashes, n-grams.

Every delimiter used here is ASCII, so UTF-8 can be cut byte by byte. Work on bytes goes in blocks of
BLOCK bytes, so temporary arrays stay bounded however long a text is; what is kept is per word.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 21
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd multipliers of the polynomial hashes; one per lane.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def byte_classes(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(is word byte, byte after folding) by byte value. kind 'space': words end at white space, bytes unchanged;
    'space_fold': the same with A-Z lower-cased; 'alnum_fold': ASCII words are digits and letters, A-Z lower-cased."""
    fold = np.arange(256, dtype=np.uint8)
    if kind.endswith("_fold"):
        fold[65:91] += 32
    word = np.ones(256, dtype=bool)
    if kind.startswith("space"):
        word[[0x20, *range(0x09, 0x0E)]] = False
    else:
        word[:0x80] = False
        word[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
    return word, fold


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of a text column. starts, ends: byte bounds in data; first: index of each text's first word, and the count."""

    def __init__(self, texts: pa.Array, kind: str):
        self.kind = kind
        self.data, self.offsets = text_buffer(texts)
        is_word = byte_classes(kind)[0][self.data]
        if len(is_word):
            begins, ends = is_word.copy(), is_word.copy()
            begins[1:] &= ~is_word[:-1]
            ends[:-1] &= ~is_word[1:]
            inner = self.offsets[1:-1]
            inner = inner[(inner > 0) & (inner < len(is_word))]  # words also end where texts do
            begins[inner] = is_word[inner]
            ends[inner - 1] = is_word[inner - 1]
            self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        """Index of each word's text."""
        return np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each folded word, the same in every process."""
        fold = byte_classes(self.kind)[1]
        base = np.uint64(BASES[lane])
        codes = mix(fold.astype(np.uint64) + np.uint64(1) + base)
        out = np.empty(len(self), np.uint64)
        k = 0
        while k < len(self):
            end = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + BLOCK)))
            s, e = self.starts[k:end], self.ends[k:end]
            sizes = e - s
            within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            powers = np.cumprod(np.full(int(sizes.max()) + 1, base, np.uint64))
            value = codes[self.data[np.repeat(s, sizes) + within]] * powers[within]
            out[k:end] = mix(np.add.reduceat(value, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64) * base)
            k = end
        return out

    def word(self, i: int) -> bytes:
        return byte_classes(self.kind)[1][self.data[self.starts[i] : self.ends[i]]].tobytes()

    def words(self, lo: int, hi: int) -> list[bytes]:
        return [self.word(i) for i in range(lo, hi)]


def gram_hashes(words: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hash of the n words from each position on, over the whole column (callers mask those that cross texts)."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    factor, out = np.uint64(BASES[1 - lane]), np.zeros(size, np.uint64)
    for j in range(n):
        out = out * factor + words[j : j + size]
    return mix(out + np.uint64(n))


def within_text(words: Words, n: int) -> np.ndarray:
    """Whether the n words from each position on belong to one text; as long as gram_hashes."""
    of = words.text_of()
    return of[: max(0, len(of) - n + 1)] == of[n - 1 :] if len(of) >= n else np.zeros(0, bool)


#: What one operator keeps in a worker process from task to task, by its key.
KEPT: dict[object, object] = {}


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20, kept: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows of batches in pieces of about limit bytes of text (a longer text is a piece of its own).

    Workers outlive stages: unless the caller's own is kept, what an operator before left in this one is let go first.
    """
    if KEPT and not kept:
        KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + limit, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of unsigned numbers, plane by plane: high planes are mostly zero and compress away."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes, width: int) -> np.ndarray:
    n = len(raw) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1)
