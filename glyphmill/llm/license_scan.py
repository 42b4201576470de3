"""License scans with a positional rare-token index.

Templates are word sequences: phrases, notices and whole texts of licences. How many documents hold each template
word is counted over all documents first. All templates' words are posted with their offsets. Of a file, the template
words of highest IDF that it holds itself are looked up; each place and posting votes for (template, place - offset), so
postings are intersected by relative position. An alignment with enough votes is a candidate, whose mandatory key phrases
are compared word by word. A template is looked up in a file only if the file holds all words of its key phrases. Base
phrases are templates that are all key: their rarest word alone makes a candidate, so every place is found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship
from .common import beside, packed
from .decontaminate import Lookup
from .license_texts import PHRASES, TEXTS
from .wordblocks import Words, pieces

#: A file's words of highest IDF that a template is looked up by, and the share of them that must vote for one alignment.
RARE, VOTES = 6, 0.5


def _split(text: str) -> tuple[bytes, ...]:
    words = Words(pa.array([text]), "alnum_fold")
    return tuple(words.words(0, len(words)))


@dataclass(frozen=True)
class Template:
    """label; its words; the key phrases and where they must stand within them; whether it is a base phrase."""

    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[int, tuple[bytes, ...]], ...]
    base: bool = False

    @classmethod
    def of(cls, label: str, text: str, keys: tuple[str, ...] = (), base: bool = False) -> Template:
        own = _split(text)
        parts = [_split(k) for k in keys] or [own]
        return cls(label, own, tuple((next(i for i in range(len(own)) if own[i : i + len(k)] == k), k) for k in parts), base)


BASE = tuple(Template.of(label, text, base=True) for label, text in PHRASES)
NOTICES = tuple(Template.of(*x) for x in TEXTS)


def _hashes(words: tuple[bytes, ...]) -> np.ndarray:
    return Words(pa.array([b" ".join(words).decode()]), "alnum_fold").hashes()


def _count_map(vocabulary: np.ndarray):
    def run(batches):
        look, total = Lookup(vocabulary), np.zeros(len(vocabulary), np.int64)
        for piece in pieces(batches, "text"):
            words = Words(piece.column("text"), "alnum_fold")
            at, k = look(words.hashes())
            pairs = np.unique(words.text_of()[at].astype(np.int64) * len(vocabulary) + k)
            total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        k = np.flatnonzero(total)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "docs"])

    return run


class Index:
    """Templates by the numbers of their words in a sorted vocabulary of hashes. docs: how many documents hold each."""

    def __init__(self, templates: tuple[Template, ...], vocabulary: np.ndarray, docs: np.ndarray):
        self.templates, self.vocabulary = templates, vocabulary
        self.rank = np.empty(len(vocabulary), np.int64)  # by rarity; ties go to the smaller hash
        self.rank[np.lexsort((vocabulary, docs))] = np.arange(len(vocabulary))
        self.words = [np.searchsorted(vocabulary, _hashes(t.words)) for t in templates]
        self.keys = [np.unique(np.concatenate([w[i : i + len(k)] for i, k in t.keys])) for t, w in zip(templates, self.words, strict=True)]
        of_key = np.array([(k, t) for t, own in enumerate(self.keys) for k in own.tolist()])
        of_key = of_key[np.argsort(of_key[:, 0], kind="stable")]
        self.first, self.of_key = np.searchsorted(of_key[:, 0], np.arange(len(vocabulary) + 1)), of_key[:, 1]

    def candidates(self, text: np.ndarray, k: np.ndarray) -> np.ndarray:
        """(text, template) wherever a text holds all key words; from the texts' distinct words k."""
        many = self.first[k + 1] - self.first[k]
        t = self.of_key[np.repeat(self.first[k], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
        pair, count = np.unique(np.repeat(text, many).astype(np.int64) * len(self.templates) + t, return_counts=True)
        text, t = np.divmod(pair, len(self.templates))
        whole = count == np.array([len(x) for x in self.keys])[t]
        return np.stack([text[whole], t[whole]], axis=1)

    def starts(self, t: int, k: np.ndarray) -> np.ndarray:
        """Starts (relative to the words k of a text, -1 for words outside the vocabulary) at which template t has enough votes."""
        own = self.words[t]
        held = np.intersect1d(own, k)
        chosen = held[np.argsort(self.rank[held])[: 1 if self.templates[t].base else RARE]]
        votes = np.concatenate([(np.flatnonzero(k == c)[:, None] - np.flatnonzero(own == c)).reshape(-1) for c in chosen])
        start, count = np.unique(votes, return_counts=True)
        return start[count >= max(1, int(np.ceil(VOTES * len(chosen))))]


def _scan(words: Words, index: Index, look: Lookup):
    """(text, start word, template, share of the template's words in place) of every verified alignment."""
    at, k = look(words.hashes())
    of = words.text_of()[at].astype(np.int64)
    text, word = np.divmod(np.unique(of * len(index.vocabulary) + k), len(index.vocabulary))
    for text, t in index.candidates(text, word).tolist():
        lo, hi = int(words.first[text]), int(words.first[text + 1])
        a, b = np.searchsorted(at, [lo, hi])
        own = np.full(hi - lo, -1, np.int64)
        own[at[a:b] - lo] = k[a:b]
        template = index.templates[t]
        for start in index.starts(t, own).tolist():
            spots = [(start + i, key) for i, key in template.keys]
            if all(s >= 0 and s + len(key) <= hi - lo and tuple(words.words(lo + s, lo + s + len(key))) == key for s, key in spots):
                inside = range(max(0, -start), min(len(template.words), hi - lo - start))
                yield text, start, t, sum(words.word(lo + start + j) == template.words[j] for j in inside) / len(template.words)


def _scan_map(index: Index, name: str):
    def run(batches):
        look = Lookup(index.vocabulary)
        for piece in pieces(batches, name):
            words = Words(piece.column(name), "alnum_fold")
            found: list[list] = [[] for _ in range(piece.num_rows)]
            for text, start, t, share in _scan(words, index, look):
                own = index.templates[t]
                found[text].append({"label": own.label, "start": start, "words": len(own.words), "base": own.base, "share": share})
            rest = {c: piece.column(c) for c in piece.schema.names if c != name}
            kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("base", pa.bool_()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*rest.values(), pa.array(words.counts, pa.int64()), pa.array([sorted(x, key=lambda m: (m["start"], m["label"], m["words"])) for x in found], kind)], names=[*rest, "n_words", "matches"])

    return run


def license_scan(docs: DataFrame, text_col: str = "text", base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES, keep: list[str] | None = None) -> DataFrame:
    """Every row of docs without its text, with n_words and matches: array of (label, start word, words, base, share in place).

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. Base phrases are found wherever they stand;
    notices where enough of the file's rarest words agree on a place and the key phrases stand there (their start
    may lie before the file's first word, if only the rest is there). Null text has no words; empty tables give empty
    tables; repeated rows are scanned each by itself. Columns of docs pass through, whatever their names (result
    columns replace input columns of the same name). Ties in rarity go to the smaller hash.
    """
    ship(docs.sparkSession)
    templates = (*base, *notices)
    vocabulary = np.unique(np.concatenate([_hashes(t.words) for t in templates]))
    counts = np.zeros(len(vocabulary), np.int64)
    for r in docs.select(F.col(text_col).alias("text")).mapInArrow(_count_map(vocabulary), "k long, docs long").groupBy("k").agg(F.sum("docs").alias("docs")).collect():  # a row per template word
        counts[r["k"]] = r["docs"]
    old = beside(keep if keep is not None else docs.columns, text_col, "n_words", "matches")
    rows, back = packed(docs, old, F.col(text_col).alias("__text"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text"]
    found = rows.mapInArrow(_scan_map(Index(templates, vocabulary, counts), "__text"), ", ".join([*kinds, "n_words long", "matches array<struct<label:string,start:bigint,words:bigint,base:boolean,share:double>>"]))
    return back(found, "n_words", "matches")


def op6_license_scan(docs: DataFrame) -> DataFrame:
    """The digest columns of the query; score is the best share of a template in place, 0 without a match."""
    out = license_scan(docs.select("doc_id", "text"))
    at = F.expr("transform(filter(matches, m -> m.base), m -> m.start)")
    labels = lambda cond: F.array_join(F.array_sort(F.array_distinct(F.expr(f"transform(filter(matches, m -> {cond}), m -> m.label)"))), ",")
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        labels("m.base").alias("base_labels"), labels("true").alias("labels"), F.coalesce(F.array_max(F.expr("transform(matches, m -> m.share)")), F.lit(0.0)).alias("score"),
    )
