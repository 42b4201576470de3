"""op13: counts and unigram scores in plain Python, likelihoods and expected counts by sums over all paths, and edge cases."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from glyphmill.llm import hmm
from glyphmill.llm.common import table

SCHEMA = "doc_id long, text string"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))] + [hmm.END]


def out_of(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def learned(rows):
    return Counter(w for i, t in rows if i is not None and not out_of(i) for w in words(t))


def base(rows):
    c = learned(rows)
    n = sum(c.values())
    for i, t in rows:
        w = words(t)
        yield i, out_of(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + len(c) + 1)) for x in w)


def likelihood(model, ids):
    """log10 probability by the plain recursion, in logarithms."""
    with np.errstate(divide="ignore"):
        state, moves, emit = np.log(model.start), np.log(model.moves), np.log(model.emit)
    for t, s in enumerate(ids):
        state = (np.logaddexp.reduce(state[:, None] + moves, axis=0) if t else state) + emit[s]
    return np.logaddexp.reduce(state) / math.log(10)


def random_model(rng, states=3, symbols=5):
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


@pytest.mark.parametrize("chunk", [2, 3, 100])
def test_expected_numbers_are_those_of_all_paths(monkeypatch, chunk):
    monkeypatch.setattr(hmm, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    model = random_model(rng)
    texts = [rng.integers(0, 5, n) for n in (1, 2, 7, 3, 6, 4)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    sweep = hmm.Sweep(model, np.concatenate(texts), offsets)
    got = hmm.Expected.none(3, 5)
    sweep.count(got)
    want = hmm.Expected.none(3, 5)
    for k, ids in enumerate(texts):
        paths = list(itertools.product(range(3), repeat=len(ids)))
        odds = [model.start[p[0]] * np.prod([model.moves[a, b] for a, b in itertools.pairwise(p)]) * np.prod([model.emit[s, x] for s, x in zip(ids, p, strict=True)]) for p in paths]
        assert math.isclose(sweep.likelihoods()[k], math.log(sum(odds)), rel_tol=1e-12)
        for p, o in zip(paths, np.array(odds) / sum(odds), strict=True):
            want.start[p[0]] += o
            for a, b in itertools.pairwise(p):
                want.moves[a, b] += o
            for s, x in zip(ids, p, strict=True):
                want.emit[s, x] += o
    assert math.isclose(got.likelihood, sweep.likelihoods().sum(), rel_tol=1e-12)
    for name in ("start", "moves", "emit"):
        assert np.allclose(getattr(got, name), getattr(want, name), atol=1e-12), name


@pytest.mark.parametrize("chunk", [7, 50, 4096])
def test_long_texts_neither_underflow_nor_depend_on_chunks(monkeypatch, chunk):
    monkeypatch.setattr(hmm, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    model = random_model(rng, 4, 50)
    texts = [rng.integers(0, 50, n) for n in (3000, 1, 50, 51, 700)]
    got = model.log10(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert np.allclose(got, [likelihood(model, t) for t in texts], rtol=1e-12)


def test_probabilities_of_all_short_texts_sum_to_what_ends_in_time():
    model = random_model(np.random.default_rng(3), 2, 3)
    end, total, alive = 2, 0.0, model.start.copy()
    for n in range(6):
        for ids in itertools.product(range(2), repeat=n):
            total += 10 ** model.log10(np.array([*ids, end]), np.array([0, n + 1]))[0]
    for _ in range(6):
        alive = (alive * (1 - model.emit[end])) @ model.moves
    assert math.isclose(total, 1 - alive.sum(), rel_tol=1e-9)


def test_passes_never_lower_the_likelihood(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    counts = hmm._stored(hmm.vocabulary(docs, ~hmm.held_out()))
    lex = hmm.lexicon(counts)
    rows = hmm._stored(hmm.encoded(docs, lex, ~hmm.held_out(), hmm.held_out()), "part").where("part <> 'none'")
    model, seen = hmm.begun(lex.known), []
    for _ in range(4):
        got = hmm.expected(rows, model)
        seen.append(got.likelihood)
        model = hmm.improved(got, lex.known)
    assert seen == sorted(seen) and seen[-1] > seen[0] * 0.999


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, d, "documents").collect()]
    got = {r.doc_id: r for r in entry.queries()["op13_language_model"](spark, d).collect()}
    gain = 0.0
    for i, held, n, known, size, score in base(docs):
        r = got.pop(i)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, size) and math.isclose(r.base_score, score, rel_tol=1e-9)
        assert r.score < 0
        gain += r.score - r.base_score if held else 0.0
    assert not got and gain > 0


@pytest.mark.parametrize("own, lookup", [(1 << 17, 1 << 20), (4, 8), (1, 1)])
def test_words_outside_the_lexicon_meet_their_counts(spark, monkeypatch, own, lookup):
    """Few words looked up, or none but the most frequent: the same counts and unigram scores, and probabilities of the same model."""
    monkeypatch.setattr(hmm, "OWN", own)
    monkeypatch.setattr(hmm, "LOOKUP", lookup)
    monkeypatch.setattr(hmm, "HELD_WORDS", 3)
    monkeypatch.setattr(hmm, "PIECE", 10)
    rows = [(i, f"The cat{i % 5} SAT on\tthe mat{i}\n" * (1 + i % 3)) for i in range(40)] + [(None, "the new words"), (7, None), (7, ""), (8, "x" * 300), (9, " \x0b\x0c é É ñandú\xa0x ")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    train, held = ~hmm.held_out(), hmm.held_out()
    counts = hmm._stored(hmm.vocabulary(docs, train))
    c, a = learned(rows), Counter(w for _, t in rows for w in words(t))
    assert {bytes(r.word): (r.c, r.a) for r in counts.collect()} == {w: (c[w], a[w]) for w in a}
    lex = hmm.lexicon(counts)
    assert all(a[w] * lookup >= sum(a.values()) for w in lex.words if w != hmm.END)
    coded = hmm._stored(hmm.encoded(docs, lex, train, held), "part")
    model = hmm.trained(coded, lex)
    got = hmm.scored(coded, counts, lex, model).collect()
    rounded = lambda r: (*r[:5], round(r[5], 9))
    assert sorted(map(repr, (rounded(tuple(r)) for r in got))) == sorted(map(repr, (rounded(r) for r in base(rows))))
    # each text again, word by word: its symbol, and its share of the symbol
    mine = {w for w in a if w == hmm.END or a[w] * own >= sum(a.values()) and c[w] >= 2}
    total = {e: (sum(c[w] for w in c if w not in mine and hmm.ending(w) == e), sum(1 for w in c if w not in mine and hmm.ending(w) == e)) for e in map(hmm.ending, a)}
    place = {w: k for w, k in zip(lex.words, lex.symbol, strict=True)}
    want = []
    for _, t in rows:
        share = sum(math.log10((c[w] + 1) / (sum(total[hmm.ending(w)]) + 1)) for w in words(t) if w not in mine)
        want.append(likelihood(model, [place.get(w, hmm.ending(w)) for w in words(t)]) + share)
    assert np.allclose(sorted(r.score for r in got), sorted(want), rtol=1e-9)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.moves.sum(axis=1), 1) and (model.emit > 0).all()


def test_empty_and_untrained_tables_and_clashing_columns(spark):
    assert hmm.op13_language_model(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = next(i for i in range(100) if out_of(i))
    (row,) = hmm.op13_language_model(spark.createDataFrame([(alone, "a b")], SCHEMA)).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0) and row.score < 0
    wide = spark.createDataFrame([(1, "a b a"), (2, "b")], SCHEMA).selectExpr("*", "1 AS id", "2 AS key", "3 AS Score", "4 AS `a``b`", "5 AS part", "6 AS train", "7 AS word")
    assert sorted(r.n_tokens for r in hmm.op13_language_model(wide).collect()) == [2, 4]
