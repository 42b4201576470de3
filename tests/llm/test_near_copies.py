"""The pipeline's near-copy stage against all pairs."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from glyphmill.llm import near_copies


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stage_keeps_what_all_pairs_keep(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)]
    rows = [(1, None), (2, ""), (3, "Two words"), (4, "two  WORDS"), (5, "other words"), (5, "yet another one")]
    for _ in range(40):  # copies with one changed word in 60 to 200
        base = rnd.choices(vocab, k=rnd.choice([60, 120, 400]))
        for _ in range(5):
            copy = list(base)
            for i in rnd.sample(range(len(copy)), len(copy) // rnd.choice([60, 90, 120, 200])):
                copy[i] = rnd.choice(vocab)
            rows.append((len(rows) + 10, " ".join(copy)))
    group = {i: i for i, _ in rows}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    sets, hard = [(i, shingles(t)) for i, t in rows], 0
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or (a | b and 5 * len(a & b) >= 4 * len(a | b)):
                hard += a != b and len(a & b) < 0.9 * len(a | b)
                x, y = sorted((root(i), root(j)))
                group[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text")}).repartition(3)
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(kept) == sorted(i for i in group if root(i) == i) and hard > 50
    assert near_copies.near_groups(docs.limit(0)).count() == 0


def test_wide_buckets_keep_what_all_pairs_keep(spark, monkeypatch):
    """Edited copies of one text, some beyond the similarity asked for, and texts that share only a passage."""
    monkeypatch.setattr(near_copies, "SMALL", 2)
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(5000)]
    base, passage, rows = rnd.choices(vocab, k=150), rnd.choices(vocab, k=70), []
    for k in range(160):
        copy = list(base)
        for i in rnd.sample(range(150), rnd.randint(1, 9)):
            copy[i] = rnd.choice(vocab)
        rows.append((k + 1, " ".join(copy)))
        rows.append((k + 1001, " ".join([*rnd.choices(vocab, k=rnd.randint(5, 90)), *passage, *rnd.choices(vocab, k=rnd.randint(5, 40))])))
    sets, root = {i: near_copies.shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}
    moved = True
    while moved:
        moved = False
        for i, a in sets.items():
            for j, b in sets.items():
                if root[i] < root[j] and near_copies.similar(a, b):
                    root[j], moved = root[i], True
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["__id"]: r.component_id for r in near_copies.near_groups(docs).collect()}
    assert got == root and 5 < len({*root.values()} - {i for i in root if i > 1000})


def test_prefix_pairs_hold_all_similar_pairs(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(900)]
    base = rnd.choices(vocab, k=60)
    rows = [(0, 0, ""), (1, 1, "one two"), (2, 2, "one two"), (3, 3, "one two three four five")]
    for k in range(4, 120):
        copy = list(base)[: rnd.randint(20, 60)]
        for i in rnd.sample(range(len(copy)), rnd.randint(0, 4)):
            copy[i] = rnd.choice(vocab)
        rows.append((k, k % 40, " ".join(copy)))
    sets = [(n, r, near_copies.shingle_set(t)) for n, r, t in rows]
    want = {(min(n, m), max(n, m)) for n, p, a in sets for m, q, b in sets if p < q and a and b and near_copies.similar(a, b)}
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in near_copies.prefix_pairs(spark.createDataFrame(rows, "node long, root long, text string")).collect()}
    assert want <= got and len(want) > 50 and len(got) < len(rows) ** 2 / 3
