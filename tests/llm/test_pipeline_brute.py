"""The whole pipeline restated in plain Python over the driver's smallest table."""

import math
import re

import duckdb
import pyarrow as pa
import sentencepiece
from test_language_parsing import phrases

import corpus_pipeline
from glyphmill.llm import language_id, near_copies

DATA = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def in_a_language(docs, samples):
    kept = {}
    for i, text in docs.items():
        if any(map(str.isalpha, text or "")):
            raw = language_id.normal_bytes(pa.array([text]))[0].tobytes()
            count = {x: phrases(raw, own) for x, own in samples.items()}
            best = min(sorted(samples), key=lambda x: count[x] * math.log2(max(2, len(samples[x]))))
            if count[best] <= corpus_pipeline.MAX_PHRASE_RATE * len(raw):
                kept[i] = text
    return kept


def without_repeated_lines(docs):
    key = lambda line: lower(line.strip(BLANK))
    first, held = {}, {}
    for i in sorted(docs):
        for k in {key(x) for x in docs[i].split("\n")}:
            first.setdefault(k, i)
            held.setdefault(k, set()).add(i)
    out = {}
    for i, text in docs.items():
        lines = text.split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or first[key(x)] == i]
        if len(stay) == len(lines):
            out[i] = text
        elif "\n".join(stay).strip(BLANK):
            out[i] = "\n".join(stay)
    return out


def first_of_near_copies(docs):
    sets, root = {i: near_copies.shingle_set(t) for i, t in docs.items()}, {i: i for i in docs}
    for i in sorted(docs):
        for j in sorted(docs):
            if i < j and root[i] != root[j] and near_copies.similar(sets[i], sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return {i: t for i, t in docs.items() if root[i] == i}


def without_benchmark(docs, items):
    windows = set()
    for text in items:
        w = words(text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    return {i: t for i, t in docs.items() if not any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))}


def test_the_pipeline_keeps_and_encodes_what_plain_python_does(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    items = [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/benchmark.parquet'").fetchall()]
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    parser = language_id.learn(frame)
    samples = learned(frame)
    assert sorted(samples) == parser.langs
    kept = without_benchmark(first_of_near_copies(without_repeated_lines(in_a_language(docs, samples))), items)
    lib = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.TOKENIZER)
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == {i: lib.encode(t) for i, t in kept.items()} and 50 < len(got) < len(docs)


def learned(frame):
    """The samples that the fit takes, which is no part of the restatement."""
    found = {}
    plain = language_id.Parser.__init__

    def seen(self, samples):
        found.update(samples)
        plain(self, samples)

    language_id.Parser.__init__ = seen
    try:
        language_id.learn(frame)
    finally:
        language_id.Parser.__init__ = plain
    return found
