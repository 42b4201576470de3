"""Phrase counts against a plain search, and what is learned from."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import language_id


def phrases(text: bytes, sample: bytes) -> int:
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1
    return n


@pytest.mark.parametrize("again", [language_id.AGAIN, 0])
def test_phrases_are_the_longest_matches(monkeypatch, again):
    monkeypatch.setattr(language_id, "AGAIN", again)
    rnd = random.Random(1)
    for trial in range(12):
        letters = "ab " if trial % 3 else "abcdéxyz  "
        samples = {f"l{k}": "".join(rnd.choice(letters) for _ in range(rnd.choice([5, 60, 700]))) for k in range(3)}
        learned = {k: language_id.normal_bytes(pa.array([v]))[0].tobytes() for k, v in samples.items()}
        parser = language_id.Parser(learned)
        texts = ["".join(rnd.choice(letters + "q") for _ in range(n)) for n in (0, 3, 100, 256, 257, 1500)] + [None, "a" * 3000, "ab" * 900, "".join(samples.values()) * 2]
        found, size = parser.phrases(pa.array(texts))
        data, at = language_id.normal_bytes(pa.array(texts))
        for i in range(len(texts)):
            raw = data[at[i] : at[i + 1]].tobytes()
            assert size[i] == len(raw) and found[i].tolist() == [phrases(raw, learned[x]) for x in parser.langs]


def test_a_language_of_long_texts_only(spark):
    en, es = "the cat sat on the mat with the other cats of the town ", "el gato se sienta en la alfombra con los otros gatos del pueblo "
    rows = [(i, (en if i % 2 else es * 500) + f" {i}", "en" if i % 2 else "es") for i in range(80)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == r.lang for r in got) and min(len(r.text) for r in got if r.lang == "es") > 30_000


def test_many_languages(spark):
    rnd = random.Random(2)
    words = {f"l{k:03}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(150)}
    rows = [(i, " ".join(rnd.choice(words[x]) for _ in range(60)), x) for i, x in enumerate(x for x in words for _ in range(8))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    parser = language_id.learn(frame)
    assert len(parser.langs) == 150 and sum(map(len, (e[0] for e in parser.edges))) < 150 * 3 * language_id.SAMPLE_BYTES
    got = language_id.identify(frame.where(F.col("doc_id") % 16 == 0), parser=parser).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got) > 50
