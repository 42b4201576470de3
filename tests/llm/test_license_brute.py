"""License scans against every alignment, and base columns on the driver's table."""

import math
import random
import re

import duckdb
import numpy as np

from glyphmill.llm import license_scan
from glyphmill.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def words_of(text):
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def brute(texts, templates):
    """(label, start, words, base, share) of each text, by trying every place of every template."""
    held = {}
    for t in texts:
        for w in set(words_of(t)):
            held[w] = held.get(w, 0) + 1
    code = {w: int(license_scan._hashes((w,))[0]) for t in templates for w in t.words}
    out = []
    for text in texts:
        w, found = words_of(text), []
        for t in templates:
            chosen = sorted(set(t.words) & set(w), key=lambda x: (held[x], code[x]))[: 1 if t.base else license_scan.RARE]
            need = max(1, math.ceil(license_scan.VOTES * len(chosen)))
            for start in range(-len(t.words), len(w)):
                placed = [j for j in range(len(t.words)) if 0 <= start + j < len(w) and w[start + j] == t.words[j]]
                votes = sum(t.words[j] in chosen for j in placed)
                if chosen and votes >= need and all(start + i >= 0 and tuple(w[start + i : start + i + len(k)]) == k for i, k in t.keys):
                    found.append((t.label, start, len(t.words), t.base, len(placed) / len(t.words)))
        out.append(sorted(found, key=lambda m: (m[1], m[0], m[2])))
    return out


def test_every_alignment(spark):
    rnd = random.Random(5)
    vocab = "the software license mit apache general public gnu copy use of and to be granted in this under terms with or without version".split()
    whole = [" ".join(x.decode() for x in t.words) for t in license_scan.NOTICES]
    texts = [None, "", "MIT license MIT License mit-license", "mit mit license license"]
    for _ in range(220):
        parts = [" ".join(rnd.choices(vocab, k=rnd.randint(0, 25))) for _ in range(3)]
        for _ in range(rnd.randint(0, 2)):
            own = rnd.choice(whole).split()
            lo = rnd.randint(0, max(0, len(own) // 3))
            own = own[lo : lo + rnd.randint(3, len(own))]
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = rnd.choice(vocab)
            parts.insert(rnd.randint(0, len(parts)), " ".join(own))
        texts.append("\n".join(parts))
    templates = (*license_scan.BASE, *license_scan.NOTICES)
    got = license_scan.license_scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)).collect()
    want = brute(texts, templates)
    for r in got:
        assert [tuple(m) for m in r.matches] == want[r.doc_id] and r.n_words == len(words_of(texts[r.doc_id]))
    assert sum(map(len, want)) > 150 and len({m[0] for x in want for m in x}) > 8


def test_long_texts_and_repeated_rows(spark):
    long = "filler words " * 60_000 + "MIT License " + "more words " * 1000 + "general public license"
    rows = license_scan.op6_license_scan(spark.createDataFrame([(1, long), (1, long), (2, "apache license " * 5000)], "doc_id long, text string")).collect()
    a, b, c = sorted(rows, key=lambda r: r.doc_id)
    assert a == b and (a.n_base, a.first_word, a.last_word, a.base_labels) == (2, 120_000, 122_002, "gpl,mit")
    assert (c.n_base, c.first_word, c.last_word) == (5000, 0, 9998)


def test_base_columns_in_sql(spark):
    found = "list_filter(range(1, len(w) + 1), lambda i: {})"
    mit, apache = found.format("w[i] = 'mit' AND w[i + 1] = 'license'"), found.format("w[i] = 'apache' AND w[i + 1] = 'license'")
    gpl = found.format("w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license'")
    sql = rf"""WITH a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM '{DATA}/documents.parquet'),
    b AS (SELECT doc_id, len(w) AS n, {mit} AS m, {apache} AS p, {gpl} AS g FROM a)
    SELECT doc_id, n, len(m) + len(p) + len(g), list_min(m || p || g) - 1, list_max(m || p || g) - 1, concat_ws(',', CASE WHEN len(p) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END) FROM b"""
    got = QUERIES["op6_license_scan"](spark, DATA).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(sql).fetchall()) and sum(r.n_base for r in got) > 0


def test_rarity_ties_go_to_the_smaller_hash():
    t = license_scan.Template.of("x", "alpha beta gamma delta epsilon zeta eta theta", ("alpha beta",))
    vocabulary = np.unique(license_scan._hashes(t.words))
    index = license_scan.Index((t,), vocabulary, np.ones(len(vocabulary), np.int64))
    assert index.rank.tolist() == list(range(len(vocabulary)))
