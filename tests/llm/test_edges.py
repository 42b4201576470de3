"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphmill.llm import decontaminate, language_id, license_scan, line_dedup, piece_codec, simhash, substring_dedup, url_filter, vector_search, warc
from glyphmill.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()
LONG = " ".join(f"{WORDS[i % 15]}{i}" for i in range(30_000))
PASSAGE = " ".join(WORDS)
ROWS = [
    (1, PASSAGE, "en", None, None), (2, None, "en", "s", 0), (3, "", None, "s", 0), (4, PASSAGE, "en", "s", 1), (4, PASSAGE, "en", "s", 1), (5, LONG, "en", "s", 1),
    (5, "another text of five with a few words in it", "en", "s", 1), (None, PASSAGE, "en", "s", 1), (6, "42 !!! ...", "en", "s", 1), (7, "x " + PASSAGE.upper() + " y", "fr", "s", 1),
    (8, " \t\n\x0b line one is long\nLine One Is Long\n\n", None, "s", 1), (9, "line one is long\nmit license and the apache license", "fr", "s", 1), (10, "nul\x00 and \U0001f600 ☃ é", "fr", "s", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, "five with a few"), (3, None), (4, ""), (None, PASSAGE), (5, "never seen words here at all in any of these texts")], "item_id long, text string")


def clashing(frame):
    """The same rows with columns that operators make or use themselves."""
    out = frame
    for c in ("kept", "n_lines", "n_dropped", "held_out", "score", "n_words", "items", "ids", "host", "verdict", "matches", "x", "h"):
        out = out.withColumn(c, F.lit("mine"))
    return out


def by_row(rows):
    return sorted(((r.doc_id is None, r.doc_id, *tuple(r)[1:]) for r in rows), key=repr)


def test_line_dedup(docs):
    got = {(r.doc_id, r.text): r for r in line_dedup.line_dedup(clashing(docs)).collect()}
    assert len(got) == 12 and line_dedup.line_dedup(docs).count() == 13
    assert got[(1, PASSAGE)].n_dropped == 0 and got[(4, PASSAGE)].n_dropped == 1 and got[(4, PASSAGE)].kept == ""
    assert got[(None, PASSAGE)].n_dropped == 0 and got[(2, None)].n_lines == 1 and got[(3, "")].kept == ""
    assert got[(8, ROWS[10][1])].n_dropped == 0 and got[(9, ROWS[11][1])].kept == "mit license and the apache license"
    three = {(r.doc_id, r.text): r.n_dropped for r in line_dedup.line_dedup(docs, min_docs=3).collect()}
    assert sum(three.values()) == 0


def words_of(text, kind):
    return re.findall(r"[^\x20\x09-\x0D]+" if kind == "space" else r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if kind == "fold" else text or "")


@pytest.mark.parametrize("window", [13, 6, 3])
def test_substring_dedup(docs, window):
    texts = [(r[0], r[1]) for r in ROWS]
    first = {}
    for i, t in texts:
        w = words_of(t, "space")
        for k in range(len(w) - window + 1):
            if i is not None:
                first[tuple(w[k : k + window])] = min(i, first.get(tuple(w[k : k + window]), i))
    want = []
    for i, t in texts:
        w = words_of(t, "space")
        gone = {k + j for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for j in range(window)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [tuple(r) for r in substring_dedup.substring_dedup(clashing(docs), window=window).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 60])
def test_decontamination(docs, bench, block):
    items = [(1, PASSAGE), (2, "five with a few"), (5, "never seen words here at all in any of these texts")]
    windows = {}
    for i, t in items:
        w = words_of(t, "fold")
        for k in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = []
    for i, t, *_ in ROWS:
        w, hit, found = words_of(t, "fold"), set(), set()
        for win, own in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= own
        want.append((i, len(w), len(hit), sorted(found), bool(hit)))
    got = decontaminate.decontaminate(clashing(docs), bench, block_bytes=block).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


def test_simhash(docs):
    got = simhash.near_groups(docs).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["__id"], []).append(r)
    assert {r.component_id for r in by_id[4]} == {1} and by_id[None][0].component_id is None
    assert by_id[2][0].fingerprint == by_id[3][0].fingerprint == 0 and by_id[3][0].component_id == 2
    assert len({r.component_id for r in by_id[5]}) == 1  # rows of one id are one document
    kept = simhash.near_dedup(clashing(docs)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 5, 6, 7, 8, 9, 10] or sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 5, 6, 8, 9, 10]
    assert sum(r.doc_id is None for r in kept) == 1
    with pytest.raises(ValueError):
        simhash.links(docs.select(F.lit(1).cast("long").alias("f")), 4)


def test_links_against_all_pairs(spark):
    import random

    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(60)]
    all_ = set(base)
    for b in base:
        for k in (1, 2, 3, 4):
            x = b
            for bit in rnd.sample(range(64), k):
                x ^= 1 << bit
            all_.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in all_)
    want = {(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "f long")).collect()}
    assert got == want and len(want) > 150


def test_components_of_long_paths(spark):
    from glyphmill.llm.graph import components

    edges = [(i, i + 1) for i in range(1, 70)] + [(200, 100), (100, 300), (5, 5)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(2, 71)} | {200: 100, 300: 100}


def test_license_scan(docs):
    got = {(r.doc_id, r.n_words): r for r in license_scan.op6_license_scan(clashing(docs)).collect()}
    r = got[(9, 10)]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (2, 4, 8, "apache,mit", "apache,mit", 1.0)
    assert got[(2, 0)].n_base == 0 and got[(2, 0)].first_word is None and got[(2, 0)].base_labels == "" and got[(2, 0)].score == 0.0


def test_license_notices(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: MIT License MIT LICENSE"
    r = license_scan.op6_license_scan(spark.createDataFrame([(1, bsd)], "doc_id long, text string")).first()
    assert r.base_labels == "mit" and r.labels == "bsd,mit" and r.n_base == 2


def test_language_id(spark, docs):
    got = language_id.identify(clashing(docs)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    nothing = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_language_id_ignores_held_out_labels(spark):
    texts = {"en": "the cat sat on the mat with the other cats of the town " * 8, "es": "el gato se sienta en la alfombra con los otros gatos del pueblo " * 8}
    rows = [(i, texts["en" if i % 2 else "es"] + f" {i}", "en" if i % 2 else "es") for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = {r.doc_id: r for r in language_id.identify(frame).collect()}
    assert all(r.lang_pred == r.lang for r in good.values()) and 0 < sum(r.held_out for r in good.values()) < 80
    wrong = frame.withColumn("lang", F.when(language_id.held_out(), "xx").otherwise(F.col("lang")))
    assert {r.doc_id: r.lang_pred for r in language_id.identify(wrong).collect()} == {k: r.lang_pred for k, r in good.items()}


def test_automaton_accepts_exactly_the_substrings():
    text = b"abracadabra"
    step = {(s, c): t for s, c, t in zip(*(x.tolist() for x in language_id.automaton(text)), strict=True)}

    def accepts(w):
        s = 1
        for c in w:
            s = step.get((s, c), 0)
            if not s:
                return False
        return True

    import itertools

    for n in range(1, 5):
        for w in itertools.product(b"abrcd", repeat=n):
            assert accepts(w) == (bytes(w) in text)


def test_piece_codec(spark, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    got = piece_codec.encode(docs.withColumn("t2", F.col("text")), TOKENIZER).collect()
    for r in got:
        assert list(r.ids) == lib.encode(r.t2 or "") and r.round_trip and r.n_ids == len(r.ids)
    back = piece_codec.decode(piece_codec.encode(docs.withColumn("t2", F.col("text")), TOKENIZER), TOKENIZER).collect()
    assert all(r.decoded == (r.t2 or "") for r in back)


def test_piece_codec_on_random_texts():
    import random

    import sentencepiece

    codec, lib = piece_codec.Codec(open(TOKENIZER, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    rnd = random.Random(11)
    parts = ["a", "b", "e", "th", "ing", " ", "  ", "    ", "é", "😀", "\n", "\t", "1", ".", "the", "漢", "--", "____", "▁", "́"]
    for _ in range(3000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))
        assert codec.encode(s).tolist() == lib.encode(s), s
    long = "abcde" * 500 + "x" * 700 + " " * 300
    assert codec.encode(long).tolist() == lib.encode(long)


PAGES = [(1, "http://A.com/x", "<a href='http://bad.example.com/en/1'>"), (2, "nope", None), (3, None, ""), (4, "https://bad.example.com/en/1?q", "same"), (4, "https://bad.example.com/en/1?q", "same"),
         (5, "x://b.net/fr/a#t", "same"), (6, "http://www.example.com/en/", "é☃"), (None, "http://c.org", "same"), (7, "http://d.org/", "<a href=//d.org/x>"), (8, "HTTP://É.COM:80\n/a b", "y" * 300)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)


def test_warc(pages):
    got = warc.round_trip(clashing(pages), chunk=64).collect()
    want = []
    for p, _, h in PAGES:
        raw = (h or "").encode()
        same = [q for q, _, x in PAGES if q is not None and (x or "") == (h or "")]
        first = min(same) if same else None
        again = p is not None and first is not None and p > first
        import base64

        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got), key=repr) == sorted(want, key=repr)


def test_warc_chunks_and_threshold(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/w"
    archives = warc.write_archives(pages, folder, min_bytes=5, chunk=64)
    rows = warc.read_archives(archives, folder, with_data=True, chunk=64).collect()
    parts = sorted((r.chunk_no, bytes(r.chunk)) for r in rows if r.page_id == 8)
    assert len(parts) >= 5 and b"".join(p for _, p in parts) == b"y" * 300 and max(len(p) for _, p in parts) <= 64
    assert all(r.record_type == "response" for r in rows)  # what repeats is shorter than min_bytes


def test_url_filter(pages):
    got = {(r.page_id, r.url): r for r in url_filter.url_filter(clashing(pages)).collect()}
    assert (got[(1, PAGES[0][1])].host, got[(1, PAGES[0][1])].path, got[(1, PAGES[0][1])].rule) == ("a.com", "/x", "com/")
    assert (got[(2, "nope")].host, got[(2, "nope")].path, got[(2, "nope")].rule, got[(2, "nope")].verdict) == ("", "", None, "allow")
    assert got[(4, PAGES[3][1])].rule == "example.com/en/" and got[(4, PAGES[3][1])].verdict == "block"
    assert got[(6, PAGES[6][1])].rule == "www.example.com/en/" and got[(None, "http://c.org")].path == ""
    assert got[(8, PAGES[9][1])].host == "É.com:80\n"


def test_propagation_against_matrices(spark):
    import numpy as np

    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("d", "c", 1)]
    seeds = [("a", 3.0, 0.0, 3.0), ("c", 0.0, 2.0, 2.0), ("d", 0.0, 0.0, 1.0)]
    got = {r.host: r for r in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, trust double, distrust double, weight double"), rounds=5).collect()}
    names = "abcd"
    a = np.zeros((4, 4))
    for s, d, n in edges:
        a[names.index(s), names.index(d)] = n
    along, against = a / np.maximum(a.sum(1, keepdims=True), 1), (a / np.maximum(a.sum(0, keepdims=True), 1)).T
    s = np.zeros((3, 4))
    for h, *v in seeds:
        s[:, names.index(h)] = v
    r = s.copy()
    for _ in range(5):
        r = 0.15 * s + 0.85 * np.stack([r[0] @ along, r[1] @ against, r[2] @ along])
    for k, h in enumerate(names):
        if h in got:
            assert np.allclose([got[h].trust, got[h].distrust, got[h].weight], r[:, k], atol=1e-9)


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    pages = [(i, f"http://bad.example.com/en/{i}", "") for i in range(5)] + [(9, "http://farm.org/1", "<a href='http://bad.example.com/en/1'><a href='http://bad.example.com/en/2'>"), (10, "http://good.org/1", "<a href='/x'>")]
    got = {r.page_id: r.verdict for r in url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[9] == "block" and got[10] == "allow"


def test_vector_search(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)).round(3)
    x[100:130] = x[100]  # ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)]
    bad = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [None] + [1.0] * 7), (None, [1.0] * 8), (1080, [1.0] * 5), (20, rows[20][1])]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("v", F.lit("mine")).withColumn("list", F.lit(1))
    got = {}
    for r in vector_search.op1_vector_search(frame).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - s[f[1]]) < 1e-12 for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & set(order))
    assert hits / (20 * len(got)) >= 0.9
    few = vector_search.search(frame.where("vec_id < 5"), lambda c: c % 20 == 0).collect()
    assert len(few) == 4 and vector_search.search(frame.where("vec_id = 1000"), lambda c: c > 0).count() == 0


def test_empty_tables(docs, pages, bench):
    none, no_pages = docs.limit(0), pages.limit(0)
    for out in (line_dedup.op5_line_dedup(none), substring_dedup.op9_substring_dedup(none), decontaminate.op8_decontaminate(none, bench), simhash.op3_simhash(none), license_scan.op6_license_scan(none),
                language_id.op2_language_id(none), piece_codec.op7_piece_codec(none, TOKENIZER), url_filter.op4_url_filter(no_pages), warc.op10_warc(no_pages)):
        assert out.count() == 0


def test_every_stage(spark, docs, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, frame, str(tmp_path))
            assert out.count() <= frame.count()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
