"""Fingerprints and components of op3_simhash, restated in plain Python."""

import duckdb
import xxhash

from glyphmill.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark):
    prints = [(i, fingerprint(t)) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()]
    root = {i: i for i, _ in prints}
    moved = True
    while moved:
        moved = False
        for i, a in prints:
            for j, b in prints:
                if (a ^ b).bit_count() <= 3 and root[j] > root[i]:
                    root[j], moved = root[i], True
    got = sorted(map(tuple, QUERIES["op3_simhash"](spark, DATA).collect()))
    assert got == [(i, f"{f:016x}", root[i]) for i, f in prints]
