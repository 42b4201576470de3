"""op11: the whole query in plain Python, the walk against full trees, and edge cases."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(nodes):
    tiers = [nodes]
    while len(tiers[-1]) > 1:
        tiers.append([h(tiers[-1][i : i + 3]) for i in range(0, len(tiers[-1]), 3)])
    return tiers


def path(tiers, at):
    for tier in tiers[:-1]:
        run = tier[at // 3 * 3 : at // 3 * 3 + 3]
        yield run[: at % 3], run[at % 3 + 1 :]
        at //= 3


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[1] is not None, (r[1] or "").encode()), []).append(r)
    trees = {}
    for g, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in own])
    names = sorted(groups)
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, r in enumerate(groups[g]):
            steps = [*path(trees[g], at), *path(top, k)]
            other = leaf((*r[:4], r[4] and r[4].replace("\n", ""))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else leaf(r)
            for left, right in steps:
                other = h([*left, other, *right])
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h(x for s in steps for part in s for x in part), other, other == top[-1][0]))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 80, 242, 243, 244, 500, 728, 729])
def test_walk_gives_the_paths_of_the_whole_tree(n):
    digests = [h([str(i)]) for i in range(n)]
    tiers = tree(digests)
    for at, steps in enumerate(merkle.walk(digests, merkle.levels_of(n))):
        assert steps == [(len(left), "".join(left + right)) for left, right in path(tiers, at)]
    assert at == n - 1


def test_stack_keeps_little():
    stack = merkle.Treehash(6)
    for i in range(729):
        stack.push(h([str(i)]))
        assert sum(map(len, stack.runs)) <= 2 * 6 + 1


ROWS = [
    (None, None, None, None, None), (7, "", "en", 0, ""), (7, "", "en", 0, ""), (7, "b", "en", 3, "a\nb"), (7, "b", None, 3, "a\nb"), (2, "é", "fr", 4, "\n\nñ\n"), (3, "é", "fr", None, None),
    *[(i, "hot", "es", 5, f"línea {i}\nfin\n") for i in range(2000)], *[(5000 + i, f"s{i}", "es", i, "x" * i) for i in range(40)],
]


def test_query_equals_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    got = sorted(map(repr, map(tuple, merkle.op11_merkle(docs).collect())))
    assert got == sorted(map(repr, brute(ROWS)))


def test_several_rounds_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SMALL", 0)  # spans meet their rows in a shuffle
    rows = [(i, "s", "en", 1, "a") for i in range(730)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "root", F.size("proof").alias("n"), merkle.folded(F.col("leaf"), F.col("proof")).alias("back")).collect()
    assert {r.n for r in got} == {7} and {r.back for r in got} == {got[0].root} and got[0].root == brute(rows)[0][3]


def test_empty_table_and_clashing_columns(spark):
    assert merkle.op11_merkle(spark.createDataFrame([], SCHEMA)).collect() == []
    wide = spark.createDataFrame(ROWS[:6], SCHEMA).selectExpr("*", "'x' AS leaf", "'y' AS ROOT", "1 AS tree", "2 AS pos", "3 AS digest", "4 AS `a``b`", "5 AS tampered", "6 AS row")
    assert sorted(map(repr, map(tuple, merkle.op11_merkle(wide).collect()))) == sorted(map(repr, brute(ROWS[:6])))


def test_manifest_keeps_what_is_asked(spark):
    docs = spark.createDataFrame(ROWS[:6], SCHEMA)
    got = merkle.manifest(docs, keep={"size": F.octet_length("text")})
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof", "size"]
    assert sorted(repr(r["size"]) for r in got.collect()) == sorted(repr(None if r[4] is None else len(r[4].encode())) for r in ROWS[:6])
