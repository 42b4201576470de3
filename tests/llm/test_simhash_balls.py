"""Dense balls of fingerprints: links to leaders, and pairs only across what is still apart."""

import random

from glyphmill.llm import simhash
from glyphmill.llm.graph import components


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def flipped(rnd, x, bits):
    for b in rnd.sample(range(64), bits):
        x ^= 1 << b
    return x


def test_groups_are_those_of_all_pairs_and_cost_few(spark):
    rnd = random.Random(8)
    balls = [rnd.getrandbits(64) for _ in range(3)]
    all_ = {b: 50 for b in balls}
    for b in balls:
        for _ in range(250):
            all_.setdefault(flipped(rnd, b, rnd.choice([1, 2, 3, 3, 4, 5, 6])), 1)
    for _ in range(100):
        all_.setdefault(rnd.getrandbits(64), 1)
    keys = sorted(all_)
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if (a ^ b).bit_count() <= 3]
    for a, b in pairs:
        root[top(b)] = top(a)
    prints = spark.createDataFrame([(signed(k), n) for k, n in all_.items()], "f long, n long")
    star = simhash.stars(prints).collect()
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 3 for r in star) and len(star) < len(pairs) / 3
    first = {r.u: r.v for r in components(simhash.stars(prints).toDF("u", "v")).collect()}
    rooted = spark.createDataFrame([(signed(k), first.get(signed(k), signed(k))) for k in keys], "f long, root long")
    rest = {tuple(r) for r in simhash.links(rooted, 3, "root").collect()}
    of = {r.f: r.root for r in rooted.collect()}
    assert rest == {tuple(sorted((signed(a), signed(b)))) for a, b in pairs if of[signed(a)] != of[signed(b)]}
    assert len(pairs) > 3000 and len(rest) < 700
