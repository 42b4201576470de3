"""Registered queries: SQL at the smallest scale, brute force and accuracy where SQL has no words for it."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from glyphmill.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def test_operators_and_the_pipeline_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, con, name):
    cur = con.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    frame = QUERIES[name](spark, DATA)
    assert sorted(frame.columns) == sorted(cols)
    assert sorted(map(repr, map(tuple, frame.select(*cols).collect()))) == sorted(map(repr, cur.fetchall()))


def test_recall(spark, con):
    got = {}
    for r in QUERIES["op1_vector_search"](spark, DATA).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = con.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        found += len(got[ids[q]] & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
    assert found / (20 * len(got)) >= 0.9


def test_held_out_accuracy(spark, con):
    lang = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = [r for r in QUERIES["op2_language_id"](spark, DATA).collect() if r.held_out and r.lang_pred != "und"]
    assert len(rows) > 30 and sum(r.lang_pred == lang[r.doc_id] for r in rows) / len(rows) > 0.97


def test_pipeline(spark, con):
    rows = corpus_pipeline.run(spark, DATA).collect()
    docs = con.execute("SELECT count(*), count(DISTINCT text) FROM documents").fetchone()
    assert all(r.round_trip for r in rows) and 0.6 * docs[1] < len(rows) <= docs[1] and len({r.doc_id for r in rows}) == len(rows)
