"""The driver contract, and that nothing outside the subpackage needs it."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from glyphmill import queries as own

ROOT, DATA = Path(__file__).resolve().parents[1], "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("style_features", "report_rows", "overlap_matches", "sentence_scores", "method_rates", "keyword_queries", "signal_report", "signalled_report", "gram_sets")


def test_no_module_outside_imports_the_subpackage():
    for p in (ROOT / "glyphmill").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text()), p


def test_entry_runs(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and "style" in rows.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(own.ORACLES[name])
    cols = [c[0] for c in cur.description]
    frame = own.QUERIES[name](spark, DATA)
    assert sorted(frame.columns) == sorted(cols)
    assert sorted(map(repr, map(tuple, frame.select(*cols).collect()))) == sorted(map(repr, cur.fetchall()))
