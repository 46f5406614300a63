"""Registered queries against their SQL on the smallest tables, where these are at hand."""

from pathlib import Path

import pytest

import __spark_entry__
from scriptorium.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("tokenize_terms", "bm25_topk", "rrf_fusion", "vector_topk", "question_metrics", "quality_counters", "metadata_violations", "next_boundary", "overlap_chunks", "judge_parse", "corrections", "answer_evaluation")


def shown(value):
    if value is None or value != value:
        return ""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return f"{float(value):.6f}"


def test_names():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and set(catalogue.QUERIES) <= set(queries) and set(SAMPLE) <= set(catalogue.ORACLES)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_equal_to_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, str(DATA))
    want = con.sql(catalogue.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted(tuple(map(shown, r)) for r in got.select(*columns).collect()) == sorted(tuple(shown(r[i]) for i in place) for r in want.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 1
