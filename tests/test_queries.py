"""Registered queries against their SQL, as the driver compares them."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from plumbrank.plans.oracle import ORACLE_SQL
from plumbrank.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "benchmark", "labels", "conversations")
#: A choice that touches each step of the SQL; the driver runs all.
CHOSEN = ("bm25_robertson_topk", "bm25_l_topk", "tfidf_raw_tf_topk", "dense_dot_topk", "bm25_chunked_folded", "rerank_coverage_penalty", "metrics_passage", "metrics_more", "evidence_reranked", "hypotheses", "diff_deltas", "significance_hashed", "label_cases", "label_agreement_by_cause", "duplicate_ids", "chunks_of_document", "hits_of_query", "causes_of_query")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(map(norm, r)) for r in df.select(*columns).collect()), key=repr)
    rel = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(ORACLE_SQL) == set(QUERIES) - {"significance_bootstrap", "significance_verdicts"}
    assert contract.entry(spark).count() > 0
