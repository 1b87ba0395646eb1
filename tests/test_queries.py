"""Every registered query of the search engine, and its SQL, at the smallest scale."""

import duckdb
import pytest

from sparkseek.plans import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "embeddings", "benchmark", "labels"]


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", ["knn_cosine", "knn_int8", "two_phase_binary", "bm25_stemmed", "hybrid_filtered", "rrf_fuse", "reconcile_ops", "toy_embed", "semantic_cache", "corpus_upsert"])
def test_query_against_sql(spark, sql, name):
    df, other = Q.QUERIES[name](spark, DATA), sql.sql(Q.SQL[name])
    rows = df.collect()
    assert rows and plain(rows, df.columns) == plain(other.fetchall(), list(other.columns))


def test_every_query_is_callable_and_sql_names_a_query():
    assert set(Q.SQL) <= set(Q.QUERIES) and len(Q.QUERIES) > 35
