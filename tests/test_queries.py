"""Every query beside its SQL."""

import os

import duckdb
import pytest

from docstrata.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def test_every_query_has_sql_or_is_iterative():
    assert set(QUERIES) - set(SQL) == {"hdbscan_leaf", "umap_2d", "topic_merge", "topic_distribution_embedded", "topic_words_reranked"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    rows = [r.asDict() for r in got.collect()]
    assert rows
    if name in SQL:
        wanted = duck.sql(SQL[name])
        assert sorted(wanted.columns) == sorted(got.columns)
        columns = sorted(got.columns)
        listed = sorted([tuple(map(str, (dict(zip(wanted.columns, r))[c] for c in columns))) for r in wanted.fetchall()])
        assert sorted(tuple(str(r[c]) for c in columns) for r in rows) == listed
