"""Queries with SQL against DuckDB; the pipeline stage by stage."""

from collections import Counter

import duckdb
import pytest

from lendlens.llm.common import table
from lendlens.llm.queries import ORACLE_SQL, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, small, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = QUERIES[name](spark, small)
    columns = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_chat_query_adds_the_trap(spark, small):
    row = QUERIES["op5_chat"](spark, small).where("conv_id = -1").collect()[0]
    assert row["n_turns"] == 2 and row["loss_chars"] == 21


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = table(spark, small, "documents")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).cache()
        sizes.append(docs.count())
        if name != "bpe_encoding":
            assert docs.columns == columns
    assert sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and sizes[3] == sizes[2] and sizes[5] == sizes[4]
    assert corpus_pipeline.run(spark, small).count() == sizes[5]
