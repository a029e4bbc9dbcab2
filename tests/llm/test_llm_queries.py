"""The registered corpus queries on the smallest tables, against SQL or plain loops; and the pipeline's stages."""

from __future__ import annotations

import math

import duckdb
import pytest

import corpus_pipeline
from tidewright.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(str(x[c]) for c in columns) for x in df.collect())
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(str(row[names.index(c)]) for c in columns) for row in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_a_row_a_document(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert QUERIES[name](spark, FOLDER).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    from tidewright.llm.common import written

    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER), name)
        assert docs.columns[:5] == columns
        n.append(docs.count())
    assert n[0] > n[1] > n[2] >= n[3] > 0 and n[4] == n[5]
    assert not any(math.isnan(x) for x in n) and "shard" in docs.columns
    assert corpus_pipeline.run(spark, FOLDER).count() == n[5]
