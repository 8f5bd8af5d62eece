"""Registered queries over the small tables against their SQL, and the pipeline against its stages' promises."""

import os

import duckdb
import pytest
from conftest import DATA

import corpus_pipeline
from gradeloom.llm import queries
from gradeloom.llm.jaccard import jaccard_components


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got = queries.queries()[name](spark, DATA)
    result = con.execute(queries.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in result.description], result.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    clean = docs
    for _, stage in corpus_pipeline.STAGES[:-2]:
        clean = stage(spark, clean, DATA)
        assert clean.columns == docs.columns
    own = {r["doc_id"] for r in clean.select("doc_id").collect()}
    leaks = {r["doc_id"] for r in queries.op9_decontamination(spark, DATA).select("doc_id").collect()}
    assert not own & leaks
    left = jaccard_components(clean).collect()
    assert all(r["component_id"] == r["doc_id"] for r in left)
    assert len(own) >= 0.8 * docs.count()
    got = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in got.collect()} == own
    assert got.columns == [*docs.columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] == text[r["doc_id"]] for r in got.collect())
