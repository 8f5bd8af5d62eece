"""Each stage of the pipeline on nulls, empty texts and tables, repeated rows and columns with clashing names."""

import collections

import pytest
from pyspark.sql import functions as F
from test_operators import CLASHES, SCHEMA, prose

from gradeloom.llm import pipeline

ROWS = [
    (1, None, None, None, None), (2, "", "en", "s0", 0), (3, " \t\n", "en", "s0", 3), (4, prose(90, 1), "en", "s0", 1), (5, prose(90, 1) + " more", "en", "s1", 1), (6, prose(90, 2), "en", None, 1),
    (6, prose(90, 2), "en", None, 1), (None, prose(90, 3), "en", "s1", 1), (None, prose(90, 1), "en", "s1", 1), (7, prose(40, 4) + " " + prose(50, 70), "en", "s0", 1), (8, "12 !!", None, "s2", 1), (9, prose(20000, 5), "en", "s0", 1),
]
NAMES = [*CLASHES, "gone", "may", "leaked_text_key", "row", "text_key_", "grown_shard", "text_crc32", "lang_pred", "score", "Shard"]


@pytest.fixture(scope="module")
def docs(spark):
    own = [c for c in dict.fromkeys(NAMES) if c != "Shard"]
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(99) for c in own}).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, prose(50, 70)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def ids(df):
    return collections.Counter(r["doc_id"] for r in df.collect())


def kept(df, docs):
    """A stage before the last returns the columns of its documents with their values."""
    assert df.columns == docs.columns
    own = collections.Counter(map(tuple, docs.collect()))
    return not set(map(tuple, df.collect())) - set(own)


def test_language_id(spark, docs, folder):
    got = pipeline.language_id(spark, docs, folder)
    assert kept(got, docs)
    assert ids(got) == {4: 1, 5: 1, 6: 2, None: 2, 7: 1, 9: 1}


def test_near_duplicates(spark, docs, folder):
    got = pipeline.near_duplicates(spark, docs, folder)
    assert kept(got, docs)
    assert ids(got) == {1: 1, 2: 1, 3: 1, 4: 1, 6: 2, None: 2, 7: 1, 8: 1, 9: 1}


def test_benchmark_leaks(spark, docs, folder):
    got = pipeline.benchmark_leaks(spark, docs, folder)
    assert kept(got, docs)
    assert ids(got) == ids(docs) - collections.Counter([7])


def test_source_mix(spark, docs, folder):
    got = pipeline.source_mix(spark, docs, folder)
    assert kept(got, docs)
    assert not ids(docs) - ids(got)


def test_shards(spark, docs, folder):
    got = pipeline.shards(spark, docs, folder)
    names = {*docs.columns} - {"size", "shard", "law", "slot", "grown_shard", "text_crc32"}
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert got.columns[-6:] == added
    assert names | {"size_", "shard_", "law_", "slot_", "grown_shard_", "text_crc32_"} == {*got.columns[:-6]}
    rows = got.collect()
    assert ids(got) == ids(docs)
    assert all(r["shard_"] == r["size_"] == 99 and r["shard"] < 40 and r["size"] == len((r["text"] or "").encode()) + 16 for r in rows)


@pytest.mark.parametrize(("name", "stage"), pipeline.STAGES)
def test_an_empty_table(spark, docs, folder, name, stage):
    assert stage(spark, docs.limit(0), folder).collect() == []
