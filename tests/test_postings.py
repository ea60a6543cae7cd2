"""The stored lexical index: rows of the plain search, blocks read for a common term, edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from lorewell.operators import lexical, postings

DATA = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 5)) for r in df.collect())


@pytest.mark.parametrize("block_docs", [4, 64, 100_000])
def test_rows_of_the_plain_search(spark, tmp_path, block_docs):
    chunks = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    index = postings.build(chunks, str(tmp_path), postings.PostingsParams(block_docs=block_docs, shard_postings=20_000))
    assert index.shards > 4
    for k in (1, 5):
        assert rows_of(postings.search(postings.load(spark, str(tmp_path)), items, k)) == rows_of(lexical.search(chunks, items, k))


@pytest.fixture(scope="module")
def made(spark):
    """Every document has the common term; few have a rare one."""
    rng = random.Random(6)
    words = ["common"] + [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(["common"] * rng.randrange(1, 4) + rng.choices(words, k=rng.randrange(3, 30)) + (["rare"] if k % 97 == 0 else []))) for k in range(2000)]
    docs += [(2000, ""), (2001, None), (2002, "common"), (2002, "common"), (2003, "common common"), (2003, "common w1 w1")]
    return spark.createDataFrame(docs, "doc_id long, content string")


def test_small_collection_with_ties_and_repeats(spark, made, tmp_path):
    asked = [(1, "common"), (2, "rare common"), (3, "rare"), (4, "w1 w2 w3"), (5, "absent"), (6, ""), (7, None), (8, "Common COMMON w39"), (9, "absent common w5"), (1, "common")]
    questions = spark.createDataFrame(asked, "query_id long, query string")
    index = postings.build(made, str(tmp_path), postings.PostingsParams(block_docs=16, first_buckets=2))
    assert index.docs == 2005
    for k in (1, 3, 50, 5000):
        assert rows_of(postings.search(index, questions, k)) == rows_of(lexical.search(made, questions.distinct(), k))


def test_a_common_term_costs_blocks(spark, made, tmp_path, monkeypatch):
    index = postings.build(made, str(tmp_path), postings.PostingsParams(block_docs=16))
    read = []
    plain = postings._scored

    def spied(blocks, buckets, terms):
        read.append(blocks.join(buckets.join(terms, "query_id"), ["term", "bucket"]).where("term = 'common'").count())
        return plain(blocks, buckets, terms)

    monkeypatch.setattr(postings, "_scored", spied)
    postings.search(index, spark.createDataFrame([(1, "rare common")], "query_id long, query string"), 3).collect()
    every = index.blocks(spark).where("term = 'common'").count()
    assert every > 100 and sum(read) < every / 4


def test_partitions_of_other_terms_are_not_read(spark, made, tmp_path):
    index = postings.build(made, str(tmp_path), postings.PostingsParams(block_docs=16, shard_postings=500))
    found = postings.search(index, spark.createDataFrame([(1, "rare")], "query_id long, query string"), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert index.shards > 20 and "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [(shard" in plan
    files = index.blocks(spark).where(F.col("shard") == postings._shard(F.lit("rare"), index.shards)).inputFiles()
    assert rows_of(found) and len(files) >= 1


def test_empty_collection_and_names(spark, made, tmp_path):
    none = postings.build(made.limit(0), f"{tmp_path}/a")
    questions = spark.createDataFrame([(1, "rare w1")], "query_id long, query string")
    assert postings.search(none, questions, 3).collect() == []
    named = made.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.lit("Title words").alias("title"), "content")
    index = postings.build(named, f"{tmp_path}/b")
    asked = spark.createDataFrame([(1, "rare title")], "query_id long, query string")
    assert rows_of(postings.search(index, asked, 4)) == rows_of(lexical.search(named, asked, 4))
    assert postings.search(index, questions.limit(0), 3).collect() == []
