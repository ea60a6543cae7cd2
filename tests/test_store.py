"""The chunk store: a scope prunes partitions, documents are replaced in their buckets, vectors lie beside chunks."""

import pytest
from pyspark.sql import functions as F

from lorewell.sources.sinks import ChunkStore

SCHEMA = "tenant_id long, kb_id long, doc_id long, chunk_index long, content string, embedding array<float>"


def chunks(spark, docs, word="old"):
    rows = [(d % 3, d % 5, d, k, f"{word} {d}-{k}", [float(d), float(k)]) for d in docs for k in range(2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    found = ChunkStore(str(tmp_path / "chunks"), 4)
    assert found.replace(chunks(spark, range(120))) > 30
    return found


def read_files(df):
    return df.select(F.input_file_name().alias("f")).distinct().count()


def test_a_scope_prunes_files(spark, store):
    literal = store.read(spark).where("tenant_id = 1 AND kb_id = 2")
    table = spark.range(10).select(F.col("id").alias("tenant_id"), (F.col("id") + 1).alias("kb_id"), F.concat(F.lit("t"), "id").alias("name")).where("name = 't1'")
    told = store.scoped(F.broadcast(table))
    assert sorted(r.doc_id for r in told.collect()) == sorted(r.doc_id for r in literal.collect()) and literal.count() == 16
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "tenant_id" in plan(literal).split("PartitionFilters")[1] and "dynamicpruning" in plan(told)
    assert 0 < read_files(literal) <= read_files(store.read(spark)) / 10


def test_documents_are_replaced_in_their_buckets(spark, store):
    before = {r.f for r in store.read(spark).select(F.input_file_name().alias("f")).distinct().collect()}
    assert store.replace(chunks(spark, [7, 22], "new")) <= 2
    after = {r.f for r in store.read(spark).select(F.input_file_name().alias("f")).distinct().collect()}
    touched = {f.rsplit("/", 1)[0] for f in after - before}
    assert 1 <= len(touched) <= 2 and {f for f in before if f.rsplit("/", 1)[0] not in touched} <= after
    got = sorted((r.doc_id, r.chunk_index, r.content, list(r.embedding)) for r in store.read(spark).collect())
    assert got == sorted((d, k, f"{'new' if d in (7, 22) else 'old'} {d}-{k}", [float(d), float(k)]) for d in range(120) for k in range(2))


def test_documents_of_a_scope_and_bases_that_go(spark, store):
    one = spark.createDataFrame([(1, 2, 7), (1, 2, 8)], "tenant_id long, kb_id long, doc_id long")
    assert sorted(r.doc_id for r in store.scoped(one).collect()) == [7, 7]
    store.remove_bases(spark, 1, [2])
    assert store.read(spark).where("tenant_id = 1 AND kb_id = 2").count() == 0 and store.read(spark).count() == 240 - 16
