"""Bucketed tables: what an upsert touches, import dedup against filters, statistics after each of several batches."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.operators.imports import DigestStore
from lorewell.operators.statistics import MEMBERS, Statistics
from lorewell.sources.buckets import BucketTable

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("kb", T.LongType()), T.StructField("name", T.StringType())])


def files(path):
    return {str(f.relative_to(path)) for f in path.glob("_bucket=*/*.parquet")}


def bucket_of(name):
    return int(name.split("/")[0].split("=")[1])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_files_of_other_buckets_keep_their_names(spark, tmp_path):
    table = BucketTable(str(tmp_path), ("id",), SCHEMA, 8)
    assert table.read(spark).collect() == []
    first = [(k, k % 3, f"n{k}") for k in range(200)]
    table.write(spark.createDataFrame(first, SCHEMA))
    before, want = files(tmp_path), {r[0]: r for r in first}
    assert len({bucket_of(f) for f in before}) == 8
    patch = [(3, 0, "new"), (3, 0, "newer"), (1000, 1, None)]
    numbers = table.upsert(spark.createDataFrame(patch, SCHEMA))
    want |= {3: (3, 0, "newer"), 1000: (1000, 1, None)}
    after = files(tmp_path)
    assert rows_of(table.read(spark)) == sorted(want.values(), key=str) and 1 <= len(numbers) <= 2
    assert {f for f in before if bucket_of(f) not in numbers} == {f for f in after if bucket_of(f) not in numbers}
    assert not {f for f in before if bucket_of(f) in numbers} & after
    gone = table.delete(spark.createDataFrame([(1000, None, None), (5, 9, None)], SCHEMA))
    want = {k: r for k, r in want.items() if k not in (1000, 5)}
    assert rows_of(table.read(spark)) == sorted(want.values(), key=str)
    assert {f for f in after if bucket_of(f) not in gone} == {f for f in files(tmp_path) if bucket_of(f) not in gone}
    assert table.upsert(spark.createDataFrame([], SCHEMA)) == [] and table.read(spark).count() == len(want)


def test_a_bucket_may_lose_all_its_rows_and_a_large_one_has_several_files(spark, tmp_path):
    table = BucketTable(str(tmp_path), ("kb", "id"), SCHEMA, 4, ("kb",))
    table.write(spark.createDataFrame([(k, 7, "x") for k in range(5000)] + [(1, 8, "y"), (2, 9, "z")], SCHEMA).repartition(4))
    most = table.touched(spark.createDataFrame([(0, 7, "")], SCHEMA))[0]
    assert len([f for f in files(tmp_path) if bucket_of(f) == most]) > 1
    table.delete(table.read(spark).where("kb = 7"))
    assert rows_of(table.read(spark)) == [(1, 8, "y"), (2, 9, "z")]


def test_imports(spark, tmp_path):
    rng = random.Random(3)
    docs = [(k, rng.randrange(3), f"d{rng.randrange(400)}") for k in range(600)] + [(700, 1, None), (701, None, "d1"), (702, None, None)]
    schema = "id long, knowledge_base_id long, content_md5 string"
    store = DigestStore(str(tmp_path), 8)
    assert [r["first"] for r in store.judge(spark.createDataFrame(docs[:1], schema)).collect()] == [docs[0][0]]
    parts, known = [docs[:200], docs[200:400], docs[400:]], {}
    for part in parts:
        df = spark.createDataFrame(part, schema)
        got = {r.id: r["first"] for r in store.judge(df).collect()}
        fresh = {}
        for k, kb, d in part:
            if kb is not None and d is not None:
                fresh[kb, d] = min(fresh.get((kb, d), k), k)
        assert got == {k: known.get((kb, d), fresh.get((kb, d), k)) for k, kb, d in part}
        store.add(df)
        known |= {x: min(k, known.get(x, k)) for x, k in fresh.items()}


def test_buckets_without_a_hit_are_not_read(spark, tmp_path):
    schema = "id long, knowledge_base_id long, content_md5 string"
    store = DigestStore(str(tmp_path), 8)
    store.add(spark.createDataFrame([(k, 1, f"d{k}") for k in range(2000)], schema))
    new = spark.createDataFrame([(5000 + k, 1, f"new{k}") for k in range(500)], schema)
    maybe = store._maybe(new.select("knowledge_base_id", "content_md5"))
    assert maybe.count() < 25  # about one in a hundred is let through
    one = spark.createDataFrame([(9000, 1, "d77")], schema)
    judged = store.judge(one)
    assert [r["first"] for r in judged.collect()] == [77]
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert f"_bucket#" in plan and store.digests.touched(one)[0] in range(8) and "PartitionFilters: [_bucket" in plan.replace("isnotnull(_bucket", "_bucket")


HITS = "tenant_id long, knowledge_base_id long, user_message_id long, assistant_message_id long, rank int, doc_id string, chunk_index int, cited boolean"
LABELS = "tenant_id long, knowledge_base_id long, user_message_id long, doc_id string"


def test_statistics_after_each_batch(spark, tmp_path):
    rng = random.Random(9)
    stats = Statistics(str(tmp_path), buckets=8)
    all_hits, all_labels = [], []
    for batch in range(3):
        hits = [(rng.randrange(2), 1, rng.randrange(40), rng.randrange(30), rng.randrange(5), rng.choice([f"doc{rng.randrange(30 - 12 * batch)}", "hot"]), rng.randrange(-1, 6), rng.random() < 0.5) for _ in range(300)]
        labels = [(rng.randrange(2), 1, rng.randrange(40), f"doc{rng.randrange(8 + batch)}") for _ in range(60)]
        all_hits, all_labels = all_hits + hits + hits[:20], all_labels + labels
        before = files(tmp_path / "results") if batch else set()
        numbers = stats.update(spark, spark.createDataFrame(hits + hits[:20], HITS), spark.createDataFrame(labels, LABELS))
        whole = stats.computed(stats.members_of(spark.createDataFrame(all_hits, HITS), spark.createDataFrame(all_labels, LABELS)))
        assert rows_of(stats.results.read(spark).select(*whole.columns)) == rows_of(whole)
        kept = {f for f in before if bucket_of(f) not in numbers}
        assert kept <= files(tmp_path / "results")
    few = stats.update(spark, spark.createDataFrame([(0, 1, 1, 999, 1, "doc3", 2, True)], HITS))
    assert len(few) == 1
    untouched = files(tmp_path / "members")
    assert stats.update(spark) == [] and files(tmp_path / "members") == untouched


def test_a_batch_leaves_the_stored_members_as_they_are(spark, tmp_path):
    stats = Statistics(str(tmp_path), buckets=2, files=12)
    hits = spark.createDataFrame([(0, 1, k % 9, k % 7, k % 4, f"doc{k % 5}", k % 3 - 1 or None, True) for k in range(60)], HITS)
    labels = spark.createDataFrame([(0, 1, k, f"doc{k % 5}") for k in range(9)], LABELS)
    stats.update(spark, hits, labels)
    first, want = files(tmp_path / "members"), rows_of(stats.results.read(spark))
    assert stats.update(spark, hits, labels) == sorted({bucket_of(f) for f in first})
    assert first < files(tmp_path / "members") and rows_of(stats.results.read(spark)) == want
    one = stats.members_of(hits, labels).count()
    for _ in range(12):  # a bucket of many files is rewritten with each member once
        stats.update(spark, hits, labels)
        assert all(stats.members.files(spark, n) <= 12 for n in (0, 1))
    assert rows_of(stats.results.read(spark)) == want and stats.members.read(spark).distinct().count() == one
    assert rows_of(stats.computed(stats.members_of(hits, labels))) == want


def test_touched_buckets_alone_are_scanned(spark, tmp_path):
    stats = Statistics(str(tmp_path), buckets=8)
    stats.update(spark, labels=spark.createDataFrame([(0, 1, k, f"doc{k}") for k in range(64)], LABELS))
    plan = stats.members.read(spark, [3])
    assert all("_bucket=3/" in f for f in plan.where(F.col("doc_id").isNotNull()).inputFiles()) or "PartitionFilters: [_bucket" in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == stats.members.read(spark).where(stats.members.bucket() == 3).count() and plan.columns == MEMBERS.names


@pytest.mark.parametrize("rows", [[], [(1, None, None)]])
def test_nothing_to_store(spark, tmp_path, rows):
    store = DigestStore(str(tmp_path), 4)
    df = spark.createDataFrame(rows, "id long, knowledge_base_id long, content_md5 string")
    assert store.add(df) == [] and [r["first"] for r in store.judge(df).collect()] == [r[0] for r in rows]
