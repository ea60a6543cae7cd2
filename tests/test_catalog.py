"""Directory trees deeper than the registered tables have, and cycles."""

import datetime

import pytest

from lorewell.operators import catalog

SCHEMA = "id long, parent_id long"


def test_deep_tree_is_whole(spark):
    tree = spark.createDataFrame([(k, k - 1 if k else None) for k in range(1000)], SCHEMA)
    got = catalog.descendants(tree, tree.where("id = 0"))
    assert got.agg({"id": "max", "depth": "max", "root": "count"}).first().asDict() == {"max(id)": 999, "max(depth)": 999, "count(root)": 1000}


def test_roots_below_roots(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2), (5, 4), (9, None)], SCHEMA)
    got = sorted(tuple(r) for r in catalog.descendants(tree, tree.where("id IN (1, 4, 9)")).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 2), (1, 5, 3), (4, 4, 0), (4, 5, 1), (9, 9, 0)]


def test_cycles(spark):
    tree = spark.createDataFrame([(1, None), (2, 4), (3, 2), (4, 3), (5, 1)], SCHEMA)
    with pytest.raises(ValueError):
        catalog.descendants(tree, tree.where("id = 2"))
    assert sorted(r.id for r in catalog.descendants(tree, tree.where("id = 1")).collect()) == [1, 5]


def test_no_directories(spark):
    tree = spark.createDataFrame([], SCHEMA)
    assert catalog.descendants(tree, tree).collect() == []


def test_null_keys_are_keys(spark):
    have = spark.createDataFrame([(1, None, "a")], "k int, m int, v string")
    want = spark.createDataFrame([(1, None, "b"), (None, 2, "c"), (None, 2, "c")], "k int, m int, v string")
    assert sorted((r.k or 0, r.m or 0, r.v, r.created) for r in catalog.get_or_create(have, want, "k", "m").collect()) == [(0, 2, "c", True), (1, 0, "a", False)]


def test_build_log(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    schema = "id long, document_id long, status string, triggered_at timestamp, finished_at timestamp, error string"
    builds = [(1, 1, "ready", at(0), at(1), None), (2, 1, "indexing", at(2), None, None), (3, 2, "failed", at(3), at(4), "x"), (4, 3, "pending", at(5), None, None), (5, 9, "pending", at(6), None, None)]
    events = [
        (1, 1, "note", None, at(10), "slow"), (1, 2, "finish", "failed", at(11), None), (1, 3, "note", None, at(12), "lost"), (1, 4, "begin", None, at(13), None), (1, 5, "finish", "ready", at(14), None),
        (2, 1, "finish", "ready", at(15), None), (2, 2, "ensure", None, at(16), None), (2, 3, "ensure", None, at(17), None), (3, 1, "ensure", None, at(18), None), (3, 2, "begin", None, at(19), None),
    ]
    got = catalog.log_builds(spark.createDataFrame(builds, schema), spark.createDataFrame(events, "document_id long, seq long, kind string, status string, at timestamp, error string"))
    rows = sorted((r.id, r.document_id, r.status, r.triggered_at.minute, r.finished_at and r.finished_at.minute, r.error) for r in got.collect())
    assert rows == [(1, 1, "ready", 0, 1, None), (2, 1, "failed", 2, 11, "slow"), (3, 2, "failed", 3, 4, "x"), (4, 3, "indexing", 5, None, None), (5, 9, "pending", 6, None, None), (6, 1, "ready", 13, 14, None), (7, 2, "pending", 16, None, None)]


def test_build_history_limits(spark):
    builds = spark.createDataFrame([(k, 1, datetime.datetime(2024, 1, 1)) for k in range(250)], "id long, document_id long, triggered_at timestamp")
    assert [catalog.build_history(builds, n).count() for n in (0, 3, 200, 201)] == [100, 3, 200, 100]


def test_lists_of_ids_and_aligned_values(spark):
    from pyspark.sql import functions as F

    from lorewell.functions import text

    df = spark.createDataFrame([([" 7", "007", "x", None, "0", "12"], ["a "], 2), ([], [], 0)], "ids array<string>, v array<string>, n int")
    rows = df.select(text.canonical_ids(F.col("ids"), 2).alias("ids"), text.aligned(F.col("v"), F.col("n")).alias("a"), text.aligned(F.col("v"), F.col("n"), True).alias("b")).collect()
    assert [(r.ids, r.a, r.b) for r in rows] == [(["7", "12"], ["a", ""], ["a", "a"]), ([], [], [])]
    for bad in (text.canonical_ids(F.col("ids"), 1), text.aligned(F.array(F.lit("é" * 10)), F.lit(1), size=19)):
        with pytest.raises(Exception):
            df.select(bad).collect()


def test_a_request_of_too_many_links(spark):
    from lorewell.operators import imports

    links = spark.createDataFrame([(1, k, "t", f"https://h.example/{k}.md") for k in range(3)] + [(2, 1, "t", "https://h.example/a.md")], "request_id long, n long, title string, url string")
    assert sorted((r.request_id, r.reason) for r in imports.validated_links(links, 2).collect()) == [(1, "too many links")] * 3 + [(2, "ok")]
