"""What a step sends on must not grow with all pairs of questions and documents."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lorewell.functions.text import tokenize
from lorewell.operators import fusion, lexical, postings, retrieval, scoring
from lorewell.plans import registry


@pytest.fixture(scope="module")
def talk(spark):
    """Documents that all share a word, some ids twice."""
    rng = random.Random(8)
    rows = [(k, " ".join(["the"] * rng.randrange(1, 5) + rng.choices("abcdefgh", k=rng.randrange(1, 40)))) for k in range(3000)]
    return spark.createDataFrame(rows + rows[:3] + [(0, "the other length")], "doc_id long, content string").repartition(4)


def asked_of(spark, n=6):
    return spark.createDataFrame([(q, f"the {'abcdefgh'[q % 8]} {'abcdefgh'[(q + 3) % 8]}") for q in range(n)], "query_id long, query string")


def test_scan_sends_on_the_best_only(spark, talk):
    terms = asked_of(spark).select("query_id", F.explode(tokenize(F.col("query"))).alias("term"))
    sent = lexical._by_broadcast(talk, terms, 3, 1.2, 0.75).groupBy("query_id").count().collect()
    assert len(sent) == 6 and max(r["count"] for r in sent) < 600  # every document has a word of every question


@pytest.mark.parametrize("pairs, rows", [(scoring.PAIRS, scoring.ROWS), (5, 64)])
def test_scan_is_the_search_by_shuffle(spark, talk, monkeypatch, pairs, rows):
    monkeypatch.setattr(scoring, "PAIRS", pairs)
    monkeypatch.setattr(scoring, "ROWS", rows)
    found = lambda: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in lexical.search(talk, asked_of(spark), 4).collect())
    near = found()
    monkeypatch.setattr(lexical, "MAX_TERM_BYTES", -1)
    assert len(near) == 24 and found() == near


def test_stored_search_sends_on_the_best_only(spark, talk, tmp_path, monkeypatch):
    index = postings.build(talk, str(tmp_path), postings.PostingsParams(block_docs=64))
    sent, plain = [], postings._scored

    def spied(blocks, buckets, terms):
        out = plain(blocks, buckets, terms)
        sent.append(out.count())
        return out

    monkeypatch.setattr(postings, "_scored", spied)
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in df.collect())
    assert rows(postings.search(index, asked_of(spark), 3)) == rows(lexical.search(talk, asked_of(spark), 3))
    assert sum(sent) < 6 * 3000 / 2  # every document has a word of every question
    monkeypatch.setattr(scoring, "MAX_TERM_BYTES", -1)
    assert rows(postings.search(index, asked_of(spark), 3)) == rows(lexical.search(talk, asked_of(spark), 3))


def test_results_go_to_the_texts(spark, talk):
    found = spark.createDataFrame([(1, 5, 1), (1, 9, 2)], "query_id long, doc_id long, rank long")
    plan = retrieval.with_texts(found, talk)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(doc_id" not in plan
    assert {(r["rank"], r.doc_id) for r in retrieval.with_texts(found, talk).collect()} == {(1, 5), (2, 9)}


def test_each_list_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    ranks = lambda n: spark.range(n).select(F.lit(1).cast("long").alias("query_id"), F.col("id").alias("doc_id"), F.lit(0.5).alias("score"), (F.col("id") + 1).alias("rank"))
    dense, sparse = (ranks(n).mapInArrow(seen, "query_id long, doc_id long, score double, rank long") for n in (20, 30))
    assert fusion.hybrid(dense, sparse, 60, 5).count() == 5 and made.value == 50


def test_file_names_are_no_status(spark, tmp_path):
    events = spark.createDataFrame([(k, kind) for k in (429, 1502, 2504, 7) for kind in ("signup", "view", "error", "click", "purchase")], "event_id long, event_type string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    sql = registry.ORACLE_SQL["errors_of_events"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, registry.QUERIES["errors_of_events"](spark, str(tmp_path)).collect())) == sorted(duckdb.sql(sql).fetchall())
