"""Scopes, expansion, fusion, reranking, nearest vectors and golden criteria on small tables."""

import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from lorewell.operators import lexical, models, quality, retrieval, vectors
from lorewell.sources import golden
from lorewell.sources.parameters import Parameters

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the models below travel to the workers


@pytest.mark.parametrize("limit", [quality.MAX_ANCHORS, 0])
def test_containing_is_plain_search(spark, monkeypatch, limit):
    monkeypatch.setattr(quality, "MAX_ANCHORS", limit)
    rng = random.Random(5)
    words = ["ab", "a", "b", "abc", "x-y", "é", "中文", "one,two", "\n"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randrange(0, 14)))) for k in range(60)] + [(90, None), (91, ""), (92, "prefix start inside here endfix"), (93, "tiny")]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for k in range(40)]
    items += [(90, "art inside here end"), (91, "in"), (92, ""), (93, None), (94, " inside here "), (95, "nothing of the kind at all"), (96, "tiny")]
    got = {(r.case_id, r.doc_id) for r in quality.containing(spark.createDataFrame(docs, "doc_id long, content string"), spark.createDataFrame(items, "case_id long, item string")).collect()}
    assert got == {(i, d) for i, x in items for d, t in docs if x and t and x in t}


def test_containing_without_items(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, content string")
    assert quality.containing(docs, spark.createDataFrame([(1, "")], "case_id long, item string")).collect() == []


def test_scopes(spark):
    rows = spark.createDataFrame([(1, 1, "u", 5, 10), (2, 1, "u", 5, None), (3, 2, "u", 5, 10), (4, 1, "v", 6, 11)], "doc_id long, tenant_id long, user_id string, kb_id long, directory_id long")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(retrieval.scoped(rows)) == [1, 2, 3, 4] and ids(retrieval.scoped(rows, tenant=1)) == [1, 2, 4]
    assert ids(retrieval.scoped(rows, tenant=1, user="u", kb=5, directories=[10, 12])) == [1]
    assert ids(retrieval.scoped(rows, directories=spark.createDataFrame([(11,), (11,)], "id long"))) == [4]
    assert retrieval.backend(" ") == "redis" and retrieval.backend("Milvus") == "milvus"
    with pytest.raises(ValueError):
        retrieval.backend("other")


class Broken:
    def expand(self, query, n):
        raise RuntimeError("no model")

    def rerank(self, query, texts):
        raise RuntimeError("no model")


class Two:
    def expand(self, query, n):
        return ["  ", query.upper(), "second  one", "Second One", "third", "fourth"]


def test_expansion(spark):
    asked = spark.createDataFrame([(1, " how to ")], "query_id long, query string")
    show = lambda df: sorted((r.query_id, r.variant, r["query"]) for r in df.collect())
    assert show(retrieval.expand(asked, Broken())) == [(1, 0, "how to")]
    assert show(retrieval.expand(asked, Two(), 2)) == [(1, 0, "how to"), (1, 1, "second  one"), (1, 2, "third")]


def test_rerank_falls_back(spark):
    pool = spark.createDataFrame([(1, "a b", d, r, t) for d, r, t in ((7, 1, "x"), (8, 2, "b a"), (9, 3, "a"))], "query_id long, query string, doc_id long, rank long, text string")
    order = lambda df: [r.doc_id for r in sorted(df.collect(), key=lambda r: r["rank"])]
    assert order(retrieval.rerank(pool, models.OverlapReranker(), 2)) == [8, 9] and order(retrieval.rerank(pool, Broken(), 2)) == [7, 8]


def test_retrieve(spark):
    chunks = spark.createDataFrame([(k, "title", f"word{k} common text") for k in range(30)] + [(99, "word3 here", "plain")], "doc_id long, title string, content string")
    asked = spark.createDataFrame([(1, 0, "word3 common"), (2, 0, "nothing else")], "query_id long, variant int, query string")
    p = Parameters(top_k=3)
    got = [(r.query_id, r.doc_id) for r in sorted(retrieval.retrieve(chunks, asked, None, None, p).collect(), key=lambda r: r["rank"])]
    assert set(got[:2]) == {(1, 3), (1, 99)} and len(got) == 3  # the title counts
    rng = np.random.default_rng(1)
    vecs = [(k, rng.normal(size=4).tolist()) for k in range(30)]
    v = spark.createDataFrame(vecs, "doc_id long, vec array<double>")
    qv = spark.createDataFrame([(1, 0, vecs[3][1]), (2, 0, vecs[5][1])], "query_id long, variant int, qvec array<double>")
    rows = sorted(retrieval.retrieve(chunks, asked, v, qv, p, models.OverlapReranker()).collect(), key=lambda r: (r.query_id, r["rank"]))
    assert rows[0].doc_id == 3 and {r.query_id for r in rows} == {1, 2}
    first = [r.doc_id for r in sorted(vectors.nearest(v, qv.where("query_id = 2").select("query_id", "qvec"), 5).collect(), key=lambda r: r["rank"])]
    fused = [r.doc_id for r in sorted(retrieval.retrieve(chunks, asked, v, qv, Parameters(top_k=5)).where("query_id = 2").collect(), key=lambda r: r["rank"])]
    assert fused == first  # no lexical result leaves the dense list as it is


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_nearest(spark, monkeypatch, metric):
    monkeypatch.setattr(vectors, "BLOCK", 3)
    rng = np.random.default_rng(2)
    rows = [(k, rng.integers(-3, 4, 6).astype(float).tolist()) for k in range(80)] + [(200, None), (201, [1.0])]
    asked = [(k, rng.integers(-3, 4, 6).astype(float).tolist()) for k in range(10)] + [(11, None)]
    got = vectors.nearest(spark.createDataFrame(rows, "doc_id long, vec array<double>"), spark.createDataFrame(asked, "query_id long, qvec array<double>"), 7, metric).collect()

    def score(a, b):
        a, b = np.array(a), np.array(b)
        return float(a @ b) if metric == "ip" else -float(np.linalg.norm(a - b)) if metric == "l2" else float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))

    for q, x in asked[:10]:
        want = sorted(((-round(score(x, v), 6), d) for d, v in rows[:80]))[:7]
        assert [(-r.score + 0.0, r.doc_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(pytest.approx(s, abs=2e-6), d) for s, d in want]


def test_search_with_many_question_terms(spark, monkeypatch):
    rng = random.Random(3)
    chunks = spark.createDataFrame([(k, " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 30)))) for k in range(60)] + [(90, None), (91, "")], "doc_id long, content string")
    asked = spark.createDataFrame([(k, " ".join(rng.choices("abcdxyz", k=4))) for k in range(12)], "query_id long, query string")
    rows = lambda: sorted(map(tuple, lexical.search(chunks, asked, 5).collect()))
    small = rows()
    monkeypatch.setattr(lexical, "MAX_TERM_BYTES", 0)
    assert rows() == small and len(small) > 40


def test_search_without_match(spark):
    chunks = spark.createDataFrame([(1, None), (2, ""), (3, "word")], "doc_id long, content string")
    asked = spark.createDataFrame([(1, "other"), (2, ""), (3, "WORD word")], "query_id long, query string")
    assert [(r.query_id, r.doc_id, r["rank"]) for r in lexical.search(chunks, asked, 5).collect()] == [(3, 3, 1)]


def test_golden_lines(spark):
    lines = lambda *raw: spark.createDataFrame(list(enumerate(raw, 1)), "line long, raw string")
    rows = quality.golden_cases(lines("", " # note", '{"id":"a","query":"q","relevant_titles":["t"],"tenant_id":3}', '{"query":"r","relevant_doc_ids":["1","2"]}')).collect()
    assert [(r.id, r["query"], r.doc_ids, r.titles, r.tenant_id) for r in rows] == [("a", "q", [], ["t"], 3), ("case-4", "r", ["1", "2"], [], None)]
    for bad in ('{"query":" ","relevant_titles":["t"]}', '{"query":"q"}', "no json"):
        with pytest.raises(Exception):
            quality.golden_cases(lines(bad)).collect()


def test_golden_file(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('# note\n\n{"id":"a","query":"q","relevant_titles":["t"]}\r\n{"query":"r","relevant_contains":["x"]}\n')
    assert [(r.id, r["query"]) for r in golden.read_golden(spark, f"{tmp_path}/g.jsonl").collect()] == [("a", "q"), ("case-4", "r")]
    (tmp_path / "h.jsonl").write_text("# only a note\n")
    with pytest.raises(ValueError):
        golden.read_golden(spark, f"{tmp_path}/h.jsonl")


def test_agent_tools(spark):
    calls = spark.createDataFrame([(1, '{"query": " find it "}'), (2, '{"query": " "}'), (3, "no json")], "query_id long, arguments string")
    assert [(r.query_id, r["query"]) for r in retrieval.tool_questions(calls, 2).collect()] == [(1, "find it")]
    with pytest.raises(ValueError):
        retrieval.tool_questions(calls, 0)
    rounds = spark.createDataFrame([(1, 1, 1, "x"), (1, 1, 2, "y"), (1, 2, 1, "y"), (1, 2, 2, "z"), (2, 1, 1, "z")], "answer_id long, round long, rank long, chunk_id string")
    got = sorted(tuple(r) for r in retrieval.merge_rounds(rounds).collect())
    assert got == [(1, 1, "x", 1, 1), (1, 2, "y", 1, 2), (1, 3, "z", 2, 2), (2, 1, "z", 1, 1)]


def test_criteria(spark):
    ranked = spark.createDataFrame([(1, 1, 70, "a title", "text"), (1, 2, 7, "b", "text with item"), (2, 1, 5, None, None)], "case_id long, rank long, doc_id long, title string, content string")
    wanted = spark.createDataFrame([(1, "doc_id", "7"), (1, "title", " tit "), (1, "contains", "item"), (1, "contains", "item"), (1, "contains", " "), (2, "title", "x"), (3, "contains", "y")], "case_id long, kind string, criterion string")
    got = {r.case_id: (r.hit, r.first_rank, r.matched, r.expected, r.recall) for r in quality.case_scores(ranked, wanted).collect()}
    assert got == {1: (True, 1, 3, 5, 0.6), 2: (False, 0, 0, 1, 0.0), 3: (False, 0, 0, 1, 0.0)}
