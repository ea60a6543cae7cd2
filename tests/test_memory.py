"""Packing a session's context, and cutting text at separators."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from lorewell.operators import chunking, memory

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Joining:
    def summarize(self, summary, turns):
        return "+".join([summary, *(c for _, c in turns)])


class Broken:
    def summarize(self, summary, turns):
        raise RuntimeError("no model")


def packed(spark, turns, summaries, **kw):
    m = spark.createDataFrame([(k, s, "user", c) for k, (s, c) in enumerate(turns)], "id long, session_id string, role string, content string")
    s = spark.createDataFrame(summaries, "session_id string, summary string")
    rows, heads = memory.pack_context(m, s, **kw)
    return {r.session_id: (r.summary, [x.content for x in sorted(rows.where(F.col("session_id") == r.session_id).collect(), key=lambda x: x.id)]) for r in heads.collect()}


def test_pack_context(spark):
    turns = [("a", f"t{k}") for k in range(9)] + [("b", "x")] + [("c", f"u{k}") for k in range(4)]
    kw = {"keep": 2, "trigger": 4, "budget": 0}
    assert packed(spark, turns, [("a", "old")], **kw) == {"a": ("old", [f"t{k}" for k in range(3, 9)]), "b": ("", ["x"]), "c": ("", ["u0", "u1", "u2", "u3"])}
    got = packed(spark, turns, [("a", "old")], summarizer=Joining(), **kw)
    assert got == {"a": ("old+t3+t4+t5+t6", ["t7", "t8"]), "b": ("", ["x"]), "c": ("+u0+u1", ["u2", "u3"])}
    assert packed(spark, turns, [("a", "old")], summarizer=Broken(), **kw)["a"] == ("old", ["t7", "t8"])
    assert packed(spark, turns, [], keep=2, trigger=99, budget=15)["a"] == ("", ["t6", "t7", "t8"])
    long = packed(spark, turns, [("a", "s" * 400)], keep=2, trigger=99, budget=30)["a"]
    assert long[1] == [] and long[0].endswith("…") and 40 < len(long[0]) < 100
    assert packed(spark, turns, [("a", "s" * 400)], keep=2, trigger=99, budget=5)["a"] == ("", [])


def test_summaries(spark):
    rows = spark.createDataFrame([('{"content": "x"}',), (" plain ",), (None,)], "raw string").select(memory.load_summary(F.col("raw")).alias("s")).collect()
    assert [r.s for r in rows] == ["x", "plain", ""]
    table = lambda *x: spark.createDataFrame(list(x), "session_id string, summary string")
    got = memory.save_summaries(table(("a", "1"), ("b", "2")), table(("b", "3"), ("c", "4"))).collect()
    assert sorted(tuple(r) for r in got) == [("a", "1"), ("b", "3"), ("c", "4")]


def test_recursive_pieces(spark):
    cut = chunking.recursive_pieces
    assert cut("one\ntwo\nthree", 8, 0) == ["one\ntwo", "three"] and cut("one\ntwo\nthree", 8, 3) == ["one\ntwo", "three"]
    assert cut("aa\nbb\ncc\ndd", 5, 2) == ["aa\nbb", "bb\ncc", "cc\ndd"]
    assert cut("a b. c d. e f", 6, 0) == ["a b", "c d", "e f"] and cut("x" * 20, 5, 0) == ["x" * 20] and cut("\n\n", 5, 0) == []
    text = "\n".join(f"line {k}. with? some! more" for k in range(300))
    docs = spark.createDataFrame([(1, "text", text), (2, "pdf", "## 第 3 页\n" + "word. " * 300), (3, "text", ""), (4, "text", "short")], "doc_id long, format string, text string")
    rows = chunking.chunk(docs, 200, 40, recursive=True).collect()
    by = {d: sorted((r for r in rows if r.doc_id == d), key=lambda r: r.chunk_index) for d in (1, 2, 3, 4)}
    assert [r.content for r in by[1]] == cut(text, 200, 40) and all(len(r.content) <= 200 for r in by[1])
    assert {line for r in by[1] for line in r.content.split("\n")} == set(text.split("\n"))
    assert all(r.page == 3 and r.content.startswith("## 第 3 页\n\n") for r in by[2]) and len(by[2]) > 5 and not by[3] and by[4][0].content == "short"
    assert [r.chunk_index for r in by[1]] == list(range(len(by[1]))) and by[1][0].chunk_id == "1-0"
