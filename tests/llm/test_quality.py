"""Base statistics against a plain count; the learner on made rules."""

import re

import numpy as np

from lorewell.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    hit = [False] * len(w)
    for i, g in enumerate(grams):
        if seen[g] > 1:
            hit[i : i + 5] = [True] * 5
    n = sum(hit)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), n, len(w) < 10 or 100 * n > 20 * len(w)


TEXTS = [None, "", " \n\t ", "one", "a b c d e " * 3, "x y\nx y\n\n\nx y \n x y", "# * $ % & | < > # é😀 😀", "a " * 3000, "w\r\nw\r\nw", "p q r s t u v w p q r s t", "\x85 \xa0 　 x", "b" * 100_000]


def test_statistics(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    rows = quality.judge(docs, [], "doc_id").collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert all(r.kept != r.base_failed for r in rows)


def test_fixture_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = quality.op8_quality(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(docs[r.doc_id])
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(good) > 0.97 * len(good)
    poor = [r.kept for r in rows if labels.get(r.doc_id) == 0 and not r.base_failed]
    assert len(poor) > 10 and sum(poor) < 0.2 * len(poor)  # the learnt list drops what the base rule lets pass


def test_learns_conjunctions():
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(quality.FEATURES)))
    bad = (x[:, 2] > 0.8) & (x[:, 5] > 0.5) | (x[:, 1] < 0.1)
    rules = quality.learn(x, bad)
    found = np.zeros(len(x), bool)
    for rule in rules:
        found |= quality.covers(rule, x)
    assert (found == bad).mean() > 0.97


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, labels) == [] and quality.judge(docs, [], "doc_id").first().kept
    assert quality.judge(docs.limit(0), [], "doc_id").collect() == []
