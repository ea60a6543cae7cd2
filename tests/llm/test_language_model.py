"""Base scores against a plain count, scores against brute-force interpolation, and what the filter must satisfy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.llm import common
from lorewell.llm import language_model as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SHARDED = {"broadcast_bytes": 0}


def tokens_of(t):
    return [*WORD.findall((t or "").translate(LOWER)), None]


def learnt(i):
    return i is None or zlib.crc32(str(i).encode()) % 10


def brute(docs):
    tokens = [(i, tokens_of(t)) for i, t in docs]
    train = Counter(w for i, ws in tokens if learnt(i) for w in ws)
    n, v = sum(train.values()), len(train)
    return sorted((i if i is not None else -1, len(ws), sum(train[w] > 0 for w in ws), n, round(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in tokens)


def brute_scores(docs, backoff=5.0):
    """The interpolated score with exact levels: what the filter gives unless it answers falsely."""
    value = lambda c: c if c < 2 else 2.0 ** (c.bit_length() - 1) * 1.5**0.5
    grams = [Counter(), Counter(), Counter()]
    for i, t in docs:
        if learnt(i):
            ws = tokens_of(t)
            for k, w in enumerate(ws):
                a, b = (ws[k - 1] if k else None), (ws[k - 2] if k > 1 else None)
                for counter, gram in zip(grams, (w, (a, w), (b, a, w))):
                    counter[gram] += 1
    one, two, three = grams
    n, v = sum(one.values()), len(one)
    out = {}
    for i, t in docs:
        ws, total = tokens_of(t), 0.0
        for k, w in enumerate(ws):
            a, b = (ws[k - 1] if k else None), (ws[k - 2] if k > 1 else None)
            p = (one[w] + 0.1) / (n + 0.1 * (v + 1))
            context = float(one[a])
            p = (min(value(two[a, w]), context) + backoff * p) / (context + backoff)
            context = value(two[b, a]) if k else float(one[None])
            p = (min(value(three[b, a, w]), context) + backoff * p) / (context + backoff)
            total += math.log10(p)
        out[i] = total
    return out


def scored(spark, docs, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, score string" if docs and len(docs[0]) == 3 else "doc_id long, text string")
    return lm.model_scores(d, common.fold("doc_id", 10) != 0, lm.LanguageModelParams(**kw), segments=16).collect()


DOCS = [(1, "the cat sat on the mat"), (2, "The dog sat"), (3, None), (4, ""), (5, "  \t\n "), (6, "the cat sat on the mat"), (6, "the cat sat on the mat"), (None, "un été à la mer"), (9, "x" * 5000), (40, "so " * 3000)]


@pytest.mark.parametrize("kw", [{}, SHARDED, {"block_bytes": 10}, {"max_filter_bits": 64, **SHARDED}])
def test_base_scores(spark, kw):
    rows = scored(spark, [(i, t, "clash") for i, t in DOCS], **kw)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == brute(DOCS)


@pytest.mark.parametrize("kw", [{}, SHARDED])
def test_empty_and_untrained(spark, kw):
    assert scored(spark, [], **kw) == []
    held = [k for k in range(99) if not learnt(k)][:3]
    rows = scored(spark, [(k, "some words here") for k in held], **kw)
    assert [(r.n_known, r.train_tokens) for r in rows] == [(0, 0)] * 3 and all(math.isfinite(r.score) for r in rows)


def test_fixture_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.op9_lm_score(spark, "/root/testdata/sf0.001").collect()]
    want = brute(docs)
    assert [x[:4] for x in sorted(got)] == [x[:4] for x in want]
    assert all(abs(a[4] - b[4]) < 1e-6 * max(1, abs(b[4])) for a, b in zip(sorted(got), want))
    scores = brute_scores(docs)  # the filter errs upward only, and seldom
    near = [abs(x[5] - scores[x[0]]) < 0.01 * abs(scores[x[0]]) for x in got]
    assert sum(near) >= 0.95 * len(near)
    total = lambda k: sum(x[k] for x in got)
    assert total(5) > 0.9 * total(4)  # per token well above the base


@pytest.mark.parametrize("kw", [{}, SHARDED, {"max_filter_bits": 64, **SHARDED}, {"block_bytes": 600}])
def test_scores_against_brute_force(spark, kw):
    docs = [(k, f"w{k % 40} w{(k * 7) % 40} w{k % 3} seen{k % 5} Only{k}") for k in range(400)]
    want = brute_scores(docs)
    got = {r.doc_id: r.score for r in scored(spark, docs, bits_per_entry=24, **kw)}
    assert sum(abs(got[k] - want[k]) < 1e-6 for k in want) >= 0.97 * len(want)


def test_broadcast_and_shuffle_ask_the_same_bits(spark):
    docs = [(k, f"w{k % 40} w{(k * 7) % 40} w{k % 3} seen{k % 5}") for k in range(400)]
    one, two = ({r.doc_id: r.score for r in scored(spark, docs, bits_per_entry=2, **kw)} for kw in ({}, SHARDED))
    assert all(abs(one[k] - two[k]) < 1e-9 for k in one)  # false answers included


def test_filter_never_forgets():
    rng = np.random.default_rng(1)
    gram = np.unique(rng.integers(0, 2**40, 2000).astype(np.uint64))
    count = rng.integers(1, 40, len(gram))
    p = lm.LanguageModelParams()
    bits = lm.filled(gram, lm.levels(count), p)
    got = lm.level_of(bits, gram, p.probes)
    assert (got >= lm.levels(count)).all() and (got == lm.levels(count)).mean() > 0.98
    other = rng.integers(0, 2**40, 2000).astype(np.uint64)
    assert (lm.level_of(bits, other, p.probes) > 0).mean() < 0.05


def test_packed_values_return():
    values = np.sort(np.random.default_rng(2).integers(0, 2**40, 5000).astype(np.uint64))
    for x in (values, values[:1], values[:0]):
        assert (lm._expand(lm._squeeze(x)) == x).all()


def test_texts_seen_once_score_higher(spark):
    rng = np.random.default_rng(3)
    words = [f"v{k}" for k in range(200)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(300)]
    held = [k for k in range(10_000) if not learnt(k)]
    docs = [(k, t) for k, t in zip([k for k in range(10_000) if learnt(k)], texts)]
    docs += [(held[k], texts[k]) for k in range(20)] + [(held[20 + k], " ".join(rng.choice(words, 30))) for k in range(20)]
    got = {r.doc_id: r.score for r in scored(spark, docs)}
    assert min(got[held[k]] for k in range(20)) > max(got[held[20 + k]] for k in range(20))


def test_all_rows_may_teach(spark):
    d = spark.createDataFrame([(k, "alpha beta") for k in range(5)], "doc_id long, text string")
    assert len({round(r.score, 9) for r in lm.model_scores(d, F.lit(True)).collect()}) == 1
