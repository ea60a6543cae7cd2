"""The FM-index search against a plain scan."""

import hashlib
import re

import numpy as np
import pytest

from lorewell.llm import common, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=13):
    out = {}
    grams = [(i, tuple(w[k : k + window])) for i, t in items for w in [words(t)] for k in range(max(1, len(w) - window + 1) if w else 0)]
    for doc, text in docs:
        w = words(text)
        hit, found = [False] * len(w), set()
        for item, g in grams:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit[k : k + len(g)] = [True] * len(g)
                    found.add(item)
        n = sum(hit)
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[doc] = (len(w), n, len(found), sha, n > 0 and 20 * n >= len(w))
    return out


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen."), (20, "tiny item"), (3, None), (4, ""), (5, "tiny item"), (6, "solo"), (7, "a a a a a a a a a a a a a a a")]
DOCS = [
    (1, "zero one two three four five six seven eight nine ten eleven twelve THIRTEEN fourteen x"),
    (2, "a TINY, item here"), (3, None), (4, ""), (5, "... !!"), (6, "nothing to see " * 300 + "tiny item"), (7, "solo"), (8, "a " * 40),
    (9, "one two three"), (10, "tiny item"), (11, "tiny"), (12, "tiny item"), (13, "éa tiny-item tiny_item tinyitem"),
]


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(d, b, decontaminate.DecontaminateParams(**kw))
    rows = found.select("*", decontaminate.n_hit().alias("n"), decontaminate.contaminated(20).alias("c")).collect()
    return {r.doc_id: (r.n_words, r.n, len(r["items"]), hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest(), r.c) for r in rows}


@pytest.mark.parametrize("kw", [{}, {"max_block_words": 5}, {"shard_bytes": 40}])
def test_matches_plain_scan(spark, kw):
    assert run(spark, DOCS, ITEMS, **kw) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == {}
    assert run(spark, DOCS, []) == brute(DOCS, [])


def test_fixture_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got, want = run(spark, docs, items), brute(docs, items)
    assert got == want and any(x[4] for x in want.values())


def test_extra_clashing_columns(spark):
    d = spark.createDataFrame([(1, "tiny item", 7, "x"), (2, "clean text", 8, None)], "doc_id long, text string, n_words int, spans string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.remove_contaminated(d, b)
    assert kept.columns == d.columns and kept.collect() == [(2, "clean text", 8, None)]


def test_random_symbols():
    rng = np.random.default_rng(5)
    for _ in range(30):
        text = rng.integers(0, 4, rng.integers(1, 80))
        index = decontaminate.FmIndex(text, 3, 4)
        phrase = rng.integers(1, 4, (20, 3))
        lengths = rng.integers(1, 4, 20)
        which, lo, hi = index.search(np.where(np.arange(3) < lengths[:, None], phrase, 0), lengths)
        got = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(which, lo, hi)}
        for k in range(20):
            want = [i for i in range(len(text) - lengths[k] + 1) if (text[i : i + lengths[k]] == phrase[k, : lengths[k]]).all()]
            assert got.get(k, []) == want


def test_words_over_chunks(monkeypatch):
    raw = ("ab, cd" * 50 + "x" * 300 + " éé yz").encode()
    data, offsets = np.frombuffer(raw * 2, np.uint8), np.array([0, len(raw), 2 * len(raw)])
    whole = common.words(data, offsets)
    monkeypatch.setattr(common, "STEP_BYTES", 64)
    monkeypatch.setattr(common, "_powers", {})
    for a, b in zip(whole, common.words(data, offsets)):
        assert (a == b).all()
