"""Classes and links against all pairs, on small tables."""

import random
import re

import pytest

from lorewell.llm import jaccard

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sets(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs, t=0.8):
    s = [sets(x) for _, x in docs]
    n, root, links = len(docs), list(range(len(docs))), [0] * len(docs)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if s[a] and s[b] and len(s[a] & s[b]) >= t * len(s[a] | s[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    classes = {}
    for k in range(n):
        classes.setdefault(find(k), []).append(docs[k][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in classes.items()}
    order = lambda x: (-1 if x[0] is None else x[0], x[1] or -1, x[2])
    return sorted(((docs[k][0], least[find(k)], links[k]) for k in range(n)), key=order)


def run(spark, docs, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = jaccard.classify(d, jaccard.JaccardParams(**kw)).collect()
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in rows), key=lambda x: (-1 if x[0] is None else x[0], x[1] or -1, x[2]))


def made():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    docs, k = [], 0
    for group in range(12):
        base = [word() for _ in range(rng.choice([4, 6, 30, 80]))]
        for _ in range(rng.choice([1, 2, 9])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = word()
            docs.append((k, " ".join(own)))
            k += 1
    return [*docs, (k, None), (k + 1, ""), (k + 2, "?!"), (k + 3, "one two"), (k + 4, "One, two."), (k + 4, "one two"), (None, "one two"), (None, "alone here"), (k + 5, "spam " * 3000), (k + 6, "spam " * 2000)]


@pytest.mark.parametrize("kw", [{}, {"block": 2}, {"broadcast_rows": 0, "stripe": 7}])
def test_all_pairs(spark, kw):
    docs = made()
    assert run(spark, docs, **kw) == brute(docs)


def test_empty(spark):
    assert run(spark, []) == []


def test_one_of_each_class_stays(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(3, base, 1, "x"), (2, base + " end", 2, None), (2, base + " end", 2, None), (9, "other text entirely but short", 3, "y"), (4, None, 4, "z"), (5, "", 5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, first string")
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 9]


def test_fixture_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.op3_jaccard(spark, "/root/testdata/sf0.001").collect())
    assert got == brute(docs)


def test_bands_meet_the_recall():
    p = jaccard.JaccardParams()
    bands, rows = jaccard.bands_and_rows(p)
    assert 1 - (1 - p.threshold**rows) ** bands >= p.recall and bands * rows <= p.max_hashes
