"""Toxicity and language on held-out rows, and their edge cases."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lorewell.llm import common, language, toxicity

DATA = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    rows = toxicity.op2_toxicity(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    assert rows.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    found = {(r.predicted, r.toxic): r["count"] for r in rows.where("held_out").join(labels, "doc_id").groupBy("predicted", "toxic").count().collect()}
    assert found[(1, 1)] > 0.7 * (found[(1, 1)] + found[(0, 1)]) and found.get((1, 0), 0) < 0.02 * found[(0, 0)]


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "bad bad word", 1.0), (2, "good text here", 2.0), (3, None, None), (4, "", 0.0), (None, "bad", 0.0), (1, "bad bad word", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (99, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == 6 and all(0 <= r.score <= 1 for r in scored)
    kept = toxicity.remove_toxic(docs, toxicity.ToxicityModel(np.zeros(0, np.int32), np.zeros(0, np.float32), -5.0, 20))
    assert kept.columns == docs.columns and kept.count() == 6
    empty = toxicity.fit(docs, labels.limit(0))
    assert all(r.score < 1e-10 for r in toxicity.score(docs, empty).collect())
    assert toxicity.score(docs.limit(0), empty).collect() == []


def test_ftrl_is_sparse_and_right():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        label = int(rng.random() < 0.3)
        rows.append((label, np.unique(np.concatenate([rng.integers(100, 1 << 20, 40), [7] if label else []]).astype(np.int64))))
    model = toxicity.Ftrl(toxicity.ToxicityParams())
    for _ in range(3):
        for label, idx in rows:
            model.learn(label, idx)
        model = toxicity.Ftrl(model.p, model.state())  # as from one epoch to the next
    w, b = model.weights(), model.intercept()
    assert w[7] > 2 and b < 0 and (w != 0).sum() < 200


def plain_features(text, bits):
    """Words, neighbours and pairs over one word as places, one word at a time."""
    h = [int(x) for x in common.words(*common.text_arrays(pa.array([text])))[0]]
    mixed = lambda x: int(common.mix(np.array([x % 2**64], np.uint64))[0])
    pairs = [mixed(a * seed + b) for gap, seed in ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB)) for a, b in zip(h, h[gap:])]
    return {x >> (64 - bits) for x in h + pairs}


def test_scores_are_those_of_a_plain_loop(spark):
    """Strings as ids, one text of 60,000 words; all its features count."""
    rng = random.Random(5)
    p = toxicity.ToxicityParams(l1=0.5)
    words = [f"w{k}" for k in range(40)]
    docs = [(f"d{k}", " ".join(rng.choices(words, k=rng.randrange(0, 25))) + (" bad" if k % 3 == 0 else "")) for k in range(60)] + [("long", " ".join(f"x{rng.randrange(30_000)}" for _ in range(60_000)))]
    labels = [(i, int(t.endswith("bad"))) for i, t in docs]
    d = spark.createDataFrame(docs, "doc_id string, text string")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id string, toxic int"), p)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    order = [r.k for r in spark.createDataFrame(labels, "k string, toxic int").orderBy(F.xxhash64("k"), "k").collect()]
    texts, known, z, n = dict(docs), dict(labels), {}, {}
    features = {i: plain_features(t, p.bits) | {"one"} for i, t in docs}

    def weight(f):
        a, b = z.get(f, 0.0), n.get(f, 0.0)
        if f == "one":
            return -a / ((p.beta + b**0.5) / p.alpha)
        return 0.0 if abs(a) <= p.l1 else (math.copysign(p.l1, a) - a) / ((p.beta + b**0.5) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for i in order:
            now = {f: weight(f) for f in features[i]}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(now.values()))))) - known[i]
            for f, w in now.items():
                z[f] = z.get(f, 0.0) + g - ((n.get(f, 0.0) + g * g) ** 0.5 - n.get(f, 0.0) ** 0.5) / p.alpha * w
                n[f] = n.get(f, 0.0) + g * g
    assert len(features["long"]) > 100_000 and texts
    for i, score in got.items():
        assert abs(score - 1 / (1 + math.exp(-sum(weight(f) for f in features[i])))) < 1e-5


def test_language_held_out(spark):
    rows = language.op5_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def brute_profile(texts, size):
    counts = {}
    for t in texts:
        s = " " + "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else " " for c in t) + " "
        s = " ".join(s.split())
        s = f" {s} " if s else ""
        for n in (1, 2, 3):
            for i in range(len(s) - n + 1):
                g = s[i : i + n]
                if " " in g[1:-1] or g.strip() == "" or (n == 1 and g == " "):
                    continue
                counts[g] = counts.get(g, 0) + 1
    code = lambda g: sum((1 if c == " " else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [code(g) for g in sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]]


def test_profiles_against_plain_counts(spark):
    texts = ["Ça va, été à la plage!", "the cat; the dog 12 the end", "ßtraße über"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(9, None, "x"), (10, "no lang", None)], "doc_id long, text string, lang string")
    rows = language.profiles(docs, language.LanguageParams(profile_size=40)).orderBy("rank").collect()
    assert [r.gram for r in rows] == brute_profile(texts, 40) and {r.lang for r in rows} == {"x"}


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "the cat sat", "en"), (2, "le chat noir", "fr"), (3, None, None), (4, "", "en"), (5, "123 !!", "en"), (6, "the cat", None), (6, "the cat", None)], "doc_id long, text string, lang string")
    ranks = language.profiles(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, ranks).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] == "en" and all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in language.predict(docs, ranks.limit(0)).collect()} == {"und"}
    assert language.predict(docs.limit(0), ranks).collect() == []
