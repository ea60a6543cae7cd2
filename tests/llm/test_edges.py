"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns in every operator and stage."""

import math
import random
import unicodedata
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lorewell.llm import decontaminate, jaccard, language, language_model, licenses, mixing, pii, quality, substrings, toxicity

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, key string, _key string, epoch int, first boolean, spans string"
LONG = " ".join(f"word{k % 977} Mail{k} m{k}@host.example" for k in range(40_000))
ROWS = [
    (1, "plain text of a few words that nobody repeats anywhere else", "en", "web", 59, "s", "k", "x", 1, True, "z"),
    (2, None, None, None, None, None, None, None, None, None, None), (3, "", "en", "", 0, "", "", "", 0, False, ""), (4, " \n\t ", "de", "books", 4, None, "k", None, None, None, None),
    (None, "a row without an id", "fr", "web", 19, "s", None, "x", 2, True, None), (None, None, None, None, None, None, None, None, None, None, None),
    (7, "the same row twice, all of it the same", "en", "web", 38, "s", "k", "x", 1, True, "z"), (7, "the same row twice, all of it the same", "en", "web", 38, "s", "k", "x", 1, True, "z"),
    (8, "ünïcödé ☃ 中文 text", "en", "web", 18, None, None, None, None, None, None), (9, LONG, "en", "web", len(LONG), "s", "k", "x", 1, True, "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids(rows):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, odd, SMALL)
    rows = got.collect()
    assert got.columns[: len(odd.columns)] == odd.columns and (name == "mixing" or got.columns == odd.columns)
    if name == "near_duplicates":
        assert ids(rows) == [x for x in ids(odd.collect()) if x != (False, 7)][:1] + ids(rows)[1:] and [r.doc_id for r in rows].count(7) == 1 and len(rows) == len(ROWS) - 1
    elif name == "mixing":
        assert {r.doc_id for r in rows} <= {x[0] for x in ROWS} and len(rows) > 0
    else:
        assert ids(rows) == ids(odd.collect())  # clean rows stay, repeated ones too
    if name == "pii":
        long = next(r for r in rows if r.doc_id == 9)
        assert "@" not in long.text and long.n_chars == len(long.text) and next(r for r in rows if r.doc_id == 2).n_chars is None
    assert stage(spark, odd.limit(0), SMALL).collect() == []


def test_scores_and_judgements(spark, odd):
    labels = spark.createDataFrame([(1, 0), (7, 1), (7, 0), (None, 1), (99, 1), (8, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert ids(rows) == ids(odd.collect()) and all(0 <= r.score <= 1 for r in rows)
    known = odd.select("doc_id", "text")
    benchmark = spark.createDataFrame([(1, "twice, all of it"), (2, None), (None, "without an id"), (3, "")], "item_id long, text string")
    hits = decontaminate.find_contamination(odd, benchmark).select("doc_id", "n_words", decontaminate.n_hit().alias("n"), F.size("items").alias("m")).collect()
    assert sorted((r.doc_id or 0, r.n, r.m) for r in hits if r.n) == [(0, 3, 0), (7, 4, 1), (7, 4, 1)]
    judged = quality.judge(odd, quality.fit(odd, labels.withColumnRenamed("toxic", "quality")), "doc_id").collect()
    assert ids(judged) == ids(odd.collect()) and all(r.base_failed for r in judged if r.n_words < 10)
    found = pii.find_pii(odd).select("doc_id", F.size("_email").alias("n")).collect()
    assert sorted(r.n for r in found)[-1] == 40_000 and ids(found) == ids(odd.collect())
    scored = language_model.model_scores(known, F.lit(True)).collect()
    assert ids(scored) == ids(odd.collect()) and all(math.isfinite(r.score) and r.n_tokens >= 1 for r in scored)
    assert licenses.scan(odd).collect() == []


def test_pairs_and_passages(spark, odd):
    classes = jaccard.classify(odd.select("doc_id", "text")).collect()
    assert sorted(r.n_links for r in classes) == [0] * (len(ROWS) - 2) + [1, 1]
    assert all(r.doc_id != 9 or r.end_word <= 160_000 for r in substrings.find_repeats(odd).collect())
    assert substrings.find_repeats(odd.limit(0)).collect() == []


def test_mixing_reaches_its_target(spark):
    sizes = {"a": 900, "b": 90, "c": 9}
    rows = [(k, " ".join(["w"] * 9), s) for s, n in sizes.items() for k in range(n)]
    p = mixing.MixingParams(entropy=0.9, max_repeats=100.0, block_tokens=50)
    got = {r.source: r.n for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), p).groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    total = sum(got.values())
    reached = -sum(n / total * math.log(n / total) for n in got.values()) / math.log(3)
    grid = min((abs(-sum(w * math.log(w) for w in ws) / math.log(3) - 0.9), a) for a in (k / 1000 for k in range(1001)) for t in [[n**a for n in sizes.values()]] for ws in [[x / sum(t) for x in t]])[1]
    best = [n**grid for n in sizes.values()]
    assert abs(total - 9990) < 200 and abs(reached - 0.9) < 0.02
    assert all(abs(got[s] / total - x / sum(best)) < 0.02 for s, x in zip(sizes, best))


def grams(text):
    """Codes of the 1- to 3-grams of a text's letters, words set apart by single spaces."""
    if not any(c.isalpha() for c in text or ""):
        return []
    own = "".join(c.lower() if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in text)
    own = " " + " ".join(own.split()) + " "
    code = lambda g: int("".join(f"{1 if c == ' ' else ord(c):021b}" for c in g), 2)
    return [code(own[k : k + n]) for n in (1, 2, 3) for k in range(len(own) - n + 1) if (n > 1 or own[k] != " ") and (n < 3 or own[k + 1] != " ")] if own.strip() else []


def ranked(codes, size):
    return [g for g, _ in sorted(Counter(codes).items(), key=lambda x: (-x[1], x[0]))[:size]]


def test_predicted_language_is_the_nearest_profile(spark):
    size = 20
    rng = random.Random(4)
    letters = {"aa": "abcdeabcab", "bb": "abdefghaab", "cc": "éèabcxéé"}
    docs = [(k, " ".join("".join(rng.choices(letters[lang], k=rng.randrange(1, 7))) for _ in range(rng.randrange(1, 12))), lang) for k, lang in enumerate(rng.choices(list(letters), k=60))]
    docs += [(60, "same Same", "aa"), (61, "same Same", "bb"), (62, "123 !", "aa"), (63, None, "aa"), (64, "zzz", None), (64, "zzz", None), (65, "\u0301 \u0301", None), (66, "a\u0301 " * 50_000, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    p = language.LanguageParams(profile_size=size)
    got = sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.predict(d, language.profiles(d, p), p).collect())
    known = {lang: ranked([g for _, t, own in docs if own == lang for g in grams(t)], size) for lang in letters}
    want = []
    for k, text, _ in docs:
        top = ranked(grams(text), size)
        far = {lang: sum(abs(prof.index(g) - i) if g in prof else size for i, g in enumerate(top)) for lang, prof in known.items()}
        best = min(sorted(far), key=far.get)
        want.append((k, best, round(1 - far[best] / (size * len(top)), 9)) if top else (k, "und", 0.0))
    assert got == sorted(want)
