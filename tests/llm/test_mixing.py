"""Exponents, budgets and permutations of the mixture."""

import math

import pytest

from lorewell.llm import mixing


def test_exponent_meets_the_entropy():
    tokens = [900.0, 50.0, 30.0, 20.0]
    p = mixing.MixingParams(entropy=0.8, max_repeats=1e9)
    a = mixing.exponent(tokens, p)
    assert 0 < a < 1 and abs(mixing.entropy(mixing.weights(tokens, a)) - 0.8 * math.log(4)) < 1e-6


def test_repetition_limit_binds():
    tokens = [900.0, 50.0, 30.0, 20.0]
    p = mixing.MixingParams(entropy=1.0, max_repeats=3.0)
    w = mixing.weights(tokens, mixing.exponent(tokens, p))
    assert max(x * 1000 / t for x, t in zip(w, tokens)) <= 3 + 1e-6
    assert mixing.exponent([5.0], p) == 1.0 and mixing.exponent([5.0, 5.0], p) == 1.0


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, epoch string")


def make(spark):
    rows = [(k, "big" if k < 400 else f"s{k % 3}", "w " * (k % 40), "clash") for k in range(500)]
    return table(spark, [*rows, (900, None, None, "x"), (901, "", "a b", "x"), (901, "", "a b", "x")])


@pytest.mark.parametrize(("rows", "sources"), [(400_000, 200_000), (0, 200_000), (400_000, 1)])
def test_budgets(spark, rows, sources):
    docs = make(spark)
    p = mixing.MixingParams(entropy=0.9, max_repeats=3.0, block_tokens=200, broadcast_rows=rows, max_sources=sources)
    out = mixing.mix(docs, p, ("doc_id", "source")).collect()
    size = {r.doc_id: (r.source or "", (r.text or "").count("w") + (2 if r.text == "a b" else 0) + 1) for r in docs.collect()}
    total = sum(v for _, v in size.values()) + 3
    got, have = {}, {}
    for r in out:
        got[size[r.doc_id][0]] = got.get(size[r.doc_id][0], 0) + r.tokens
        assert r.tokens == size[r.doc_id][1] and r.mix_key >= 0
    for s, n in size.values():
        have[s] = have.get(s, 0) + n
    have[""] += 3  # one row is there twice
    names = sorted(have)
    w = mixing.weights([float(have[s]) for s in names], mixing.exponent([float(have[s]) for s in names], p))
    for s, x in zip(names, w):
        assert 0 <= got.get(s, 0) - x * total <= 41, s  # over by less than one document
    times = {}
    for r in out:
        times.setdefault((r.doc_id, r.epoch), []).append(1)
    assert max(len(v) for k, v in times.items() if k[0] != 901) == 1  # once an epoch
    again = mixing.mix(docs, p, ("doc_id", "source")).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_all_columns_and_empty(spark):
    docs = make(spark)
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "source", "text", "epoch", "epoch_", "block", "tokens", "mix_key"] and len(out.collect()) > 400
    assert mixing.mix(docs.limit(0), columns=("doc_id",)).collect() == []
