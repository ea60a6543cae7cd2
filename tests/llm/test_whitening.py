"""Whitening against numpy's eigenvectors of the covariance, exact sums against whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, whitened int"


def steps(v):
    return [math.floor(256 * float(np.float32(c))) for c in v]


def expected(rows):
    """(vec_id, deviation, absolute white coordinates) by numpy over the distinct vectors."""
    fine = [(k, steps(v)) for k, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in fine), default=0)
    fine = [(k, v + [0] * (d - len(v))) for k, v in fine]
    fit = sorted({tuple(v) for _, v in fine})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    m = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(m.T @ m / n)
    top = np.argsort(-values)[:4]
    white = {k: None for k, _ in fine}
    out = []
    for k, v in fine:
        white = np.abs(np.array([(n * c - s) / n for c, s in zip(v, sums)]) @ vectors[:, top] / np.sqrt(values[top]))
        out.append((k, sum((n * c - s) ** 2 for c, s in zip(v, sums)), white))
    return n, out, values[top] / values.sum()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(400, 7)) * np.array([3, 2, 1.5, 1, 0.5, 0.3, 0.1]) + 4).astype(np.float32).tolist()
    odd = [(900, None), (901, [1.0, None, 2.0, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] + [0.0] * 6), (903, [float("inf")] + [0.0] * 6), (904, [1.0, 2.0]), (905, []), (None, base[3]), (906, [-0.0] * 7), (907, [0.0] * 7)]
    return [(k, v, "a", 1) for k, v in enumerate(base)] + [(1000 + k, base[0], "a", 1) for k in range(300)] + [(k, v, None, None) for k, v in odd]


@pytest.mark.parametrize("fan_in", [2, 32])
def test_white_coordinates(spark, rows, fan_in):
    n, want, shares = expected(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(9)
    done = whitening.whiten(df, params=whitening.WhiteningParams(fan_in=fan_in))
    assert done.model.n == n and done.error < 1e-9 and np.allclose(done.model.values / done.model.trace, shares, rtol=1e-9)
    got = done.rows.select("vec_id", "deviation_" if "deviation_" in done.rows.columns else "deviation", F.col("whitened_")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got, want = sorted(((r[0], r[1], np.abs(r[2])) for r in got), key=key), sorted(want, key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(np.allclose(g[2], w[2], atol=1e-8) for g, w in zip(got, want))
    assert {"x", "whitened"} <= set(done.rows.columns)


def test_covariance_is_never_needed_for_ill_conditioned_rows(spark):
    """Directions whose variances differ by 1e12 come out; a covariance in doubles would keep few digits of the small one."""
    rng = np.random.default_rng(2)
    big, small = rng.integers(-(1 << 40), 1 << 40, 300), rng.integers(-50, 50, 300)
    x = [[int(a), int(a) + int(b)] for a, b in zip(big, small)]
    model = whitening.fit(spark.createDataFrame([(v,) for v in x], "x array<long>").repartition(5))
    fit = sorted(map(tuple, x))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    m = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    assert model.sums == sums and np.allclose(model.values, np.linalg.svd(m, compute_uv=False) ** 2 / n, rtol=1e-3)


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(1, [2.0**44]), (2, [-(2.0**44)]), (3, [0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whiten(df).rows.collect()}
    assert got == {1: None, 2: None, 3: 0}


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[1.0, 2.0]] * 3])
def test_nothing_to_whiten(spark, vectors):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    done = whitening.whiten(df)
    assert done.error == 0.0 and all(r.whitened == [] for r in done.rows.collect())
    assert len(done.rows.collect()) == sum(v is not None for v in vectors)


def test_query(spark):
    got = whitening.op12_whitening(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    n, want, shares = expected(rows)
    found = {(r.vec_id, r.component): r for r in got.collect()}
    assert len(found) == 4 * len(want) and {r.n for r in found.values()} == {n} and max(r.identity_error for r in found.values()) < 1e-9
    for k, deviation, white in want:
        for c in range(4):
            r = found[k, c + 1]
            assert r.deviation == deviation and abs(abs(r.whitened) - white[c]) < 1e-8 and abs(r.explained / shares[c] - 1) < 1e-9
