"""Reading order and subtree ranges against recursion: chains, wide roots, forests, cycles."""

import random

import pytest
from pyspark.sql import functions as F

from lorewell.operators import catalog, tree

SCHEMA = "id long, parent_id long, sort_order int"


def walked(rows):
    """{id: (root, pre, last, depth)} by an explicit stack."""
    known = {r[0] for r in rows}
    children = {}
    for i, p, s in rows:
        children.setdefault(p if p in known else None, []).append((s is not None, s or 0, i))
    out = {}
    for *_, root in sorted(children.get(None, [])):
        count, stack = 0, [(root, 0, False)]
        while stack:
            at, depth, done = stack.pop()
            if done:
                out[at] = (*out[at][:2], count, depth)
                continue
            count += 1
            out[at] = (root, count, None, depth)
            stack.append((at, depth, True))
            stack += [(c, depth + 1, False) for *_, c in sorted(children.get(at, []), reverse=True)]
    return out


def labelled(spark, rows):
    return {r.id: (r.root, r.pre, r["last"], r.depth) for r in tree.labels(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_deep_chain_and_wide_root(spark):
    rng = random.Random(2)
    chain = [(k, k - 1 if k else None, 0) for k in range(900)]
    wide = [(10_000 + k, 10_000 if k else None, rng.choice([None, 1, 2, 3])) for k in range(1500)]
    mixed = [(20_000 + k, 20_000 + rng.randrange(k) if k else 77_777, rng.randrange(4)) for k in range(300)]
    rows = chain + wide + mixed
    rng.shuffle(rows)
    assert labelled(spark, rows) == walked(rows)


def test_ranges_are_the_descendants(spark):
    rows = [(k, (k - 1) // 3 if k else None, -k) for k in range(200)]
    dirs = spark.createDataFrame(rows, SCHEMA)
    found = tree.labels(dirs)
    roots = dirs.where("id IN (1, 5, 150)")
    want = {(r.root, r.id) for r in catalog.descendants(dirs, roots).collect()}
    got = set()
    for r in found.where("id IN (1, 5, 150)").collect():
        got |= {(r.id, x.id) for x in tree.below(found, r.root, r.pre, r["last"]).collect()}
    assert got == want


def test_odd_rows(spark):
    assert labelled(spark, []) == {}
    assert labelled(spark, [(1, None, None), (None, 1, 1), (2, 99, 1), (3, 1, 2), (3, 1, 1)]) == {1: (1, 1, 2, 0), 3: (1, 2, 2, 1), 2: (2, 1, 1, 0)}
    for rows in ([(1, 2, 0), (2, 1, 0), (3, None, 0)], [(1, 1, 0)]):
        with pytest.raises(ValueError):
            labelled(spark, rows)


def test_a_range_reaches_the_scan(spark, tmp_path):
    found = tree.labels(spark.createDataFrame([(k, (k - 1) // 2 if k else None, 0) for k in range(300)], SCHEMA))
    docs = spark.range(1000).select("id", F.pmod("id", F.lit(300)).alias("directory_id"))
    docs.join(found.select(F.col("id").alias("directory_id"), "root", "pre"), "directory_id").sort("root", "pre").write.parquet(f"{tmp_path}/docs")
    own = found.where("id = 6").first()
    inside = tree.below(spark.read.parquet(f"{tmp_path}/docs"), own.root, own.pre, own["last"])
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "ThanOrEqual(pre" in plan.split("PushedFilters")[1] and "Join" not in plan
    wanted = {r.id for r in catalog.descendants(found.select("id", "parent_id"), found.where("id = 6")).collect()}
    assert {r.directory_id for r in inside.collect()} == wanted


def test_rounds_grow_with_depth_alone(spark, monkeypatch):
    """Siblings dealt out over many partitions, few rounds for a shallow tree."""
    rng = random.Random(4)
    rows = [(k, None if k == 0 else 0 if k < 1500 else 7 if k < 2500 else rng.randrange(k), rng.choice([None, 1, 2])) for k in range(3000)]
    plain, made = tree.stored, []
    monkeypatch.setattr(tree, "stored", lambda df: made.append(df) or plain(df))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert labelled(spark, rows) == walked(rows)
        assert len(made) < 15
        found = tree._earlier(spark.createDataFrame([(k, 1, 0, 1) for k in range(100)], "id long, parent long, sort_order int, size long"))
        assert {(r.id, r.before) for r in found.collect()} == {(k, k) for k in range(100)} and made[-1].select("part").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
