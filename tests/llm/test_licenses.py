"""License findings against a plain containment search."""

import re

import pytest

from lorewell.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall((text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(docs, share=0.8):
    """Templates of which one stretch of their own length holds the share."""
    out = set()
    for doc, text in docs:
        g = grams(text)
        for name, template in licenses.TEMPLATES.items():
            own = set(grams(template))
            if any(len(own & set(g[i : i + len(own)])) >= share * len(own) for i in range(len(g))):
                out.add((doc, name))
    return out


GPL = licenses.TEMPLATES["gpl-3.0-notice"]
DOCS = [
    (1, "x y z " * 30 + GPL + " tail " * 20), (2, GPL.replace("redistribute", "share")), (3, "Released under the MIT License."), (4, "released under the mit license and more"), (5, None), (6, ""), (7, "MIT License"),
    (8, " ".join(licenses.TEMPLATES.values())), (9, "lorem ipsum " * 4000 + licenses.TEMPLATES["apache-2.0"]), (10, "Licensed under CC BY-NC 4.0.\nAll rights reserved."), (11, "This program is free software"),
]


def run(spark, docs):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, license string")
    return licenses.scan(d).collect()


def test_findings(spark):
    rows = run(spark, DOCS)
    assert {(r.doc_id, r.license) for r in rows} == brute(DOCS)
    assert all(0.8 <= r.containment <= 1 and r.n_windows >= 1 for r in rows)
    where = {(r.doc_id, r.license): r.begin_word for r in rows}
    assert where[(1, "gpl-3.0-notice")] == 90 and where[(9, "apache-2.0")] == 8000 and where[(3, "mit")] == 0


def test_fixture_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {(r.doc_id, r.license) for r in licenses.op6_licenses(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(docs) and got


def test_edges(spark):
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"), {"short": "too few words"})
    rows = run(spark, [(None, DOCS[2][1]), (3, DOCS[2][1]), (3, DOCS[2][1])])
    assert sorted(str(r.doc_id) for r in rows) == ["3", "None"]


def test_bands_reach_the_recall():
    p = licenses.LicenseParams()
    assert 1 - (1 - p.containment / (5 - p.containment)) ** p.bands() >= p.recall
