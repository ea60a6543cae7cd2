"""Repeated passages against a plain search for shared word runs."""

import random
import re

import numpy as np
import pytest

from lorewell.llm import substrings

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def covered(docs, t=50):
    """Words that lie in a run of t words which another row has too."""
    ws = [WORD.findall((x or "").translate(LOWER)) for _, x in docs]
    holders = {}
    for k, w in enumerate(ws):
        for i in range(len(w) - t + 1):
            holders.setdefault(tuple(w[i : i + t]), set()).add(k)
    out = []
    for k, w in enumerate(ws):
        own = set()
        for i in range(len(w) - t + 1):
            if len(holders[tuple(w[i : i + t])]) > 1:
                own.update(range(i, i + t))
        out.append(own)
    return out


def made():
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    shared, long, short = text(55), text(400), text(40)
    docs = [(k, f"{text(rng.randrange(5, 90))} {shared} {text(rng.randrange(5, 90))}") for k in range(12)]
    docs += [(20, text(100)), (21, f"{text(30)} {long}"), (22, f"{long} {text(10)}"), (23, f"{text(60)} {short} {text(60)}"), (24, f"{short} {text(60)}"), (25, text(300) + " " + shared)]
    same = text(80)
    return [*docs, (30, same), (31, same.upper() + "!"), (32, same), (40, None), (41, ""), (42, "short"), (43, "spam " * 2000), (44, "spam " * 1500), (None, f"{text(20)} {long[:1200]}")]


def run(spark, docs, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return substrings.find_repeats(d, substrings.SubstringParams(**kw)).collect()


@pytest.mark.parametrize("kw", [{}, {"block_bytes": 300, "members": 2}, {"broadcast_rows": 0}])
def test_exact_repeats(spark, kw):
    docs = made()
    got = {}
    for r in run(spark, docs, **kw):
        got.setdefault(r.doc_id, set()).update(range(r.begin_word, r.end_word))
    for (doc, _), want in zip(docs, covered(docs)):
        assert want <= got.get(doc, set()), doc
        assert len(got.get(doc, set()) - want) <= 12, doc  # a near match may run on a little


def test_near_repeat(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(120)]
    other = list(base)
    other[60] = "changed"
    docs = [(1, " ".join(base)), (2, " ".join([word() for _ in range(30)] + other)), (3, " ".join(word() for _ in range(200)))]
    got = {r.doc_id: (r.begin_word, r.end_word, r.cut) for r in run(spark, docs)}
    assert {k: v[:2] for k, v in got.items()} == {1: (0, 120), 2: (30, 150)} and got[1][2] != got[2][2]


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, "")]) == []


def test_compact_windows_are_a_cartesian_tree():
    rng = np.random.default_rng(4)
    for _ in range(20):
        value, width = rng.permutation(40).astype(np.uint64), 6
        left, centre, right = substrings.compact_windows(value, np.array([0, 25, 40]), width)
        assert all(value[c] == value[a:b].min() for a, c, b in zip(left, centre, right)) and (np.diff(centre) > 0).all()
        got = set(centre.tolist())
        want = {int(a + np.argmin(value[a:b])) for lo, hi in ((0, 25), (25, 40)) for a in range(lo, hi) for b in range(a + width, hi + 1)}
        assert want == got


def test_cutting_keeps_one_copy(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    shared, own = text(60), text(70)
    rows = [(1, f"Été {text(20)}. {shared}", 5, "k"), (2, f"{shared}, tail é", 5, None), (3, own, 5, "x"), (4, own, 5, "x"), (5, None, 5, "y"), (6, text(80), 5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, cut string")
    got = {r.doc_id: r for r in substrings.cut_repeats(docs).collect()}
    assert len(got) == 6 and substrings.cut_repeats(docs).columns == docs.columns
    texts = [got[k].text for k in (1, 2)]
    assert sum(shared in t for t in texts) == 1 and (got[2].text.strip() == "tail é" or got[1].text.startswith("Été") and not got[1].text.endswith(shared))
    assert {got[3].text, got[4].text} == {own, ""} and tuple(got[5]) == rows[4] and tuple(got[6])[1] == rows[5][1]
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text is not None)


def test_rows_that_repeat_entirely_are_one_holder(spark):
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    one, two, three = text(70), text(80), text(60)
    rows = [(1, one), (1, one), (None, two), (None, two), (3, three), (3, three), (4, three)]
    got = {(r.doc_id, r.begin_word, r.end_word, r.cut) for r in run(spark, rows)}
    assert {x for x in got if x[0] in (1, None)} == {(1, 0, 70, False), (None, 0, 80, False)}
    assert {x[3] for x in got if x[0] == 3} == {False} and {x[3] for x in got if x[0] == 4} == {True}
    kept = sorted(r.text for r in substrings.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted([one, one, two, two, three, three, ""])


def shingled(words):
    return np.array([hash(tuple(words[i : i + 5])) & 0x7FFFFFFFFFFFFFFF for i in range(len(words) - 4)], np.uint64)


@pytest.mark.parametrize("r", [5, 12, 20, 31])
def test_repeated_lines_stay_when_joined_runs_fail(r):
    line, tail = [f"l{k}" for k in range(12)], [f"t{k}" for k in range(r)]
    a, b = shingled(line * 6 + ["one"] + tail), shingled(line * 6 + ["two"] + tail)
    got = set().union(*(range(x, y) for x, y, _, _ in substrings.passages(a, b, [0], substrings.SubstringParams())))
    assert set(range(68)) <= got


@pytest.mark.parametrize("kw", [{}, {"block_bytes": 300, "members": 2}])
def test_passages_with_an_insertion_or_deletion(spark, kw):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    words = lambda n: [word() for _ in range(n)]
    docs, want = [], {}
    for k in range(10):
        base = words(98)
        other = [*base[:49], word(), *base[49:]] if k % 2 else [*base[:48], *base[49:]]
        for doc, own, head in ((2 * k, base, 20), (2 * k + 1, other, 35)):
            docs.append((doc, " ".join(words(head) + own + words(25))))
            want[doc] = set(range(head, head + len(own)))
    got = {}
    for r in run(spark, docs, **kw):
        got.setdefault(r.doc_id, set()).update(range(r.begin_word, r.end_word))
    assert got == want


def test_chains_of_several_offsets():
    w = [f"w{k}" for k in range(120)]
    other = [*w[:30], "x", *w[30:60], "y", *w[60:]]
    a, b = shingled(w), shingled(other)
    got = substrings.passages(a, b, [0], substrings.SubstringParams())
    assert (0, len(b), 0, len(a)) in got


def similarity(a, b):
    u, v = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    return len(u & v) / len(u | v)


def edited(rng, base, word):
    """The passage with changed, inserted and deleted words, as many as keep the similarity at 0.8 or above."""
    out = list(base)
    while True:
        k, way = rng.randrange(len(out)), rng.randrange(3)
        new = [*out[:k], *([word()] if way < 2 else []), *out[k + (way != 1) :]]
        if similarity(base, new) < 0.8 or len(new) < 50:
            return out
        out = new


def test_recall_of_near_passages(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    words = lambda n: [word() for _ in range(n)]
    docs, want = [], {}
    for group, size in enumerate([52, 54, 60, 70, 80, 100, 120, 150, 200] * 12):
        base = words(size)
        for k, own in enumerate((base, edited(rng, base, word))):
            head = rng.randrange(0, 60)
            doc = 2 * group + k
            docs.append((doc, " ".join(words(head) + own + words(rng.randrange(0, 60)))))
            want[doc] = (size, set(range(head, head + len(own))))
    rng.shuffle(docs)
    got = {}
    for r in run(spark, docs):
        got.setdefault(r.doc_id, set()).update(range(r.begin_word, r.end_word))
    found = {k: len(own & got.get(k, set())) >= 0.7 * len(own) for k, (_, own) in want.items()}
    by_size = {}
    for k, (size, _) in want.items():
        by_size.setdefault(size, []).append(found[k])
    print({size: round(sum(x) / len(x), 2) for size, x in sorted(by_size.items())})
    assert sum(found.values()) >= 0.95 * len(found) and all(sum(x) >= 0.85 * len(x) for x in by_size.values())
    assert all(len(got.get(k, set()) - own) <= 12 for k, (_, own) in want.items())


def test_many_holders_of_a_near_passage(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    words = lambda n: [word() for _ in range(n)]
    base = words(100)
    docs = [(k, " ".join(words(20) + [*base[: k % 98], word(), *base[k % 98 + 1 :]] + words(20))) for k in range(80)]
    assert len({r.doc_id for r in run(spark, docs)}) >= 0.95 * len(docs)


@pytest.mark.parametrize("changed", [1, 2, 3, 0])
def test_exact_repeats_behind_edited_copies(spark, changed):
    """Two documents share 60 words; 40 others hold them with some changed, or (0) the first 49 only. Nearly all of the two have the whole passage as a span, and all of them most of it."""
    rng = random.Random(20 + changed)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    docs, wanted = [], {}
    for g in range(12):
        passage = [word() for _ in range(60)]
        for m in range(42):
            own = list(passage)
            if m not in (20, 21):
                own = own[:49] if not changed else own
                for k in rng.sample(range(60), changed):
                    own[k] = word()
            before = [word() for _ in range(rng.randrange(5, 60))]
            doc = g * 100 + m
            docs.append((doc, " ".join([*before, *own, *(word() for _ in range(rng.randrange(5, 60)))])))
            if m in (20, 21):
                wanted[doc] = (len(before), len(before) + 60)
    rng.shuffle(docs)
    spans = {}
    for r in substrings.find_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect():
        spans.setdefault(r.doc_id, []).append((r.begin_word, r.end_word))
    whole = [d for d, (a, b) in wanted.items() if any(x <= a and b <= y for x, y in spans.get(d, []))]
    most = [d for d, (a, b) in wanted.items() if any(min(b, y) - max(a, x) >= 49 for x, y in spans.get(d, []))]
    # a copy that has 50 of the words unchanged may stand in for the other one, up to there
    assert len(whole) >= 0.9 * len(wanted) and len(most) == len(wanted)
