"""Conversation repair against every sequence of edits, and pieces against whole conversations."""

import hashlib
import itertools
import random
import re
from binascii import crc32

import pytest

from lorewell.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, piece string, audit int"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = VISIBLE.findall(text)
        out.append(1 if not last else 2 if (role, text) in seen else 3 if last[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def brute(rows):
    """The least (cost, audit) and its turns, over all edits with up to two inserts at a place."""
    marks, best = faults(rows), None
    choices = []
    for (role, text), fault in zip(rows, marks):
        own = [("D", 2, None)]
        if fault not in (1, 2):
            own += [("K", 5 * (fault == 3), (role, text))] + [("R", 1 + 5 * (fault == 3), (r, text)) for r in ("user", "assistant")]
        choices.append(own)
    inserts = [()] + [tuple(("I", 5, (r, "")) for r in rs) for n in (1, 2) for rs in itertools.product(("user", "assistant"), repeat=n)]
    for picked in itertools.product(*choices):
        for extra in itertools.product(inserts, repeat=len(rows) + 1):
            if sum(map(len, extra)) > 3:
                continue
            steps = [*extra[0]]
            for edit, more in zip(picked, extra[1:]):
                steps += [edit, *more]
            kept = [s[2] for s in steps if s[2]]
            if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in kept)):
                now = (sum(s[1] for s in steps), "".join(s[0] for s in steps), kept)
                best = now if best is None or now[:2] < best[:2] else best
    return best


def reported(rows):
    """The whole report of one conversation by dynamic programming over whole strings."""
    marks = faults([(r, t) for _, r, t in rows])
    live = {0: (0, "", ())}
    close = lambda live: live | {t: min(x for x in (live.get(t), *((live[s][0] + 5, live[s][1] + "I", live[s][2] + ((turns.ROLES[turns.WANTED[s]], ""),)) for s in ss if s in live)) if x) for t, ss in ((2, (0, 1, 3)),) if t in live or any(s in live for s in ss)}
    answer = lambda live: live | {3: min(x for x in (live.get(3), (live[2][0] + 5, live[2][1] + "I", live[2][2] + (("assistant", ""),)) if 2 in live else None) if x)}
    for (_, role, text), fault in zip(rows, marks):
        live, now = answer(close(live)), {}
        for s, (c, a, kept) in live.items():
            options = [(s, (c + 2, a + "D", kept))]
            if fault not in (1, 2):
                pay = 5 * (fault == 3)
                if role[:1] in turns.NEXT[s]:
                    options.append((turns.NEXT[s][role[:1]], (c + pay, a + "K", kept + ((role, text),))))
                w = turns.WANTED[s]
                options.append((turns.NEXT[s][w], (c + pay + 1, a + "R", kept + ((turns.ROLES[w], text),))))
            for t, x in options:
                now[t] = min(now.get(t, x), x)
        live = now
    live = answer(close(live))
    cost, audit, kept = min(live[s] for s in (0, 3) if s in live)
    known = [t for t, _, _ in rows if t is not None]
    letters = [r[:1] for _, r, _ in rows]
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0, *(marks.count(k) for k in (1, 2, 3)), sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    )


def order(row):
    return (row[0] is not None, row[0] or 0, row[1], row[2])


@pytest.fixture(scope="module")
def made():
    rng = random.Random(7)
    texts = ["one.", "two!", "cut", " ", "", "three? ", "x", None]
    roles = ["user", "assistant", "system", "tool", "", None, "umpire"]
    rows = [(c, rng.choice([None, 1, 2, 3, 4, 9]), rng.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], rng.choice(texts), "z", 1) for c in range(60) for _ in range(rng.randrange(1, 5))]
    return rows + [(None, k, "user" if k % 2 else "assistant", f"t{k}.", "z", 1) for k in range(9)] + [(99, 5, "user", "again.", "z", 1)] * 7


def got(spark, rows, p=turns.TurnParams()):
    done = turns.repair(spark.createDataFrame(rows, SCHEMA), params=p)
    sha = {r.conv_id: r.repaired_sha256 for r in turns.digests(done.turns).collect()}
    none = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (*(r[c] for c in turns.REPORT), r.audit, sha.get(r.conv_id, none)) for r in done.report.collect()}


@pytest.mark.parametrize("piece_rows", [1, 2, 4096])
def test_every_conversation_in_pieces_of_any_size(spark, made, piece_rows):
    by = {}
    for c, t, r, x, *_ in made:
        by.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    want = {c: reported(sorted(rows, key=order)) for c, rows in by.items()}
    assert got(spark, made, turns.TurnParams(piece_rows=piece_rows)) == want


def test_dynamic_programme_against_all_edits(made):
    by = {}
    for c, t, r, x, *_ in made[:120]:
        by.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    for rows in list(by.values()):
        rows = sorted(rows, key=order)[:3]
        cost, audit, kept = brute([(r, t) for _, r, t in rows])
        assert reported(rows)[5:] == (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def test_a_conversation_that_spans_partitions(spark):
    rng = random.Random(3)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{k}.", f"t{k}", " ", "again."]), "", 0) for k in range(3000)] + [(2, 1, "user", "x" * 300_000 + ".", "", 0)]
    for c in (1, 2):
        want = reported(sorted(((t, r, x) for k, t, r, x, *_ in rows if k == c), key=order))
        assert got(spark, rows, turns.TurnParams(piece_rows=64, broadcast_rows=1))[c] == want


def test_repaired_turns_follow_the_grammar(spark, made):
    done = turns.repair(spark.createDataFrame(made, SCHEMA))
    by = {}
    for r in done.turns.orderBy("conv_id", "piece", "place").collect():
        by.setdefault(r.conv_id, []).append(r)
    assert all(re.fullmatch(r"s?(ua)+", "".join(r.role[0] for r in rows)) for rows in by.values())
    assert all(r.text == "" for rows in by.values() for r in rows if r.edit == "I")


def test_empty_table_and_lost_rows(spark):
    assert got(spark, []) == {}
    empty = turns.repair(spark.createDataFrame([], SCHEMA))
    assert empty.turns.collect() == [] and empty.turns.columns == ["conv_id", "piece", "place", "edit", "role", "text"]


def test_damage(spark):
    rows = [(c, t, "assistant", "a. b!", "", 0) for c in range(40) for t in (0, 1, None)] + [(None, 1, None, None, "", 0)]
    out = sorted(((r.conv_id, r.turn, r.role, r.text) for r in turns.damaged(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = []
    for c, t, role, text, *_ in rows:
        show = lambda x: " " if x is None else str(x)
        k = crc32(f"{show(c)}:{show(t)}".encode()) % 20
        role, text = show(role), show(text)
        row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        want += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    assert out == sorted(want, key=str)
