"""Substring dedup: compact windows find near-duplicate passages, alignment verifies them.

A compact window (l, c, r) of a hash function says that every stretch inside
[l, r) that holds place c has its smallest hash there. The windows of at least
`min_words` words come from the Cartesian tree of a text's shingle hashes, built
top-down for all texts of a slice at once. If two texts share a stretch of that
length, one window of each holds it for every hash function, and both have the
same centre in it; if the stretches have the Jaccard similarity J, they have it
with probability J.

1. Texts with equal words collapse to one. For each of `bands` pairs of functions
   the windows of a text are joined by interval: where both centres and a stretch
   of `min_words` words lie in both windows, the two centres are a key. Similar
   passages share at least one of them with probability 1 - (1 - J^2)^bands.
   Within a block equal keys meet first and only the first holder goes on; the
   keys are then packed by hash segment and shuffled once. A holder of a key meets
   the key's first holder, or the last in every other band, not all others. Those
   who met a last holder are verified after the others, and only where the passage
   around the key is still open. Exact stretches of `min_words` words have keys of
   their own, the least hash of every `exact_step` neighbours: holders of such a key
   do repeat its first holder, so an exact passage of min_words + exact_step - 1
   words is found however many edited copies hold the other keys.
2. Pairs of texts, with the offsets at which their keys meet, are verified in
   tasks of one such holder and up to `members` others. Shingles that both have
   near one of the offsets form runs; runs are chained over gaps and over
   neighbouring offsets, as changed, inserted or deleted words leave them, while
   the Jaccard similarity of both sides stays at the threshold. Stretches of
   `min_words` words on both sides remain.
3. Spans of a text are merged and given to all its copies.

Result: (doc_id, begin_word, end_word, cut): `cut` spans repeat a passage of an
earlier holder, the others are where the holders that were met have it.

Edge cases: null, empty and short texts have no span; repeats inside one text
alone are not reported; copies of a whole text of `min_words` words are one span
each; a null doc_id takes part; repeated rows are copies; an empty table gives an
empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.llm import common


@dataclass(frozen=True)
class SubstringParams:
    min_words: int = 50
    words: int = 5
    threshold: float = 0.8
    #: Pairs of hash functions.
    bands: int = 4
    #: Neighbouring exact stretches of which one has a key.
    exact_step: int = 11
    block_bytes: int = 8 << 20
    segment_bytes: int = 4 << 20
    max_segments: int = 1 << 20
    #: Texts that are compared with a first holder in one task.
    members: int = 200
    broadcast_rows: int = 400_000

    @property
    def width(self) -> int:
        """Shingles in the shortest passage."""
        return self.min_words - self.words + 1


def compact_windows(value: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the compact windows of at least `width` places of every text, by c; values should be distinct within a text."""
    lo, hi = bounds[:-1], bounds[1:]
    keep = hi - lo >= width
    lo, hi, found = lo[keep], hi[keep], []
    while len(lo):
        size = hi - lo
        starts = np.cumsum(size) - size
        place = np.arange(size.sum()) + np.repeat(lo - starts, size)
        own = value[place]
        least = np.minimum.reduceat(own, starts)
        at = np.flatnonzero(own == np.repeat(least, size))
        centre = place[at[np.searchsorted(at, starts)]]
        found.append((lo, centre, hi))
        lo, hi = np.concatenate([lo, centre + 1]), np.concatenate([centre, hi])
        keep = hi - lo >= width
        lo, hi = lo[keep], hi[keep]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    left, centre, right = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(centre)
    return left[order], centre[order], right[order]


def _exact(s: np.ndarray, bounds: np.ndarray, tie: np.ndarray, p: SubstringParams) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of the exact stretches that have the least hash among `exact_step` neighbours somewhere."""
    step, most = p.exact_step, np.uint64(0xFFFFFFFFFFFFFFFF)
    if len(s) < p.width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(s), dtype=np.uint64)])
    stretch = common.mix(sums[p.width :] - sums[: len(sums) - p.width])
    n = len(stretch)
    inside = np.arange(n) + p.width <= bounds[np.searchsorted(bounds, np.arange(n), "right")]
    # stretches over a text's end are never the least; there are more of them between texts than neighbours
    value = np.full(n + 2 * (step - 1), most)
    value[step - 1 : step - 1 + n] = np.where(inside, stretch & ~np.uint64(0xFFFF) | tie[:n], most)
    low = np.lib.stride_tricks.sliding_window_view(value, step).min(1)
    high = np.lib.stride_tricks.sliding_window_view(np.where(low == most, np.uint64(0), low), step).max(1)
    at = np.flatnonzero(inside & (value[step - 1 : step - 1 + n] == high))
    return common.mix(stretch[at] + np.uint64(0x51)) & ~np.uint64(1), at


def _keys(s: np.ndarray, bounds: np.ndarray, p: SubstringParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place of its first centre, is its band odd) from the joined windows of all bands."""
    tie = common.mix(np.arange(len(s), dtype=np.uint64)) & np.uint64(0xFFFF)
    seed = lambda f: np.uint64((f + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    keys, places = [], []
    for band in range(p.bands):
        (l1, c1, r1), (l2, c2, r2) = (compact_windows(common.mix(s + seed(f)) & ~np.uint64(0xFFFF) | tie, bounds, p.width) for f in (2 * band, 2 * band + 1))
        first, last = np.searchsorted(c2, l1), np.searchsorted(c2, r1)  # windows of the second function with their centre in one of the first
        many = last - first
        one = np.repeat(np.arange(len(c1)), many)
        two = np.arange(len(one)) + np.repeat(first - (np.cumsum(many) - many), many)
        shared = np.minimum(r1[one], r2[two]) - np.maximum(l1[one], l2[two])
        both = (l2[two] <= c1[one]) & (c1[one] < r2[two]) & (shared >= p.width)
        one, two = c1[one[both]], c2[two[both]]
        key = common.mix(common.mix(s[one] + seed(2 * band)) + s[two]) & ~np.uint64(1) | np.uint64(band & 1)
        keys.append(key)
        places.append(one)
    key, one = _exact(s, bounds, tie, p)
    keys.append(key)
    places.append(one)
    key, place = np.concatenate(keys), np.concatenate(places)
    order = np.lexsort((key, place))
    key, place = key[order], place[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
    key, place = key[new], place[new]
    return key, place, (key & np.uint64(1)).astype(bool)


def _sorted(key: np.ndarray, odd: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """By key, parity, owner and place; owners descend for odd keys."""
    return np.lexsort((place, np.where(odd, -owner, owner), odd, key))


def _pack(values: np.ndarray, width: int) -> bytes:
    """The low bytes of integers, as planes: the upper ones are mostly zero and compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpack(raw: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return wide.view("<u8").ravel()


def _meet(key: np.ndarray, odd: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First holders and others of entries in the order of `_sorted`; and which entries are first holders'.

    Every other entry meets its key's first one; where the first holder has the
    key again, that place meets the first other entry.
    """
    if not len(key):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(bool)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (odd[1:] != odd[:-1])])
    group = np.cumsum(new) - 1
    lead = np.flatnonzero(new)[group]
    own = owner == owner[lead]
    other = np.flatnonzero(~own)
    first = np.full(group[-1] + 1, -1)
    first[group[other][::-1]] = other[::-1]
    again = np.flatnonzero(own & ~new & (first[group] >= 0))
    return np.concatenate([lead[other], again]), np.concatenate([other, first[group[again]]]), own


def _met(columns: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    """Rows of distinct `columns` with the least and the largest place of each."""
    rows = np.stack([np.asarray(x, np.int64) for x in columns], 1)
    if not len(rows):
        return np.zeros((0, rows.shape[1] + 2), np.int64)
    order = np.lexsort((place, *rows.T[::-1]))
    rows, place = rows[order], np.asarray(place, np.int64)[order]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]))
    last = np.append(new[1:], len(rows)) - 1
    return np.column_stack([rows[new], place[new], place[last]])


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, a key of the row's content, the digest of its words and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            h, _, _, bounds = common.words(*common.text_arrays(part.column("text")))
            made = [hashlib.md5(h[a:b].tobytes()).digest() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("key"), pa.array(made, pa.binary()), pa.array(np.diff(bounds))], ["doc_id", "key", "digest", "n_words"])

    rows = documents.select("doc_id", common.row_key().alias("key"), "text")
    return common.write_shared(rows.mapInArrow(run, "doc_id long, key binary, digest binary, n_words long"), rows=documents.count())


def _packed(documents: DataFrame, segments: int, p: SubstringParams) -> DataFrame:
    """Blocks: kind 0 names the block's texts, kind 1 has keys for a segment, kind 2 pairs that met in the block.

    A key is its segment and 40 more bits: two different ones that agree cost a comparison.
    """
    bits = segments.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        names: list[bytes] = []
        held: list[tuple[np.ndarray, ...]] = []
        size = texts = 0

        def block() -> pa.RecordBatch:
            nonlocal made
            number = (task << 20) | made
            made += 1
            key, text, at, odd = (np.concatenate(x) for x in zip(*held))
            order = _sorted(key, odd, text, at)
            key, text, at, odd = key[order], text[order], at[order], odd[order]
            lead, other, own = _meet(key, odd, text, at)
            meet = _met([text[lead], text[other], odd[other], at[lead] - at[other]], at[other])
            key, text, at, odd = key[own], text[own], at[own], odd[own]
            cut = np.searchsorted((key >> np.uint64(64 - bits)).astype(np.int64), np.arange(segments + 1))
            some = np.flatnonzero(np.diff(cut))
            rest = (key << np.uint64(bits)) >> np.uint64(24)
            each = lambda x, f: [f(x[cut[k] : cut[k + 1]]) for k in some]
            steps = lambda x: _pack(np.diff(x, prepend=np.uint64(0)), 5)
            n = len(some)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([0, 2, *[1] * n], pa.int32()), pa.array([number] * (n + 2), pa.int64()), pa.array([0, 0, *some.tolist()], pa.int64()),
                    pa.array([b"".join(names), meet.astype("<i8").tobytes(), *each(rest, steps)], pa.binary()),
                    pa.array([None, None, *each(text * 2 + odd, lambda x: _pack(x, 4))], pa.binary()), pa.array([None, None, *each(at, lambda x: _pack(x, 4))], pa.binary()),
                ],
                names=["kind", "block", "segment", "keys", "texts", "places"],
            )

        for part in common.slices(batches):
            data, offsets = common.text_arrays(part.column("text"))
            h, _, _, bounds = common.words(data, offsets)
            s, at = common.shingles(h, bounds, p.words)
            key, first, odd = _keys(s, at, p)
            text = np.searchsorted(at, first, "right") - 1
            names += part.column("key").to_pylist()
            held.append((key, text + texts, first - at[text], odd))
            texts += part.num_rows
            size += len(data)
            if size >= p.block_bytes:
                yield block()
                names, held, size, texts = [], [], 0, 0
        if held:
            yield block()

    schema = "kind int, block long, segment long, keys binary, texts binary, places binary"
    return common.write_shared(documents.mapInArrow(run, schema), compression="zstd")


def _pairs(packed: DataFrame) -> DataFrame:
    """(a, b, odd, late, offsets, low, high): texts b share keys with a, the holder that they meet, at places less by the offset.

    Is a the last holder, not the first; is b the later of both; the least and the largest place of those keys in b.
    """
    names = ["ablock", "a", "bblock", "b", "odd", "offset", "low", "high"]

    def meet(table: pa.Table) -> pa.Table:
        block = table.column("block").to_pylist()
        key = [np.cumsum(_unpack(x, 5), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        text, place = ([_unpack(x, 4).astype(np.int64) for x in table.column(c).to_pylist()] for c in ("texts", "places"))
        where = np.repeat(np.array(block, np.int64), [len(x) for x in key])
        key, text, place = np.concatenate(key), np.concatenate(text), np.concatenate(place)
        odd, text = (text & 1).astype(bool), text >> 1
        owner = np.unique(where, return_inverse=True)[1] << 32 | text
        order = _sorted(key, odd, owner, place)
        key, text, place, where, odd = key[order], text[order], place[order], where[order], odd[order]
        lead, other, _ = _meet(key, odd, owner[order], place)
        found = _met([where[lead], text[lead], where[other], text[other], odd[other], place[lead] - place[other]], place[other])
        return pa.table([pa.array(found[:, k]) for k in range(8)], names=names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.frombuffer(raw, "<i8").reshape(-1, 6)
                own = np.full(len(found), block)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own, found[:, 0], own, *found[:, 1:].T)], names)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = [raw[k : k + 16] for k in range(0, len(raw), 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.array(np.arange(len(keys))), pa.array(keys, pa.binary())], ["block", "text", "key"])

    schema = ", ".join(f"{x} long" for x in names)
    far = packed.where("kind = 1").groupBy("segment").applyInArrow(meet, schema)
    near = packed.where("kind = 2").select("block", "keys").mapInArrow(local, schema)
    pairs = far.union(near).groupBy("ablock", "a", "bblock", "b", "odd").agg(F.array_sort(F.collect_set("offset")).alias("offsets"), F.min("low").alias("low"), F.max("high").alias("high"))
    texts = packed.where("kind = 0").select("block", "keys").mapInArrow(name, "block long, text long, key binary")
    a, b = (texts.select(F.col("block").alias(f"{x}block"), F.col("text").alias(x), F.col("key").alias(f"{x}key")) for x in "ab")
    named = pairs.join(a, ["ablock", "a"]).join(b, ["bblock", "b"]).where("akey != bkey")
    return named.select(F.col("akey").alias("a"), F.col("bkey").alias("b"), (F.col("odd") == 1).alias("odd"), (F.struct("bblock", "b") > F.struct("ablock", "a")).alias("late"), "offsets", "low", "high")


def _runs(sa: np.ndarray, sb: np.ndarray, offset: int, seen: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Runs [x, y) of b's shingles that a has at `offset` more; those that passages cover on both sides (a's, b's) are left out."""
    lo, hi = max(0, -offset), min(len(sb), len(sa) - offset)
    if hi <= lo:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.zeros(hi - lo + 2, bool)
    np.equal(sa[lo + offset : hi + offset], sb[lo:hi], out=same[1:-1])
    edge = np.flatnonzero(same[1:] != same[:-1])
    x, y = edge[::2], edge[1::2]
    new = np.concatenate([[0], np.cumsum(~(seen[0][lo + offset : hi + offset] & seen[1][lo:hi]))])
    some = new[y] > new[x]
    return x[some] + lo, y[some] + lo


def _parts(sa: np.ndarray, sb: np.ndarray, chain: list[tuple[int, int, int]], p: SubstringParams) -> list[tuple[int, int, int, int]]:
    """Places (in b, in a) of a chain of runs (x, y, offset) if it is similar and long enough, else of its longest parts that are."""
    out: list[tuple[int, int, int, int]] = []
    x, y, ax, ay = chain[0][0], chain[-1][1], chain[0][0] + chain[0][2], chain[-1][1] + chain[-1][2]
    if min(y - x, ay - ax) < p.width:
        return out
    u, v = set(sa[ax:ay].tolist()), set(sb[x:y].tolist())
    if len(u & v) >= p.threshold * len(u | v):
        return [(x, y, ax, ay)]
    reached = -1
    for i, (x, _, offset) in enumerate(chain):
        u, v, at, to, best = set(), set(), x + offset, x, -1
        both = 0
        for j in range(i, len(chain)):
            y, ay = chain[j][1], chain[j][1] + chain[j][2]
            for own, other, new in ((u, v, sa[at:ay]), (v, u, sb[to:y])):
                fresh = set(new.tolist()) - own
                both += len(fresh & other)
                own |= fresh
            at, to = ay, y
            if min(y - x, ay - x - offset) >= p.width and both >= p.threshold * (len(u) + len(v) - both):
                best = j
        if best > reached:
            reached = best
            out.append((x, chain[best][1], x + offset, chain[best][1] + chain[best][2]))
    return out


def _near(sa: np.ndarray, sb: np.ndarray, order: np.ndarray, offsets: np.ndarray, free: np.ndarray, p: SubstringParams) -> list[tuple[int, int, int]]:
    """Runs (x, y, offset) of b's free shingles that a has at an offset near one of `offsets`; `order` sorts sa."""
    at = np.minimum(np.searchsorted(sa, sb[free], sorter=order), len(sa) - 1)
    there = sa[order[at]] == sb[free]
    place = free[there]
    offset = order[at[there]] - place
    shift = 2 * p.min_words * (1 / p.threshold - 1)  # words; with more between them, similar sides are long enough alone
    k = np.searchsorted(offsets, offset)
    near = np.minimum(np.abs(offset - offsets[np.maximum(k - 1, 0)]), np.abs(offset - offsets[np.minimum(k, len(offsets) - 1)])) <= shift
    place, offset = place[near], offset[near]
    if not len(place):
        return []
    cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(offset) != 0)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(place)]]) - 1
    return list(zip(place[first].tolist(), (place[last] + 1).tolist(), offset[first].tolist()))


def _chains(runs: list[tuple[int, int, int]], p: SubstringParams) -> list[list[tuple[int, int, int]]]:
    """Chains of runs, in order on both sides, of which enough places agree; those with most first.

    Runs follow one another within a gap: with more words between them, similar
    sides are long enough alone.
    """
    need = p.threshold / (1 + p.threshold)  # of both sides' places together
    x, y, offset = np.array(sorted(runs, key=lambda r: (r[1], r[0], r[2])), np.int64).T
    gap = int(2 * p.min_words * (1 / p.threshold - 1))
    lows = np.searchsorted(y, x - gap)
    start, astart, matched = x.copy(), x + offset, y - x
    before, begin, last = np.full(len(runs), -1), x.copy(), np.ones(len(runs), bool)
    for k in np.flatnonzero(lows < np.arange(len(runs))).tolist():
        low = lows[k]
        own = np.maximum(x[k], np.maximum(y[low:k], y[low:k] + offset[low:k] - offset[k]))  # a run begins after the one before it on both sides
        total = matched[low:k] + y[k] - own
        fits = (own < y[k]) & (total > matched[k]) & (total >= need * (y[k] - start[low:k] + y[k] + offset[k] - astart[low:k]))
        if fits.any():
            q = int(np.argmax(np.where(fits, total, -1)))
            before[k], begin[k], start[k], astart[k], matched[k] = q + low, own[q], start[q + low], astart[q + low], total[q]
            last[q + low] = False
    ends = np.flatnonzero(last & (y - start >= p.width) & (y + offset - astart >= p.width) & (before >= 0))
    out = []
    for k in ends[np.argsort(-matched[ends], kind="stable")].tolist():
        chain = []
        while k >= 0:
            chain.append((int(begin[k]), int(y[k]), int(offset[k])))
            k = int(before[k])
        out.append(chain[::-1])
    return out


def passages(sa: np.ndarray, sb: np.ndarray, offsets: list[int], p: SubstringParams, order: np.ndarray | None = None) -> set[tuple[int, int, int, int]]:
    """Places (in b, in a) of similar passages near the offsets: long runs, and chains of runs.

    An offset adds the runs that hold a place which no long run covers on both
    sides, so that texts that repeat themselves cost little for each of their many
    offsets.
    """
    out: set[tuple[int, int, int, int]] = set()
    if min(len(sa), len(sb)) < p.width or not offsets:
        return out
    runs, matched, free = [], 0, np.ones(len(sb), bool)
    seen = np.zeros(len(sa), bool), np.zeros(len(sb), bool)
    for offset in sorted(offsets, key=abs):
        first, last = _runs(sa, sb, offset, seen)
        for x, y in zip(first.tolist(), last.tolist()):
            runs.append((x, y, offset))
            matched += y - x
            free[x:y] = False
            if y - x >= p.width:
                out.add((x, y, x + offset, y + offset))
                seen[0][x + offset : y + offset] = True
                seen[1][x:y] = True
    free = np.flatnonzero(free)
    if len(free):
        more = _near(sa, sb, np.argsort(sa, kind="stable") if order is None else order, np.array(sorted(offsets)), free, p)
        out.update((x, y, x + offset, y + offset) for x, y, offset in more if y - x >= p.width)
        runs += more
        matched += sum(y - x for x, y, _ in more)
    # similar sides have at least this many places in common
    if len(runs) > 1 and matched >= 2 * p.width * p.threshold / (1 + p.threshold):
        for chain in _chains(runs, p):
            (x, _, offset), (_, y, end) = chain[0], chain[-1]
            if not (seen[1][x:y].all() and seen[0][x + offset : y + end].all()):
                found = _parts(sa, sb, chain, p)
                out.update(found)
                for x, y, ax, ay in found:
                    seen[1][x:y] = seen[0][ax:ay] = True
    return out


def _verified(documents: DataFrame, pairs: DataFrame, p: SubstringParams) -> DataFrame:
    """(key, begin, end, cut) in words, not merged; `documents` (key, text) has each key once."""
    many = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(many, "a").withColumn("salts", F.ceil(F.col("n") / p.members).cast("int")).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    members = dealt.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("key"), "late", "offsets")
    heads = dealt.groupBy("a", "salt").agg(F.lit(0).alias("role")).select("a", "salt", "role", F.col("a").alias("key"), F.lit(False).alias("late"), F.array().cast("array<bigint>").alias("offsets"))
    sides = members.union(heads)
    wanted = common.small(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), p.broadcast_rows)
    texts = documents.join(wanted, "key", "left_semi")
    tasks = sides.join(texts, "key").repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        head, order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in common.slices(iter([batch])):
                h, _, _, bounds = common.words(*common.text_arrays(part.column("text")))
                s, place = common.shingles(h, bounds, p.words)
                out: set[tuple[bytes, int, int, bool]] = set()
                for k, (a, salt, role, key, late, offsets) in enumerate(zip(*(part.column(c).to_pylist() for c in ("a", "salt", "role", "key", "late", "offsets")))):
                    own = s[place[k] : place[k + 1]]
                    if role == 0:
                        at, head = (a, salt), own.copy()
                        order = np.argsort(head, kind="stable")
                    elif (a, salt) == at:
                        for x, y, ax, ay in passages(head, own, offsets, p, order):
                            out.add((key, x, y + p.words - 1, late))
                            out.add((a, ax, ay + p.words - 1, not late))
                rows = list(zip(*out)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.binary(), pa.int64(), pa.int64(), pa.bool_()))], ["key", "begin", "end", "cut"])

    return tasks.select("a", "salt", "role", "key", "late", "offsets", "text").mapInArrow(run, "key binary, begin long, end long, cut boolean").distinct()


def _merged(spans: DataFrame, *by: str) -> DataFrame:
    """Spans that overlap or touch become one."""
    order = Window.partitionBy(*by).orderBy("begin", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("reach", reach).withColumn("group", F.sum((F.coalesce("reach", F.lit(-1)) < F.col("begin")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "group").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("group")


def _repeats(documents: DataFrame, p: SubstringParams) -> DataFrame:
    """doc_id, key of the row's content, begin, end, cut for every repeated passage of every document (doc_id, text)."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = min(p.max_segments, 1 << max(4, (size // p.segment_bytes).bit_length()))
    known = digests(documents)
    rows = known.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    classes = known.where(f"n_words >= {p.min_words}").groupBy("digest").agg(first, F.count("*").alias("copies"), F.first("n_words").alias("n_words"))
    classes = common.write_shared(classes.select("digest", F.col("first.key").alias("key"), "copies", "n_words"), rows=rows)
    # one row stands for its copies: the others, and rows that repeat it entirely, do not search
    copies = known.where(f"n_words >= {p.min_words}").select("key", "digest").join(classes.where("copies > 1").select("digest", F.col("key").alias("head")), "digest")
    odd = copies.groupBy("key").agg(F.bool_or(F.col("key") == F.col("head")).alias("_head"), F.count("*").alias("_rows")).where("NOT _head OR _rows > 1")
    odd = common.small(odd.select(F.col("key").alias("_odd"), "_head"), p.broadcast_rows)
    keyed = documents.select(common.row_key().alias("key"), "text").join(odd, F.col("key") == F.col("_odd"), "left")
    single = keyed.where("_odd IS NULL").select("key", "text")
    if not odd.where("_head").isEmpty():
        single = single.union(keyed.where("_head").groupBy("key").agg(F.any_value("text").alias("text")))
    single = single.where(F.length("text") > 0)
    pairs = common.write_shared(_pairs(_packed(single, segments, p)), rows=rows)
    spans = common.write_shared(_verified(single, pairs.where("NOT odd"), p), rows=rows)
    settled = _merged(spans.select(F.col("key").alias("b"), "begin", "end"), "b")
    still = pairs.where("odd").join(settled, "b", "left").groupBy("a", "b").agg(
        F.any_value("late").alias("late"), F.any_value("offsets").alias("offsets"), F.coalesce(F.bool_or((F.col("begin") <= F.col("low")) & (F.col("high") < F.col("end"))), F.lit(False)).alias("_done"))
    spans = spans.union(_verified(single, common.held(still.where("NOT _done").drop("_done")), p)).join(classes.select("key", "digest"), "key")
    spans = _merged(spans.select("digest", "cut", "begin", "end"), "digest", "cut")
    # a copy's whole text is a span: to be cut but in the first
    near = known.join(spans, "digest").select("doc_id", "key", "begin", "end", "cut")
    whole = known.join(classes.where("copies > 1").select("digest", F.col("key").alias("head")), "digest").select("doc_id", "key", F.lit(0).cast("long").alias("begin"), F.col("n_words").alias("end"), (F.col("key") != F.col("head")).alias("cut"))
    return near.union(whole).distinct()


def find_repeats(documents: DataFrame, p: SubstringParams = SubstringParams()) -> DataFrame:
    """doc_id, begin_word, end_word, cut for every repeated passage of every document."""
    return _repeats(documents.select("doc_id", "text"), p).select("doc_id", F.col("begin").alias("begin_word"), F.col("end").alias("end_word"), "cut").distinct()


def cut_repeats(documents: DataFrame, p: SubstringParams = SubstringParams()) -> DataFrame:
    """All columns, with every passage gone from the texts that an earlier holder has; n_chars, if any, is counted anew.

    A passage goes from its first word to the one after its last. Rows that repeat
    each other entirely are one holder and all keep their text.
    """
    spans = _repeats(documents.select("doc_id", "text"), p).where("cut").groupBy(F.col("key").alias("_cut_key"))
    spans = common.small(spans.agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("_spans")), p.broadcast_rows)
    plain, names = common.renamed(documents)
    at = dict(zip(documents.columns, names))
    rows = plain.withColumn("_key", common.row_key(at["doc_id"], at["text"])).join(spans, F.col("_key") == F.col("_cut_key"), "left")
    text = at["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, text):
            data, offsets = common.text_arrays(part.column(text))
            _, first, _, bounds = common.words(data, offsets)
            out = part.column(text).to_pylist()
            for d, spans in enumerate(part.column("_spans").to_pylist()):
                if spans and out[d] is not None:
                    keep = np.ones(offsets[d + 1] - offsets[d], bool)
                    starts = np.append(first[bounds[d] : bounds[d + 1]], offsets[d + 1]) - offsets[d]
                    for x in spans:
                        keep[starts[x["begin"]] : starts[x["end"]]] = False
                    out[d] = data[offsets[d] : offsets[d + 1]][keep].tobytes().decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else part.column(c) for c in names], list(names))

    done = rows.select(*names, "_spans").mapInArrow(run, plain.schema)
    if "n_chars" in at:
        kind = documents.schema["n_chars"].dataType
        done = done.withColumn(at["n_chars"], F.when(F.col(text).isNull(), F.col(at["n_chars"])).otherwise(F.length(text)).cast(kind))
    return done.select(*names).toDF(*documents.columns)


def op4_substrings(spark: SparkSession, sf_dir: str, params: SubstringParams = SubstringParams()) -> DataFrame:
    """Every passage of at least 50 words that repeats across documents."""
    return find_repeats(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"), params)
