"""LM scoring: a log-frequency Bloom filter of quantised n-gram counts.

1. One pass packs the documents into blocks of `block_bytes` of text: the hashes
   of a block's distinct tokens and its tokens as numbers into them. The packed
   table is written to the shared folder; every later step reads it, not the text.
2. Each block sums its own tokens, pairs and triples and sends them, packed by
   hash segment, through one shuffle; a segment adds up exact counts over all
   blocks. Segments grow with the corpus, up to `max_segments`.
3. Each segment writes its pairs and triples into its own slice of the filter: a
   count c is held as 1 + floor(log2 c) entries (n-gram, 1), (n-gram, 2), and so
   on. A slice is as large as its entries ask, so every n-gram that was seen, be
   it once, is in at every size of the corpus.
4. While no filter of the corpus can exceed `broadcast_bytes`, the slices are
   broadcast and every block probes them. Beyond that a slice stays where it was
   made and is probed there for the blocks that sent it n-grams; the levels
   return to the blocks. Both ways ask the same bits: (n-gram, 1) first and on
   while the answer is yes.
5. Scoring interpolates: a token's exact count with `add` to all counts, as in the
   base score, then the pair with it and the triple with that, each with `backoff`
   counts' weight on the shorter one.

A token is identified by a 64-bit hash, an n-gram in a slice by the 40 bits that
follow those of its segment.

Edge cases: a null or empty text is its end token alone; a null doc_id is in no
fold and is learnt from; repeated rows are learnt from and scored each; without
training rows every count is 0 and the scores are those of the smoothing alone;
an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import common

_END = 0xC2B2AE3D27D4EB4F  # the hash of the end token
_STEP = np.uint64(0x9FB21C651E98DF25)
PAIRS, TRIPLES = 2, 3


@dataclass(frozen=True)
class LanguageModelParams:
    block_bytes: int = 8 << 20
    segment_bytes: int = 4 << 20
    max_segments: int = 1 << 20
    #: Bits of a slice that a task fills at once; a larger slice is filled and probed in pieces.
    max_filter_bits: int = 1 << 28
    #: A filter that is surely no larger is broadcast.
    broadcast_bytes: int = 16 << 20
    bits_per_entry: int = 12
    probes: int = 4
    #: Weight of the shorter n-gram's estimate against a context's count.
    backoff: float = 5.0
    add: float = 0.1


def pack(documents: DataFrame, train: Column, p: LanguageModelParams) -> DataFrame:
    """Blocks of documents as token numbers, one row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        flags: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal made
            h = np.concatenate(tokens)
            value, back, count = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")  # small numbers for frequent tokens: they compress
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            number = place[back].astype("<u4").view(np.uint8).reshape(-1, 4)
            row = [
                pa.array([(task << 24) | made]), _list(pa.concat_arrays(ids)), _list(pa.array(np.concatenate(flags))), _list(pa.array(np.concatenate(lengths))),
                pa.array([value[order].tobytes()], pa.binary()), pa.array([np.ascontiguousarray(number.T).tobytes()], pa.binary()),
            ]
            made += 1
            return pa.RecordBatch.from_arrays(row, ["block", "ids", "train", "lengths", "hashes", "numbers"])

        for part in common.slices(batches):
            data, offsets = common.text_arrays(part.column("text"))
            h, _, _, bounds = common.words(data, offsets, common.VISIBLE)
            with_end = np.full(len(h) + part.num_rows, _END, np.uint64)
            with_end[np.arange(len(h)) + common.owners(bounds)] = h
            tokens.append(with_end)
            lengths.append(np.diff(bounds) + 1)
            flags.append(part.column("train").to_numpy(zero_copy_only=False))
            ids.append(part.column("doc_id").cast(pa.int64()))
            size += len(data) + part.num_rows
            if size >= p.block_bytes:
                yield block()
                ids, flags, lengths, tokens, size = [], [], [], [], 0
        if tokens:
            yield block()

    schema = "block long, ids array<long>, train array<boolean>, lengths array<long>, hashes binary, numbers binary"
    return common.write_shared(documents.select("doc_id", "text", train.alias("train")).mapInArrow(run, schema), compression="zstd")


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _unpack(hashes: bytes, numbers: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(numbers, np.uint8).reshape(4, -1)
    return np.frombuffer(hashes, np.uint64), np.ascontiguousarray(planes.T).view("<u4").ravel()


def _squeeze(sorted_values: np.ndarray) -> bytes:
    """Ascending 40-bit values as byte planes of their steps: the upper planes are nearly all zero."""
    steps = np.diff(sorted_values, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def _expand(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(5, -1).T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _grams(token: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and triples that end at each token; before a text stand ends."""
    starts = np.cumsum(lengths) - lengths

    def before(x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[starts] = _END
        return out

    one = before(token)
    pair = common.mix(one * _STEP + token)
    return pair, common.mix(before(one) * np.uint64(0xA0761D6478BD642F) + pair)


class Segments:
    """A power of two of ranges of hashes: a segment is a hash's leading bits."""

    def __init__(self, n: int) -> None:
        self.n, self.bits = n, n.bit_length() - 1

    def cut(self, sorted_hashes: np.ndarray) -> np.ndarray:
        """Where each segment begins."""
        own = (sorted_hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(sorted_hashes), np.int64)
        return np.searchsorted(own, np.arange(self.n + 1))

    def rest(self, hashes: np.ndarray) -> np.ndarray:
        """The 40 bits that follow the segment's."""
        return (hashes << np.uint64(self.bits)) >> np.uint64(24)


def segments_for(size: int, p: LanguageModelParams) -> int:
    return min(p.max_segments, 1 << max(4, (size // p.segment_bytes).bit_length()))


def fits(size: int, rows: int, p: LanguageModelParams) -> bool:
    """Whether the filter of a corpus of so many bytes and rows is surely within the broadcast bound.

    A token needs a byte and a space, or ends a text; an n-gram of count c has at most c entries.
    """
    return 2 * (size // 2 + 2 * rows) * p.bits_per_entry // 8 <= p.broadcast_bytes


def count(blocks: DataFrame, segments: int, spread: bool, p: LanguageModelParams = LanguageModelParams()) -> DataFrame:
    """By kind (n-gram length) and segment: what returns to each block, exact counts of tokens and levels of the others,
    and a row without block for the segment: tokens, types, and with `spread` its slice of the filter."""
    of = Segments(segments)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, train, lengths, hashes, numbers = (batch.column(c)[k].as_py() for c in (0, 2, 3, 4, 5))
                value, number = _unpack(hashes, numbers)
                lengths = np.array(lengths)
                learn = np.repeat(np.array(train, bool), lengths)
                token = value[number]
                order = np.argsort(value)
                yield from packed(1, block, value[order], np.bincount(number[learn], minlength=len(value))[order])
                for kind, all_grams in zip((PAIRS, TRIPLES), _grams(token, lengths)):
                    gram, back = np.unique(all_grams[learn] if spread else all_grams, return_inverse=True)
                    yield from packed(kind, block, gram, np.bincount(back if spread else back[learn], minlength=len(gram)))

    def packed(kind: int, block: int, gram: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = of.cut(gram)
        some = np.flatnonzero(np.diff(at))
        if not len(some):
            return
        low, n = of.rest(gram), n.astype(np.uint32)
        grams, counts = [], []
        for s in some:
            a, b = at[s], at[s + 1]
            grams.append(gram[a:b].tobytes() if kind == 1 else _squeeze(low[a:b]))
            odd = np.flatnonzero(n[a:b] != 1).astype(np.uint32)  # nearly all counts are 1
            counts.append(odd.tobytes() + n[a:b][odd].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(some), pa.int32()), pa.array(some.astype(np.int64)), pa.array([block] * len(some), pa.int64()), pa.array(grams, pa.binary()), pa.array(counts, pa.binary())],
            ["kind", "segment", "block", "grams", "counts"],
        )

    def add(table: pa.Table) -> pa.Table:
        kind, segment = table.column("kind")[0].as_py(), table.column("segment")[0].as_py()
        block, parts, counts = table.column("block").to_pylist(), [], []
        for raw, odd in zip(table.column("grams").to_pylist(), table.column("counts").to_pylist()):
            parts.append(np.frombuffer(raw, np.uint64) if kind == 1 else _expand(raw))
            n = np.ones(len(parts[-1]), np.uint32)
            half = len(odd) // 2
            n[np.frombuffer(odd[:half], np.uint32)] = np.frombuffer(odd[half:], np.uint32)
            counts.append(n)
        gram, back = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(back, np.concatenate(counts).astype(np.float64)).astype(np.int64)
        ends = np.cumsum([len(x) for x in parts])
        own = [back[e - len(x) : e] for x, e in zip(parts, ends)]
        bits = None
        if kind == 1:
            payload = [total[x].astype("<i8").tobytes() for x in own]
        elif spread:
            block, payload, bits = [], [], filled(gram, levels(total), p).tobytes()
        else:
            level = probed(gram, levels(total), p).astype(np.uint8)
            payload = [level[x].tobytes() for x in own]
        m = len(payload)
        return pa.table({
            "kind": pa.array([kind] * (m + 1), pa.int32()), "segment": pa.array([segment] * (m + 1), pa.int64()), "block": pa.array([*block, None], pa.int64()),
            "payload": pa.array([*payload, bits], pa.binary()),
            "tokens": pa.array([*[None] * m, int(total.sum())], pa.int64()), "types": pa.array([*[None] * m, int((total > 0).sum())], pa.int64()),
        })

    sent = blocks.mapInArrow(send, "kind int, segment long, block long, grams binary, counts binary")
    return common.write_shared(sent.groupBy("kind", "segment").applyInArrow(add, "kind int, segment long, block long, payload binary, tokens long, types long"), compression="zstd")


def levels(total: np.ndarray) -> np.ndarray:
    """1 + floor(log2) of a count, 0 for none: how many entries it has."""
    return np.where(total > 0, np.frexp(total.astype(np.float64))[1], 0)


def value_of(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the geometric middle of its range, 1 for the first."""
    level = level.astype(np.float64)
    return np.where(level <= 1, level, 2.0 ** (level - 1) * 1.5**0.5)


def positions(gram: np.ndarray, level: int, size: int, probes: int) -> Iterator[np.ndarray]:
    """The bits of (n-gram, level) in a slice of `size` bits."""
    a = common.mix(gram + np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    b = common.mix(a) | np.uint64(1)
    for i in range(probes):
        yield ((a + np.uint64(i) * b) % np.uint64(size)).astype(np.int64)


def filled(gram: np.ndarray, held: np.ndarray, p: LanguageModelParams) -> np.ndarray:
    """A slice, eight bits a byte, with so many entries of each n-gram."""
    bits = np.zeros((p.bits_per_entry * int(held.sum()) // 8 + 1) * 8, bool)
    for j in range(1, int(held.max(initial=0)) + 1):
        for x in positions(gram[held >= j], j, len(bits), p.probes):
            bits[x] = True
    return np.packbits(bits, bitorder="little")


def level_of(bits: np.ndarray, gram: np.ndarray, probes: int) -> np.ndarray:
    """The largest level up to which every entry of an n-gram is in the slice."""
    out, todo, level = np.zeros(len(gram), np.int64), np.arange(len(gram)), 1
    while len(todo):
        yes = np.arange(len(todo))
        for at in positions(gram[todo], level, 8 * len(bits), probes):
            at = at[yes]
            yes = yes[(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
        todo = todo[yes]
        out[todo] = level
        level += 1
    return out


def probed(gram: np.ndarray, held: np.ndarray, p: LanguageModelParams) -> np.ndarray:
    """What a segment's slice answers for each of its n-grams; a large slice is filled and probed in pieces."""
    pieces = 1 + p.bits_per_entry * int(held.sum()) // p.max_filter_bits
    out = np.zeros(len(gram), np.int64)
    for piece in range(pieces):
        at = np.flatnonzero(gram % np.uint64(pieces) == piece) if pieces > 1 else np.arange(len(gram))
        if len(at):
            out[at] = level_of(filled(gram[at], held[at], p), gram[at], p.probes)
    return out


def score(blocks: DataFrame, counted: DataFrame, segments: int, spread: bool, p: LanguageModelParams) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every packed document."""
    row = counted.where("kind = 1 AND block IS NULL").agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    whole, kinds, add, backoff, of = float(row.n or 0), float(row.v or 0), p.add, p.backoff, Segments(segments)
    base = whole + add * (kinds + 1)
    answers = F.sort_array(F.collect_list(F.struct("kind", "segment", "payload"))).alias("answers")
    joined = blocks.join(counted.where("block IS NOT NULL").groupBy("block").agg(answers), "block")
    slices = None
    if spread:  # bounded by `fits`
        found = counted.where("kind > 1 AND block IS NULL").select("kind", "segment", "payload").collect()
        slices = blocks.sparkSession.sparkContext.broadcast({(r.kind, r.segment): bytes(r.payload) for r in found})

    def asked(kind: int, gram: np.ndarray) -> np.ndarray:
        """Levels of sorted n-grams from the broadcast slices."""
        at, out = of.cut(gram), np.zeros(len(gram), np.int64)
        for s in np.flatnonzero(np.diff(at)):
            if (kind, s) in slices.value:
                own = np.frombuffer(slices.value[kind, s], np.uint8)
                out[at[s] : at[s + 1]] = level_of(own, of.rest(gram[at[s] : at[s + 1]]), p.probes)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lengths, hashes, numbers, found = (batch.column(c)[k].as_py() for c in range(1, 5))
                own = {kind: [x["payload"] for x in found if x["kind"] == kind] for kind in (1, PAIRS, TRIPLES)}
                value, number = _unpack(hashes, numbers)
                lengths = np.array(lengths)
                starts = np.cumsum(lengths) - lengths
                exact = np.empty(len(value), np.int64)
                exact[np.argsort(value)] = np.frombuffer(b"".join(own[1]), "<i8")
                known, ends = exact[number], int(exact[value == _END][0])
                seen = []
                for kind, grams in zip((PAIRS, TRIPLES), _grams(value[number], lengths)):
                    gram, back = np.unique(grams, return_inverse=True)
                    level = asked(kind, gram) if spread else np.frombuffer(b"".join(own[kind]), np.uint8)
                    seen.append(value_of(level)[back])

                def context(x: np.ndarray, first: float) -> np.ndarray:
                    out = np.empty(len(x))
                    out[1:] = x[:-1]
                    out[starts] = first  # noqa: B023
                    return out

                chance = np.maximum(known + add, add) / base if base else np.ones(len(known))
                base_score = np.log10(chance)
                for n, of_context in ((seen[0], context(known, ends)), (seen[1], context(seen[0], ends))):
                    chance = (np.minimum(n, of_context) + backoff * chance) / (of_context + backoff)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[k].values, pa.array(lengths), pa.array(np.add.reduceat((known > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(base_score, starts)), pa.array(np.add.reduceat(np.log10(chance), starts))],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    scored = joined.select("ids", "lengths", "hashes", "numbers", "answers").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(row.n or 0).cast("long"))


def model_scores(documents: DataFrame, train: Column, p: LanguageModelParams = LanguageModelParams(), segments: int | None = None) -> DataFrame:
    """Learns from the documents where `train` holds and scores all of them."""
    size, rows = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    segments = segments or segments_for(size, p)
    spread = fits(size, rows, p)
    blocks = pack(documents, train, p)
    return score(blocks, count(blocks, segments, spread, p), segments, spread, p)


def op9_lm_score(spark: SparkSession, sf_dir: str, params: LanguageModelParams = LanguageModelParams()) -> DataFrame:
    """Scores all documents; rows with crc32(doc_id) mod 10 = 0 are held out of learning."""
    scored = model_scores(common.read_table(spark, sf_dir, "documents"), common.fold("doc_id", 10) != 0, params)
    return scored.select("doc_id", (common.fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", (F.col("score") / F.col("n_tokens")).alias("token_score"))
