"""Benchmark decontamination: an FM-index of each training shard answers phrase searches.

A shard is a slice of documents with a bounded number of bytes. Its words
become symbols of the phrases' vocabulary; stretches of the text that no phrase
can touch shrink to one separator, and each separator is a symbol of its own, so
suffixes differ at the latest there. The index is the Burrows-Wheeler transform
of that string, ranked by a wavelet matrix, and the text position of every
`sample` th row and of every row that follows a separator.

All phrases are searched backward at once, one word at a time from the end;
ranges that run empty leave. Occurrences are located by walking back to a
sampled row, and the spans of a document are merged by marking their ends.

There is no shuffle: each task indexes, searches and drops its own shards. What
is broadcast are the phrases, about `max_block_words` words of them. A larger
benchmark is searched in as many passes as it has blocks: each fetches and
broadcasts its own block, merges its spans with those found so far, and writes
them beside the texts to the shared folder for the next one. So driver, executors
and workers hold one block, however many there are.

Edge cases: a null or empty text has no words, no hit and is not contaminated
(n_words = n_hit = n_items = 0); a null or empty benchmark text yields no
phrase; an item of fewer words than the window is one phrase; phrases that occur
in several items count for each; an item_id that is null takes part in hits but
cannot be listed; repeated document rows are judged each; empty tables give an
empty result or no hits. Columns beside the id and the text pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.llm import common


@dataclass(frozen=True)
class DecontaminateParams:
    window: int = 13
    sample: int = 8
    shard_bytes: int = 4 << 20
    max_block_words: int = 1_000_000
    #: A document is contaminated if hit words times this reach its words.
    share: int = 20


class FmIndex:
    """Backward search and locate over a sequence of symbols from 1 up; 0 separates."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int) -> None:
        n = len(text) + 1
        gaps = np.append(text == 0, True)
        q = int(gaps.sum())
        # separators come first, each its own symbol; the last one ends the text
        rank = np.empty(n, np.int64)
        rank[gaps] = np.arange(q)
        rank[:-1][~gaps[:-1]] = text[~gaps[:-1]].astype(np.int64) + q
        order, span = self._sorted(rank)
        sa = order
        before = np.where(sa > 0, sa - 1, n - 1)
        symbols = np.append(text, 0).astype(np.int64)
        bwt = symbols[before]
        self.n, self.sigma = n, sigma
        counts = np.bincount(symbols, minlength=sigma + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])  # rows before those of a symbol
        self.levels = max(1, int(sigma).bit_length())
        self.zeros: list[np.ndarray] = []
        row = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level & 1).astype(bool)
            ones = np.concatenate([[0], np.cumsum(~bit)]).astype(np.int32)
            self.zeros.append(ones)
            row = np.concatenate([row[~bit], row[bit]])
        self.bwt = bwt
        self.sampled = (bwt == 0) | (sa % sample == 0)
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    @staticmethod
    def _sorted(rank: np.ndarray) -> tuple[np.ndarray, int]:
        """Suffix order by prefix doubling; only suffixes that still tie are sorted again."""
        n = len(rank)
        order = np.argsort(rank, kind="stable")
        value = rank[order]
        new = np.concatenate([[True], value[1:] != value[:-1]])
        place = np.empty(n, np.int64)
        place[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        span = 1
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # rows in groups of two or more
        while len(tied):
            at = order[tied]
            # what follows after `span` symbols; no tied suffix reaches the end, as separators differ
            key = place[at] * n + place[np.minimum(at + span, n - 1)]
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            order[tied] = at
            new = np.concatenate([[True], key[1:] != key[:-1]])
            place[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            tied = tied[~(new & np.append(new[1:], True))]
            span *= 2
        return order, span

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each row of the transform."""
        lo = np.zeros(len(symbol), np.int64)
        row = row.astype(np.int64)
        for zeros, level in zip(self.zeros, range(self.levels - 1, -1, -1)):
            one = (symbol >> level & 1).astype(bool)
            z_lo, z_row, z_all = zeros[lo], zeros[row], zeros[-1]
            lo = np.where(one, z_all + lo - z_lo, z_lo)
            row = np.where(one, z_all + row - z_row, z_row)
        return row - lo

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the phrases that occur: their number, first row and end row. A phrase fills a row of `phrases` from the left."""
        alive = np.arange(len(phrases))
        lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            going = lengths[alive] > step
            symbol = phrases[alive, np.maximum(lengths[alive] - 1 - step, 0)]
            a, b = self.first[symbol] + self.rank(symbol, lo), self.first[symbol] + self.rank(symbol, hi)
            lo, hi = np.where(going, a, lo), np.where(going, b, hi)
            left = lo < hi
            alive, lo, hi = alive[left], lo[left], hi[left]
        return alive, lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text position of each row, by steps back to a sampled one."""
        out, steps, todo = np.empty(len(row), np.int64), 0, np.arange(len(row))
        row = row.copy()
        while len(todo):
            done = self.sampled[row]
            out[todo[done]] = self.samples[self.sample_rank[row[done]]] + steps
            todo, row = todo[~done], row[~done]
            symbol = self.bwt[row]
            row = self.first[symbol] + self.rank(symbol, row)
            steps += 1
        return out


@dataclass(frozen=True)
class Phrases:
    """The distinct windows of a block of benchmark items, as symbols."""

    vocabulary: np.ndarray  # sorted word hashes; symbol = place + 1
    symbols: np.ndarray
    lengths: np.ndarray
    items: list[list[int]]  # of each window
    pairs: np.ndarray  # sorted neighbours that some window has
    single: np.ndarray  # symbols that are windows of one word

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]], window: int) -> Phrases:
        found: dict[bytes, set[int]] = {}
        for item, text in rows:
            raw = (text or "").encode()
            h, *_ = common.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            for i in range(max(1, len(h) - window + 1) if len(h) else 0):
                found.setdefault(h[i : i + window].tobytes(), set()).update([] if item is None else [item])
        hashes = [np.frombuffer(k, np.uint64) for k in found]
        vocabulary = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        lengths = np.array([len(x) for x in hashes], np.int64)
        symbols = np.zeros((len(hashes), max(1, int(lengths.max(initial=1)))), np.int64)
        for k, x in enumerate(hashes):
            symbols[k, : len(x)] = np.searchsorted(vocabulary, x) + 1
        a, b = symbols[:, :-1].ravel(), symbols[:, 1:].ravel()
        both = (a > 0) & (b > 0)
        return cls(vocabulary, symbols, lengths, [sorted(x) for x in found.values()], np.unique(a[both] * (len(vocabulary) + 1) + b[both]), np.unique(symbols[lengths == 1, 0]))

    def plain(self) -> tuple:
        return self.vocabulary, self.symbols, self.lengths, self.items, self.pairs, self.single


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def shard_hits(h: np.ndarray, bounds: np.ndarray, phrases: Phrases, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, phrase) of every occurrence in the shard."""
    none = np.zeros(0, np.int64)
    if not len(h) or not len(phrases.lengths):
        return none, none, none
    at = np.searchsorted(phrases.vocabulary, h)
    at[at == len(phrases.vocabulary)] = 0
    symbol = np.where(phrases.vocabulary[at] == h, at + 1, 0)
    own = common.owners(bounds)
    linked = np.zeros(len(h) + 1, bool)  # is the word before a neighbour that some phrase has
    linked[1:-1] = (own[1:] == own[:-1]) & (symbol[1:] > 0) & (symbol[:-1] > 0)
    near = np.flatnonzero(linked)
    linked[near] = _member(phrases.pairs, symbol[near - 1] * (len(phrases.vocabulary) + 1) + symbol[near])
    useful = np.flatnonzero(linked[:-1] | linked[1:] | _member(phrases.single, symbol))
    if not len(useful):
        return none, none, none
    gap = ~linked[useful]  # a separator stands before each stretch
    place = np.arange(len(useful)) + np.cumsum(gap)
    text, word = np.zeros(len(useful) + int(gap.sum()), np.int64), np.zeros(len(useful) + int(gap.sum()), np.int64)
    text[place], word[place] = symbol[useful], useful
    index = FmIndex(text, len(phrases.vocabulary), sample)
    which, lo, hi = index.search(phrases.symbols, phrases.lengths)
    many = hi - lo
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else none
    first = word[index.locate(rows)] if len(rows) else none
    phrase = np.repeat(which, many)
    return first, first + phrases.lengths[phrase], phrase


def _blocks(benchmark: DataFrame, p: DecontaminateParams) -> Iterator[tuple[Phrases, bool]]:
    """The phrases in blocks of about `max_block_words` words, each fetched when it is asked for, and whether it is the last."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // p.max_block_words))
    for k in range(n):
        yield Phrases.of([(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()], p.window), k == n - 1


def find_contamination(documents: DataFrame, benchmark: DataFrame, params: DecontaminateParams = DecontaminateParams(), columns: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`columns`, n_words, the merged hit spans [begin, end) in words, and the ids of the items that occur."""
    spark = documents.sparkSession
    carried = columns if text in columns else (*columns, text)
    found, written = documents.select(*carried), []
    for phrases, last in _blocks(benchmark, params):
        spread = spark.sparkContext.broadcast(phrases.plain())
        found = _pass(found, spread, params, columns if last else carried, text, former=bool(written))
        if not last:
            path = f"{common.shared_dir(spark)}/decontaminate-{uuid.uuid4().hex}"
            found = common.write_shared(found, path=path)
            spread.unpersist()
            if written:
                common._remove(spark, written[-1])  # the pass before has been read
            written.append(path)
    return found


def _pass(documents: DataFrame, spread: Broadcast, p: DecontaminateParams, columns: tuple[str, ...], text: str, former: bool) -> DataFrame:
    """`columns`, n_words, spans and items after a search for one block; with `former`, documents have the spans and items found so far."""
    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*documents.select(*columns).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("items", T.ArrayType(T.LongType()))])
    arrow_span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(*spread.value)
        for part in common.slices(batches, text, p.shard_bytes):
            h, _, _, bounds = common.words(*common.text_arrays(part.column(text)))
            open_at, items = np.zeros(len(h) + 1, np.int64), [set() for _ in range(part.num_rows)]
            if former:
                items = [set(x) for x in part.column("items").to_pylist()]
                for lead, spans in zip(bounds, part.column("spans").to_pylist()):
                    for x in spans:
                        open_at[lead + x["begin"]] += 1
                        open_at[lead + x["end"]] -= 1
            first, end, phrase = shard_hits(h, bounds, phrases, p.sample)
            np.add.at(open_at, first, 1)
            np.add.at(open_at, end, -1)
            doc = np.searchsorted(bounds, first, "right") - 1
            for d, k in np.unique(np.stack([doc, phrase], 1), axis=0) if len(doc) else ():
                items[d].update(phrases.items[k])
            hit = np.concatenate([[False], np.cumsum(open_at)[:-1] > 0, [False]])
            begin, finish = np.flatnonzero(hit[1:-1] & ~hit[:-2]), np.flatnonzero(hit[1:-1] & ~hit[2:]) + 1
            # a span that runs over the end of a text belongs to both texts
            cuts = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(h))]
            cuts = np.unique(cuts[hit[1:-1][cuts] & hit[1:-1][cuts - 1]]) if len(cuts) else cuts
            begin, finish = np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([finish, cuts]))
            at = np.searchsorted(begin, bounds)
            lead = np.repeat(bounds[:-1], np.diff(at))
            inner = pa.StructArray.from_arrays([pa.array(begin - lead), pa.array(finish - lead)], ["begin", "end"])
            spans = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), inner).cast(arrow_span)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in columns), pa.array(np.diff(bounds)), spans, pa.array([sorted(x) for x in items], pa.list_(pa.int64()))],
                names=[*columns, "n_words", "spans", "items"],
            )

    return documents.mapInArrow(run, schema)


def n_hit() -> Column:
    """Words inside the merged spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x.end - x.begin)


def contaminated(share: int) -> Column:
    return (n_hit() > 0) & (n_hit() * share >= F.col("n_words"))


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, params: DecontaminateParams = DecontaminateParams()) -> DataFrame:
    """The documents of which less than 1 / share is benchmark text, with all their columns."""
    plain, names = common.renamed(documents)
    found = find_contamination(plain, benchmark, params, names, names[documents.columns.index("text")])
    return found.where(~contaminated(params.share)).select(*names).toDF(*documents.columns)


def op7_decontaminate(spark: SparkSession, sf_dir: str, params: DecontaminateParams = DecontaminateParams()) -> DataFrame:
    """Judges every document against the whole benchmark."""
    found = find_contamination(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"), params)
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), contaminated(params.share).alias("contaminated"),
    )
