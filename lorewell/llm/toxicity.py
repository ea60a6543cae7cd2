"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Each text becomes the set of its hashed features: words, pairs of neighbours
and pairs with one word between. Training passes over a bounded sample of the
labelled rows (`max_train_docs`, the rows with the smallest hash of their id) with a
learning rate for each coordinate and L1, which leaves few weights. The rows are
written once with all their features; an epoch is one task that streams them in one
order and holds the sums alone, which the next one reads first. The weights are the
only thing sent to the workers: at most 2**bits of them. Scoring is one pass over
the documents without any shuffle. Ids may be of any type.

Edge cases: a null or empty text has no feature and gets the score of the
intercept; a label of a missing document, a null label and a null doc_id are not
learnt from; a document labelled more than once counts with its largest label;
repeated rows are scored each, and of rows with the same doc_id one is learnt from; an empty table gives an empty result; without
labels every score is 0. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import common


@dataclass(frozen=True)
class ToxicityParams:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 1.0
    epochs: int = 3
    #: Bound on the labelled rows that are learnt from, those with the smallest hashes; each with all its features.
    max_train_docs: int = 20_000
    threshold: float = 0.3


@dataclass(frozen=True)
class ToxicityModel:
    """Sparse weights; what a worker holds is bounded by 2**bits entries."""

    index: np.ndarray
    weight: np.ndarray
    intercept: float
    bits: int


def _features(h: np.ndarray, bounds: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) arrays: words, neighbours, pairs over one word."""
    own = common.owners(bounds)
    shift = np.uint64(64 - bits)
    yield own, (h >> shift).astype(np.int64)
    for gap, seed in ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB)):
        if len(h) > gap:
            same = own[:-gap] == own[gap:]
            pair = common.mix(h[:-gap] * np.uint64(seed) + h[gap:])
            yield own[:-gap][same], (pair[same] >> shift).astype(np.int64)


class Ftrl:
    """Sums of gradients and of their squares for each coordinate and for the intercept."""

    def __init__(self, p: ToxicityParams, state: bytes | None = None) -> None:
        self.p = p
        both = np.zeros((2, (1 << p.bits) + 1)) if state is None else np.frombuffer(state).reshape(2, -1).copy()
        self.z, self.n = both  # the intercept comes last

    def state(self) -> bytes:
        return np.stack([self.z, self.n]).tobytes()

    def weights(self, idx: np.ndarray | slice = slice(None, -1)) -> np.ndarray:
        p, z, n = self.p, self.z[idx], self.n[idx]
        return np.where(np.abs(z) <= p.l1, 0.0, (np.sign(z) * p.l1 - z) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))

    def intercept(self) -> float:
        return float(-self.z[-1] / ((self.p.beta + self.n[-1] ** 0.5) / self.p.alpha))

    def learn(self, label: int, idx: np.ndarray) -> None:
        """One row of distinct features."""
        w, b = self.weights(idx), self.intercept()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        for at, weight in ((idx, w), (-1, b)):
            n = self.n[at]
            self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha * weight
            self.n[at] = n + g * g


def fit(documents: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Learns from the labelled rows of `labels` (doc_id, toxic), at most `max_train_docs` of them."""
    p = params
    key = F.col("doc_id").cast("string")
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(key.alias("k")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
        .orderBy(F.xxhash64("k"), "k").limit(p.max_train_docs)
    )
    rows = documents.select(key.alias("key"), "text").join(F.broadcast(sample), F.col("key") == F.col("k")).select("key", "label", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            h, _, _, bounds = common.words(*common.text_arrays(part.column("text")))
            both = np.unique(np.concatenate([own << p.bits | f for own, f in _features(h, bounds, p.bits)]))
            idx, starts = (both & ((1 << p.bits) - 1)).astype(np.int32), np.searchsorted(both >> p.bits, np.arange(part.num_rows + 1))
            blobs = [idx[a:b].tobytes() for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label").cast(pa.int32()), pa.array(blobs, pa.binary())], ["key", "label", "features"])

    # an id that repeats is learnt from once, so that rows are bounded as ids are
    encoded = rows.mapInArrow(encode, "key string, label int, features binary").groupBy("key", "label").agg(F.min("features").alias("features"))
    # as many rows as the bound allows fit two files
    stored = common.write_shared(encoded.coalesce(2)).select(F.lit(1).alias("kind"), F.xxhash64("key").alias("order"), "key", "label", "features")
    state: DataFrame | None = None
    for epoch in range(1, p.epochs + 1):  # each is one task that streams the rows in one order, behind the sums of the epoch before

        def learn(batches: Iterator[pa.RecordBatch], last: bool = epoch == p.epochs) -> Iterator[pa.RecordBatch]:
            model, seen = Ftrl(p), 0
            for b in batches:
                for kind, label, blob in zip(*(b.column(c).to_pylist() for c in range(3))):
                    if kind == 0:
                        model = Ftrl(p, blob)
                    else:
                        model.learn(label, np.frombuffer(blob, np.int32))
                        seen += 1
            if seen:
                weight = model.weights() if last else np.zeros(0)
                kept = np.flatnonzero(weight)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if last else model.state()], pa.binary()), pa.array([kept.astype(np.int32).tobytes()], pa.binary()), pa.array([weight[kept].astype(np.float32).tobytes()], pa.binary()), pa.array([model.intercept()])],
                    ["features", "idx", "w", "b"],
                )

        rows = stored if state is None else stored.unionByName(state)
        ordered = rows.coalesce(1).sortWithinPartitions("kind", "order", "key", "label").select("kind", "label", "features")
        told = ordered.mapInArrow(learn, "features binary, idx binary, w binary, b double")
        if epoch < p.epochs:
            state = common.write_shared(told.select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("order"), F.lit("").alias("key"), F.lit(0).alias("label"), "features"))
    got = told.select("idx", "w", "b").collect()  # one row of at most 8 * 2**bits bytes
    if not got:
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0, np.float32), -40.0, p.bits)
    return ToxicityModel(np.frombuffer(got[0].idx, np.int32), np.frombuffer(got[0].w, np.float32), got[0].b, p.bits)


def score(documents: DataFrame, model: ToxicityModel, columns: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`columns` of documents and the score (0 to 1) of each whole text, in one pass."""
    inputs = documents.select(*columns) if text in columns else documents.select(*columns, text)
    schema = documents.select(*columns).schema.add("score", "double")
    spread = documents.sparkSession.sparkContext.broadcast((model.index, model.weight, model.intercept, model.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight, intercept, bits = spread.value
        dense = np.zeros(1 << bits, np.float32)
        dense[index] = weight
        for part in common.slices(batches, text):
            h, _, _, bounds = common.words(*common.text_arrays(part.column(text)))
            total = np.full(part.num_rows, intercept)
            hits = []
            for own, f in _features(h, bounds, bits):
                some = np.flatnonzero(dense[f])
                hits.append(own[some] << bits | f[some])
            both = np.unique(np.concatenate(hits))
            np.add.at(total, both >> bits, dense[both & ((1 << bits) - 1)])
            out = 1 / (1 + np.exp(-np.clip(total, -60, 60)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(out)], [*columns, "score"])

    return inputs.mapInArrow(run, schema)


def remove_toxic(documents: DataFrame, model: ToxicityModel, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    plain, names = common.renamed(documents)
    scored = score(plain, model, names, names[documents.columns.index("text")])
    return scored.where(F.col("score") < params.threshold).select(*names).toDF(*documents.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Scores all documents; rows with crc32(doc_id) mod 4 = 2 are held out of learning."""
    documents = common.read_table(spark, sf_dir, "documents")
    labels = common.read_table(spark, sf_dir, "labels").select("doc_id", "toxic").where(common.fold("doc_id", 4) != 2)
    model = fit(documents, labels, params)
    return score(documents, model).select(
        "doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= params.threshold).cast("int").alias("predicted")
    )
