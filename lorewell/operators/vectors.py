"""Exact nearest neighbours over float arrays, as products of blocks in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.sources.shared import held

#: Question vectors that one pass compares; more take one pass for each block of so many.
BLOCK = 4096
#: Vectors that are compared at once.
ROWS = 2048


def scores(metric: str, rows: np.ndarray, questions: np.ndarray) -> np.ndarray:
    """(rows, questions): larger is nearer. Cosine, inner product, or the negative Euclidean distance."""
    if metric == "l2":
        square = (rows * rows).sum(1)[:, None] + (questions * questions).sum(1)[None, :] - 2 * (rows @ questions.T)
        i, j = np.nonzero(square < 1e-6 * ((rows * rows).sum(1)[:, None] + 1))  # where the difference of squares says little
        for at in range(0, len(i), 1 << 16):
            own, other = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            square[own, other] = ((rows[own] - questions[other]) ** 2).sum(1)
        return 0.0 - np.sqrt(np.maximum(square, 0.0))
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            rows, questions = (x / np.sqrt((x * x).sum(1))[:, None] for x in (rows, questions))
    return rows @ questions.T


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """float64 rows; a null or a vector of another length is all NaN."""
    out = np.full((len(column), size), np.nan)
    sizes = np.array([-1 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()])
    good = np.flatnonzero(sizes == size)
    if len(good) == len(column):
        out[:] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    else:
        for k in good:
            out[k] = column[int(k)].as_py()
    return out


def nearest(vectors: DataFrame, questions: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, doc_id, score, rank): the k nearest of `vectors` (doc_id, vec) for each question (query_id, qvec).

    The questions are a stated set, compared with all rows in place: a block of
    them is broadcast and multiplied with each batch, which sends on its k best for
    each question only. A vector without a comparable length is never near.
    """
    named = questions.select("query_id", "qvec")
    few = named.limit(BLOCK + 1).collect()  # one block, if that is all
    blocks = [few] if len(few) <= BLOCK else _blocks(named)
    kind = questions.schema["query_id"].dataType.simpleString()
    id_kind = vectors.schema["doc_id"].dataType.simpleString()
    parts = []
    for found in blocks:
        found = [r for r in found if r.qvec]
        for size in sorted({len(r.qvec) for r in found}):
            own = [r for r in found if len(r.qvec) == size]
            parts.append(_pass(vectors, [r.query_id for r in own], np.array([r.qvec for r in own], np.float64), k, metric, f"query_id {kind}, doc_id {id_kind}, score double"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, doc_id {id_kind}, score double, rank bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def _blocks(questions: DataFrame) -> Iterator[list]:
    """The questions in blocks of about BLOCK; they are dealt out once, and each block reads its own partition."""
    n = questions.count()
    dealt = held(questions.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(-(-n // BLOCK)))))
    for block in range(-(-n // BLOCK)):
        yield dealt.where(F.col("_block") == block).drop("_block").collect()  # about BLOCK rows


def best(value: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the k largest finite values are; of those equal to the last, the ones with the smallest ids."""
    fine = np.flatnonzero(np.isfinite(value))
    if len(fine) <= k:
        return fine
    last = np.partition(value[fine], len(fine) - k)[len(fine) - k]
    over, ties = fine[value[fine] > last], fine[value[fine] == last]
    return np.concatenate([over, ties[np.argsort(ids[ties], kind="stable")[: k - len(over)]]])


def _pass(vectors: DataFrame, ids: list, asked: np.ndarray, k: int, metric: str, schema: str) -> DataFrame:
    spread = vectors.sparkSession.sparkContext.broadcast((ids, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked_rows = spread.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                rows = matrix(part.column("vec"), asked_rows.shape[1])
                value = np.round(scores(metric, rows, asked_rows), 6)
                value = np.where(np.isnan(value), -np.inf, value)
                doc = part.column("doc_id").to_numpy(zero_copy_only=False)
                out: list[tuple[np.ndarray, np.ndarray]] = []
                for q in range(len(names)):
                    at = best(value[:, q], doc, k)
                    out.append((np.full(len(at), q), at))
                which, at = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in which], batch_kind(names)), pa.array(doc[at]), pa.array(value[at, which])], ["query_id", "doc_id", "score"])

    def batch_kind(names: list) -> pa.DataType | None:
        return pa.int64() if names and isinstance(names[0], int) else None

    return vectors.select("doc_id", "vec").mapInArrow(run, schema)
