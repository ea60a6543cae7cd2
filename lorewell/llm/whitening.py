"""Embedding whitening by TSQR: no covariance is ever formed.

Entries become whole numbers (256 to the unit), so sums over any number of rows
are exact and every row is centred by them without rounding drift. Each distinct
vector counts once. A partition of centred rows is reduced to the triangle of its
QR decomposition, a block of rows at a time; triangles are merged in a tree, and
the singular values and right vectors of the last one are those of all rows. A
projection on a right vector, over the root of its eigenvalue, is white.

What a task holds is one block of rows and one triangle, dimension x dimension;
the driver gets one triangle and one sum for each dimension.

Edge cases: a null vector, or one with an entry that is null, not finite or not
within 2**53 once scaled, is left out; a shorter vector than the longest reads as
if zeros followed; repeated vectors are fitted once and all whitened; a component
without variance (beyond rounding) is not returned, so one distinct vector, or
none, gives no row; a deviation beyond a long is null; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.llm import common

#: Steps to the unit.
SCALE = 256
_LIMIT = float(1 << 53)
#: Rows of a block that is decomposed at once; fewer where vectors are long.
BLOCK_VALUES = 1 << 18


@dataclass(frozen=True)
class WhiteningParams:
    components: int = 4
    #: Triangles that a merging task takes from each level of the tree, about.
    fan_in: int = 32


@dataclass(frozen=True)
class WhiteningModel:
    """Exact sums over n distinct vectors, unit right vectors (rows) and their eigenvalues, falling, and the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def quantised(embeddings: DataFrame, column: str = "embedding", out: str = "x") -> DataFrame:
    """The rows with a whole and finite vector, and it in steps as `out`, without the zeros at its end: vectors that differ in those alone are one."""
    scaled = F.transform(F.col(column), lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    filled = F.coalesce(F.array_max(F.transform(scaled, lambda c, k: F.when(c != 0, k + 1))), F.lit(0))
    fine = F.forall(F.col(column), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < _LIMIT))
    return embeddings.where(F.col(column).isNotNull()).where(fine).withColumn(out, F.slice(scaled, F.lit(1), filled))


def _rows(column: pa.Array, size: int) -> np.ndarray:
    """int64 rows, zeros behind shorter vectors."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), size), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _sums(x: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sums of each dimension; halves of 32 bits, so that no partial sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            size = max(len(high), pa.compute.max(pa.compute.list_value_length(b.column(0))).as_py())
            own = _rows(b.column(0), size)
            high, low = np.pad(high, (0, size - len(high))) + (own >> 32).sum(0), np.pad(low, (0, size - len(low))) + (own & 0xFFFFFFFF).sum(0)
            n += b.num_rows
        if n:  # at -1 the rows themselves
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(high), dtype=np.int64)), pa.array(np.concatenate([[0], high])), pa.array(np.concatenate([[n], low]))], ["d", "high", "low"])

    wide = x.select("x").mapInArrow(run, "d long, high long, low long").groupBy("d").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    found = {r.d: (int(r.high) << 32) + int(r.low) for r in wide.collect()}  # one row for each dimension
    return found.get(-1, 0), [found[k] for k in range(len(found) - 1)]


def centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """rows - sums / n: the whole part of the mean is taken off exactly, then the fraction."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])
    return (rows - whole).astype(np.float64) - rest


def _folded(triangle: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block if triangle is None else np.vstack([triangle, block]), mode="r")


def _packed(number: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([r.astype(np.float64).tobytes()], pa.binary())], ["number", "r"])


def triangle(x: DataFrame, n: int, sums: list[int], fan_in: int = 32) -> np.ndarray:
    """The R factor of the centred rows: by partition, then merged in a tree."""
    d = len(sums)

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, step = None, max(d, BLOCK_VALUES // d)
        for b in batches:
            for k in range(0, b.num_rows, step):
                r = _folded(r, centred(_rows(b.column(0).slice(k, step), d), n, sums))
        if r is not None:
            yield _packed(TaskContext.get().partitionId(), r)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = number = None
        for b in batches:
            for own, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r, number = _folded(r, np.frombuffer(blob).reshape(-1, d)), own
        if r is not None:
            yield _packed(number, r)

    level = common.write_shared(x.select("x").mapInArrow(leaf, "number long, r binary"))
    many = level.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
    while many > 1:
        many = -(-many // fan_in)
        level = level.withColumn("number", F.pmod("number", F.lit(many))).repartition(many, "number").mapInArrow(merge, "number long, r binary")
        if many > 1:
            level = common.write_shared(level)
    last = level.collect()  # one triangle
    return np.vstack([np.frombuffer(bytes(r.r)).reshape(-1, d) for r in last]) if last else np.zeros((0, d))


def fit(x: DataFrame, params: WhiteningParams = WhiteningParams()) -> WhiteningModel:
    """The model of the distinct vectors of `x`, a column of whole numbers."""
    n, sums = _sums(x)
    if not n or not sums:
        return WhiteningModel(n, sums, np.zeros((0, len(sums))), np.zeros(0), 0.0)
    _, singular, right = np.linalg.svd(triangle(x, n, sums, params.fan_in), full_matrices=False)
    values = singular**2 / n
    kept = singular > singular[0] * np.finfo(float).eps * max(n, len(sums)) ** 0.5 * 8 if singular[0] > 0 else np.zeros(len(singular), bool)
    return WhiteningModel(n, sums, right[kept][: params.components], values[kept][: params.components], float(values.sum()))


def project(rows: DataFrame, model: WhiteningModel, x: str = "x", out: tuple[str, str] = ("whitened", "deviation")) -> DataFrame:
    """The rows with an array of their white coordinates, and the exact sum over dimensions of (n * x - sums)^2."""
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(out[0], T.ArrayType(T.DoubleType())), T.StructField(out[1], T.LongType())])
    n, sums, d, many = model.n, model.sums, len(model.sums), len(model.values)
    # vectors are as long as the dimension, so the model is bounded by components x dimension
    turn = (model.vectors / np.sqrt(model.values)[:, None]).T if many else np.zeros((d, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_VALUES // max(1, d))
        for whole in batches:
            for b in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
                own = _rows(b.column(names.index(x)), d)
                white = centred(own, n, sums) @ turn
                most = n * (int(np.abs(own).max()) if own.size else 0) + max(map(abs, sums), default=0)
                if most * most * max(1, d) < 1 << 63:
                    deviation = ((n * own - np.array(sums, np.int64)) ** 2).sum(1).tolist()
                else:
                    deviation = [t if t < 1 << 63 else None for t in (sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in own.tolist())]
                coordinates = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * many), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, coordinates, pa.array(deviation, pa.int64())], [*names, *out])

    return rows.mapInArrow(run, schema)


def identity_error(distinct: DataFrame, model: WhiteningModel) -> float:
    """The largest entry by size of the white coordinates' covariance over the distinct vectors, less the identity."""
    many = len(model.values)
    white = project(distinct.select("x"), model).select(*(F.col("whitened")[k].alias(f"w{k}") for k in range(many)))
    pairs = [(a, b) for a in range(many) for b in range(a, many)]
    got = white.agg(*(F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs)).first() if pairs else []
    return max((abs(v - (a == b)) for v, (a, b) in zip(got, pairs)), default=0.0)


@dataclass(frozen=True)
class Whitened:
    """`rows`: those with a whole vector, with `whitened` and `deviation`; the model; and how far from white the fit is."""

    rows: DataFrame
    model: WhiteningModel
    error: float


def whiten(embeddings: DataFrame, column: str = "embedding", params: WhiteningParams = WhiteningParams()) -> Whitened:
    """All rows with a whole vector in white coordinates of the distinct ones."""
    names = common.free_names(("x", "whitened", "deviation"), embeddings.columns)
    rows = quantised(embeddings, column, names[0])
    # copies meet before the shuffle; the table is read for sums, triangles and the error
    distinct = common.write_shared(rows.select(F.col(names[0]).alias("x")).distinct())
    model = fit(distinct, params)
    return Whitened(project(rows, model, names[0], tuple(names[1:])).drop(names[0]), model, identity_error(distinct, model))


def op12_whitening(spark: SparkSession, sf_dir: str, params: WhiteningParams = WhiteningParams()) -> DataFrame:
    """Every row with a whole vector and each of its first components."""
    done = whiten(common.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), params=params)
    shares = [float(v / done.model.trace) for v in done.model.values]
    return done.rows.select("vec_id", "deviation", F.posexplode("whitened").alias("_k", "whitened")).select(
        "vec_id", (F.col("_k") + 1).cast("int").alias("component"), F.lit(done.model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("_k")).alias("explained"), F.lit(done.error).cast("double").alias("identity_error"),
    )
