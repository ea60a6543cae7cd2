"""What the training-data operators share: input, tokens as arrays, lineage cuts.

Free-style operators receive Arrow batches and work on whole buffers with
numpy: a batch is tokenised without a Python loop over words, so a worker needs
a bounded multiple of the batch and the time goes to vector instructions.
Words are identified by a 64-bit hash; two different words share one with a
probability of about 5e-20 a pair.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions.text import let  # noqa: F401  for the operators
from lorewell.sources.shared import cut_lineage, held, marks, release, shared_dir  # noqa: F401  for the operators

#: Bytes of text that one vectorised step handles; bounds a worker's memory.
STEP_BYTES = 1 << 20
#: Bytes of an Arrow batch; rows beyond it begin the next, and a larger row is a batch of its own.
BATCH_BYTES = 8 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; also bounds what passes to a Python worker at once, which limits its memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column | str, n: int) -> Column:
    """crc32 of the key as text, mod n; a null key is in no fold (-1)."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string")) % n, F.lit(-1))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits of a row's content; null and empty differ."""
    part = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c).cast("string")))
    return F.unhex(F.md5(F.concat(part(doc_id), F.lit("\x00"), part(text))))


def write_shared(df: DataFrame, compression: str = "snappy", rows: int | None = None, path: str | None = None) -> DataFrame:
    """Writes a table to the shared folder, or to `path` in it, and reads it back, dealt out to files fit for about `rows` short rows if that is given.

    Smaller on disk than a checkpoint, as Parquet is compressed. The folder
    goes when the driver ends.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/lorewell-{uuid.uuid4().hex}"
    (df if rows is None else df.repartition(files_for(rows))).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path, compression=compression)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int) -> DataFrame:
    """The table, kept, and marked for broadcast if it is counted and within the limit."""
    kept = held(df)
    return F.broadcast(kept) if kept.count() <= limit else kept


def near(df: DataFrame, most: int, limit: int) -> DataFrame:
    """The table, marked for broadcast if the `most` rows that it can have are within the limit."""
    return F.broadcast(df) if most <= limit else df


def lookup(rows: DataFrame, table: DataFrame, key: str, limit: int, how: str = "left", most: int | None = None) -> DataFrame:
    """`rows` joined with `table`, which has one row for each key and in `n` how many rows have it.

    Broadcast while the table has at most `limit` rows; it is not counted if `most`,
    which it cannot exceed, is within. Beyond, keys of many rows are looked up by
    broadcast, of which there are at most `limit` by their share of all rows, and
    the others by shuffle: no task gets a hot key.
    """
    if most is not None and most <= limit:
        return rows.join(F.broadcast(table.drop("n")), key, how)
    kept = held(table)
    many, total = kept.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if many <= limit:
        return rows.join(F.broadcast(kept.drop("n")), key, how)
    hot = kept.where(F.col("n") > total // max(1, limit)).drop("n")
    rest = kept.where(F.col("n") <= total // max(1, limit)).drop("n")
    names = hot.select(F.col(key).alias("_hot"))
    often = rows.join(F.broadcast(hot), key)
    seldom = rows.join(F.broadcast(names), F.col(key) == F.col("_hot"), "left_anti").join(rest, key, how)
    return often.unionByName(seldom)


def files_for(rows: int) -> int:
    """Partitions of a table of so many short rows."""
    return max(3, rows // 100_000)


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if the session still runs."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has already ended
        pass


def byte_table(keep: Iterable[int], lower: bool = True) -> np.ndarray:
    """256 entries: 0 for a byte between words, else the byte, A-Z lower-cased."""
    table = np.zeros(256, np.uint8)
    for b in keep:
        table[b] = b + 32 if lower and 0x41 <= b <= 0x5A else b
    return table


#: Letters, digits and everything beyond ASCII, after A-Z are lower-cased.
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Everything but space and the controls 9 to 13.
VISIBLE = byte_table(set(range(1, 256)) - {0x20, 9, 10, 11, 12, 13})


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts have about `limit` bytes; a longer text is alone in its slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_arrays(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a uint64 over all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers.get(kind, ())) < n:
        steps = np.full(max(n, STEP_BYTES + 1), _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def _cut(data: np.ndarray, offsets: np.ndarray, a: int, b: int, table: np.ndarray) -> int:
    """A place near b, and after a, where no word is cut."""
    low = max(a, b - 4096)
    gaps = np.flatnonzero(table[data[low:b]] == 0)
    if len(gaps):
        return low + int(gaps[-1]) + 1
    k = int(np.searchsorted(offsets, b, "right"))
    if offsets[k - 1] > a:
        return int(offsets[k - 1])
    end = int(offsets[k]) if k < len(offsets) else len(data)
    while b < end:
        gaps = np.flatnonzero(table[data[b : b + STEP_BYTES]] == 0)
        if len(gaps):
            return min(end, b + int(gaps[0]))
        b += STEP_BYTES
    return end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word, and where each text's words begin."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + STEP_BYTES)
        b = b if b == n else _cut(data, offsets, a, b, table)
        w = table[data[a:b]]
        inside = w != 0
        inner = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")] - a
        edge = np.zeros(len(w) + 1, bool)
        edge[inner] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        sums = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w * _power("up", len(w)), out=sums[1:])
        h = (sums[last] - sums[first]) * _power("down", len(w) + 1)[first]
        parts.append((mix(h), first + a, last + a))
        a = b
    if not parts:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, np.zeros(len(offsets), np.int64)
    h, first, last = (np.concatenate(x) for x in zip(*parts))
    return h, first, last, np.searchsorted(first, offsets, "left")


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text of each item, from where each text's items begin."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


_STEPS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def joined(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on, without regard to texts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = h[:n] * _STEPS[0]
    for i in range(1, k):
        total += h[i : n + i] * _STEPS[i]
    return mix(total)


def shingles(h: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and where each text's begin; a shorter text, if not empty, is one shingle."""
    counts = np.diff(bounds)
    many = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(out_bounds[-1], np.uint64)
    full = np.flatnonzero(counts >= k)
    if len(full):
        every = joined(h, k)
        lengths = many[full]
        shift = np.repeat(bounds[full] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        source = np.arange(lengths.sum()) + shift
        target = source + np.repeat(out_bounds[full] - bounds[full], lengths)
        out[target] = every[source]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        own = h[bounds[d] : bounds[d + 1]]
        out[out_bounds[d]] = joined(own, len(own))[0]
    return out, out_bounds


def renamed(df: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """The same rows under names that cannot clash with an operator's own."""
    names = tuple(f"_c{i}" for i in range(len(df.columns)))
    return df.toDF(*names), names


def free_names(wanted: Iterable[str], taken: Iterable[str]) -> list[str]:
    """The wanted names, with underscores added where one is taken."""
    used, out = {x.lower() for x in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
