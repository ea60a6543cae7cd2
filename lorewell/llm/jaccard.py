"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

1. One pass gives each document the digest of its set of five-word shingles and
   the hashes of its MinHash bands. Bands and rows are the most selective pair
   that finds a pair at the threshold with the target recall.
2. Documents with equal sets collapse to one representative with a weight, so
   thousands of copies cost one row from here on.
3. Band hashes are shuffled; buckets of one row vanish and buckets with the same
   members count once. Each member's text is read and cut into its set once; the
   packed set then goes to the member's buckets. A bucket of more than `block`
   members, or `block_bytes` of sets, is dealt out as pairs of blocks, so no task
   holds a bucket and none is cut short.
4. A task verifies all pairs of its blocks at once, as products of 0/1 matrices
   over the full sets, in column stripes of bounded width. It emits one row for
   each member: how many documents it is linked to, and the smallest member that
   it is connected with. Pairs are never emitted. A pair that meets in several
   buckets is counted in the first.
5. A member's roots are linked with its smallest root; connected components of
   these few links are the near-duplicate classes.

Result: one row for each document with its class (the smallest doc_id in it) and
its number of links, i.e. other documents at the threshold or above.

Edge cases: a null text or one without words has no shingle, no link and a class
of its own; a text of fewer than five words is one shingle; equal rows are linked
like any copies; rows with a null doc_id take part, and name their class only if
it has no other id; an empty table gives an empty result; columns beside doc_id
and text pass through `deduplicate` untouched.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import common
from lorewell.llm.components import components, contract


@dataclass(frozen=True)
class JaccardParams:
    words: int = 5
    threshold: float = 0.8
    recall: float = 0.9995
    max_hashes: int = 128
    #: Members of a bucket that one side of a task holds, and bytes of their sets.
    block: int = 512
    block_bytes: int = 8 << 20
    #: Sides of at most so many rows are broadcast (some 200 bytes each at most); beyond, joins shuffle.
    broadcast_rows: int = 100_000
    stripe: int = 4096


def bands_and_rows(p: JaccardParams) -> tuple[int, int]:
    """The largest number of rows whose bands, within `max_hashes`, reach the target recall at the threshold."""
    best = (p.max_hashes, 1)
    for rows in range(1, p.max_hashes + 1):
        bands = math.ceil(math.log(1 - p.recall) / math.log1p(-(p.threshold**rows)))
        if bands * rows > p.max_hashes:
            break
        best = (bands, rows)
    return best


def sign(documents: DataFrame, p: JaccardParams, total: int) -> DataFrame:
    """doc_id, a key of the row, the digest of the shingle set (null: none), its size, and band hashes of the `total` documents."""
    bands, rows = bands_and_rows(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = common.mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64))
        times, plus = (seeds[: bands * rows] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[bands * rows :] >> np.uint64(32)).astype(np.uint32)
        for part in common.slices(batches):
            h, _, _, bounds = common.words(*common.text_arrays(part.column("text")))
            s, at = common.shingles(h, bounds, p.words)
            low = (s >> np.uint64(32)).astype(np.uint32)
            full = np.flatnonzero(np.diff(at))
            hashes = np.zeros((bands, len(full)), np.uint64)
            for b in range(bands):
                for r in range(b * rows, b * rows + rows):
                    least = np.minimum.reduceat(low * times[r] + plus[r], at[full]) if len(full) else np.zeros(0, np.uint32)
                    hashes[b] = common.mix(hashes[b] * np.uint64(0x9FB21C651E98DF25) + least + np.uint64(b + 1))
            sets = [np.unique(s[at[d] : at[d + 1]]) for d in full]
            digest, size, band = [None] * part.num_rows, np.zeros(part.num_rows, np.int64), [None] * part.num_rows
            for k, d in enumerate(full):
                digest[d], size[d], band[d] = hashlib.md5(sets[k].tobytes()).digest(), len(sets[k]), hashes[:, k].view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("key"), pa.array(digest, pa.binary()), pa.array(size), pa.array(band, pa.list_(pa.int64()))], ["doc_id", "key", "sid", "size", "bands"])

    rows_in = documents.select("doc_id", common.row_key().alias("key"), "text")
    return common.write_shared(rows_in.mapInArrow(run, "doc_id long, key binary, sid binary, size long, bands array<long>"), rows=total)


def representatives(signed: DataFrame, total: int) -> DataFrame:
    """One row for each distinct shingle set: the first row that has it and how many have it."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    found = signed.where("sid IS NOT NULL").groupBy("sid").agg(first, F.count("*").alias("weight"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"))
    return common.write_shared(found.select("sid", F.col("first.doc_id").alias("rep"), F.col("first.key").alias("key"), "weight", "size", "bands"), rows=total)


def members(reps: DataFrame, p: JaccardParams, sets: int) -> DataFrame:
    """(sid, key, weight, own): the sets that share a bucket, each with its buckets and the blocks that these are dealt out to."""
    rows = reps.select(F.explode("bands").alias("bucket"), "sid", "size")
    same = [F.bit_xor(F.xxhash64(F.lit(k), "sid")).alias(f"same{k}") for k in range(2)]  # buckets with the same members
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("total"), *same).where("n > 1")
    shared = shared.groupBy("n", "total", "same0", "same1").agg(F.min("bucket").alias("bucket"))
    blocks = F.greatest(F.ceil(F.col("n") / p.block), F.ceil(F.col("total") * 8 / p.block_bytes)).cast("int").alias("blocks")
    chosen = common.write_shared(shared.select("bucket", blocks), rows=sets)
    chosen = common.near(chosen, chosen.count(), p.broadcast_rows)
    own = rows.join(chosen, "bucket").groupBy("sid").agg(F.sort_array(F.collect_set(F.struct("bucket", "blocks"))).alias("own"))  # at most one for each band
    return common.write_shared(own.join(reps.select("sid", "key", "weight"), "sid"), rows=sets)


def deal(documents: DataFrame, known: DataFrame, p: JaccardParams) -> DataFrame:
    """(bucket, i, j, part, sid, weight, buckets, packed): each member's packed set for each task that it is in."""
    rows = documents.select(common.row_key().alias("key"), "text").join(known, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal out, size
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["bucket", "i", "j", "part", "sid", "weight", "buckets", "packed"])
            out, size = [], 0
            return made

        for part in common.slices(batches):
            h, _, _, bounds = common.words(*common.text_arrays(part.column("text")))
            s, place = common.shingles(h, bounds, p.words)
            for k, (sid, weight, own) in enumerate(zip(*(part.column(c).to_pylist() for c in ("sid", "weight", "own")))):
                packed = np.unique(s[place[k] : place[k + 1]]).tobytes()
                buckets = np.array([x["bucket"] for x in own], "<i8").tobytes()
                for x in own:
                    mine = int.from_bytes(sid[:8], "little") % x["blocks"]
                    for other in range(x["blocks"]):
                        out.append((x["bucket"], min(mine, other), max(mine, other), mine, sid, weight, buckets, packed))
                        size += len(packed)
                        if size > common.STEP_BYTES:
                            yield flush()
        if out:
            yield flush()

    schema = "bucket long, i int, j int, part int, sid binary, weight long, buckets binary, packed binary"
    return rows.select("sid", "weight", "own", "text").mapInArrow(run, schema)


def _overlaps(sets: list[np.ndarray], stripe: int) -> np.ndarray:
    """Sizes of all pairs' intersections; shingles that only one set has are left out."""
    m = len(sets)
    value, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(x) for x in sets])
    often = count[back] > 1
    number = np.cumsum(count > 1) - 1
    row, column = row[often], number[back[often]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((m, m), np.float32)
    for start in range(0, int((count > 1).sum()), stripe):
        a, b = np.searchsorted(column, [start, start + stripe])
        dense = np.zeros((m, stripe), np.float32)
        dense[row[a:b], column[a:b] - start] = 1
        out += dense @ dense.T
    return out


def verify(bucket: int, i: int, j: int, part: np.ndarray, sets: list[np.ndarray], weight: np.ndarray, buckets: list[np.ndarray], p: JaccardParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each member: has it a partner, the linked documents that count in this bucket, the place of the first member it is connected with."""
    m = len(sets)
    size = np.array([len(x) for x in sets], np.float64)
    both = _overlaps(sets, p.stripe)
    good = both >= p.threshold * (size[:, None] + size[None, :] - both) - 1e-6
    if i != j:
        good &= part[:, None] != part[None, :]
    np.fill_diagonal(good, False)
    some, root = good.any(1), np.arange(m)
    if not some.any():
        return some, np.zeros(m, np.int64), root
    while True:
        least = np.minimum(root, np.where(good, root[None, :], m).min(1))
        least = least[least]
        if (least == root).all():
            break
        root = least
    # pairs that share an earlier bucket count there
    earlier = _overlaps([x[x < bucket] for x in buckets], p.stripe)
    return some, (good & (earlier == 0)) @ weight, root


def link(documents: DataFrame, known: DataFrame, p: JaccardParams) -> DataFrame:
    """(sid, links, root): for each member of a task that has a partner there its links and the set it is connected with."""
    tasks = deal(documents, known, p).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at: tuple | None = None
        out: list[tuple] = []

        def close() -> None:
            nonlocal held
            if len(held) > 1:
                part, sid, weight, buckets, sets = zip(*held)
                some, links, root = verify(*at, np.array(part), list(sets), np.array(weight), list(buckets), p)
                out.extend((sid[k], int(links[k]), sid[root[k]]) for k in np.flatnonzero(some))
            held = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["sid", "links", "root"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(8)]
            for *key, part, sid, weight, buckets, packed in zip(*columns):
                if tuple(key) != at:
                    close()
                    at = tuple(key)
                if not held or held[-1][1] != sid:  # rows that repeat each other entirely bring a set twice
                    held.append((part, sid, weight, np.frombuffer(buckets, "<i8"), np.frombuffer(packed, np.uint64)))
            if len(out) > 10_000:
                yield flush()
                out = []
        close()
        yield flush()

    return tasks.mapInArrow(run, "sid binary, links long, root binary")


def classify(documents: DataFrame, p: JaccardParams = JaccardParams()) -> DataFrame:
    """doc_id, key, first (is this row's content the class's first), class_id, n_links for every document; written to the shared folder."""
    since = common.marks()
    total = documents.count()
    signed = sign(documents, p, total)
    reps = representatives(signed, total)
    sets = reps.count()
    known = members(reps, p, sets)
    many = known.count()
    few = lambda df: common.near(df, many, p.broadcast_rows)  # noqa: E731  for tables of at most a row for each of `known`
    stars = link(documents, few(known), p).groupBy("sid").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.collect_set("root").alias("roots"))  # a root for each task at most
    stars = common.write_shared(stars, rows=many)
    roots = components(contract(stars), broadcast_rows=p.broadcast_rows).withColumnRenamed("root", "top")
    near = stars.select("sid", "links", "root").join(few(roots), F.col("root") == F.col("node"), "left").select("sid", "links", F.coalesce("top", "root").alias("root"))
    near = common.write_shared(reps.select("sid", "rep", "key").join(few(near), "sid"), rows=many)
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("doc_id"), "key")).alias("first")
    heads = near.groupBy("root").agg(F.count("*").alias("n"), first).select("root", "n", F.col("first.doc_id").alias("class_id"), F.col("first.key").alias("head"))
    classes = common.lookup(near.select("sid", "links", "root"), heads, "root", p.broadcast_rows, most=many).drop("root")
    own = reps.select("sid", "rep", "key", "weight").withColumnRenamed("key", "alone").join(few(classes), "sid", "left").select(
        "sid", F.when(F.col("head").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("head", "alone").alias("head"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("weight").alias("n"))
    found = common.lookup(signed.select("doc_id", "key", "sid"), own, "sid", p.broadcast_rows // 2, most=sets).select(
        "doc_id", "key", F.coalesce(F.col("key") == F.col("head"), F.lit(True)).alias("first"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    out = common.write_shared(found, rows=total)
    common.release(since)
    return out


def deduplicate(documents: DataFrame, p: JaccardParams = JaccardParams()) -> DataFrame:
    """One document of each class, the one with the smallest doc_id; all columns."""
    found = classify(documents, p)
    total = found.count()
    odd = found.where("n_links > 0").groupBy("key").agg(F.bool_or("first").alias("_first"), F.count("*").alias("_rows")).where("NOT _first OR _rows > 1")
    odd = common.write_shared(odd.select(F.col("key").alias("_odd"), "_first"), rows=total)
    many, again = odd.agg(F.count("*"), F.coalesce(F.bool_or("_first"), F.lit(False))).first()
    odd = common.near(odd, many, 4 * p.broadcast_rows)
    plain, names = common.renamed(documents)
    at = {c: n for n, c in zip(names, documents.columns)}
    keyed = plain.withColumn("_key", common.row_key(at["doc_id"], at["text"])).join(odd, F.col("_key") == F.col("_odd"), "left")
    alone = keyed.where("_odd IS NULL").select(*names)
    if not again:
        return alone.toDF(*documents.columns)
    # rows that repeat their class's first one entirely
    one = keyed.where("_first").groupBy("_key").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row")).select("row.*")
    return alone.union(one).toDF(*documents.columns)


def op3_jaccard(spark: SparkSession, sf_dir: str, params: JaccardParams = JaccardParams()) -> DataFrame:
    """Every document's near-duplicate class and number of links."""
    return classify(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"), params).select("doc_id", "class_id", "n_links")
