"""Import dedup: a batch against stored digests, with a Bloom filter for each bucket.

Digests of each knowledge base are in buckets by digest. Beside them stands a filter
for each bucket, some ten bits a digest. A new batch asks the filters first: digests
and the filter of their bucket meet by shuffle on the bucket, the filter first, so a
task holds one filter. Only buckets of digests that may be there are read and joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lorewell.functions.text import link_file_name, trim_ws
from lorewell.sources.buckets import BucketTable
from lorewell.sources.shared import held

#: Bits of a filter for each digest in it, and probes: about 1 in 100 digests that are not there may be.
BITS, PROBES = 10, 7
DIGESTS = T.StructType([T.StructField("knowledge_base_id", T.LongType()), T.StructField("content_md5", T.StringType()), T.StructField("id", T.LongType())])
_FILTERS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("bits", T.BinaryType())])


def _probes(h: np.ndarray, size: int) -> np.ndarray:
    """(digests, PROBES) places among `size` bits."""
    h = h.astype(np.uint64)
    step = (h >> np.uint64(33)) | np.uint64(1)
    return ((h[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(size)).astype(np.int64)


@dataclass(frozen=True)
class DigestStore:
    """Stored digests at `path`: (knowledge_base_id, content_md5) with the id of the document that had it first."""

    path: str
    buckets: int = 64

    @property
    def digests(self) -> BucketTable:
        return BucketTable(f"{self.path}/digests", ("knowledge_base_id", "content_md5"), DIGESTS, self.buckets)

    @property
    def filters(self) -> BucketTable:
        return BucketTable(f"{self.path}/filters", ("bucket",), _FILTERS, self.buckets)

    def add(self, documents: DataFrame) -> list[int]:
        """Stores the digests of documents (id, knowledge_base_id, content_md5); the smallest id of a digest stands. Gives the buckets rewritten."""
        rows = documents.where("content_md5 IS NOT NULL AND knowledge_base_id IS NOT NULL").groupBy("knowledge_base_id", "content_md5").agg(F.min("id").alias("id"))
        least = lambda old, new: old.unionByName(new.select(*old.columns)).groupBy("knowledge_base_id", "content_md5").agg(F.min("id").alias("id"))
        numbers = self.digests.change(rows, least)
        if numbers:
            self.filters.upsert(self._filters(documents.sparkSession, numbers))
        return numbers

    def _filters(self, spark: SparkSession, numbers: list[int]) -> DataFrame:
        """(bucket, bits) of the buckets as they are stored now."""
        stored = self.digests.read(spark, numbers).select(self.digests.bucket().alias("bucket"), F.xxhash64("content_md5", "knowledge_base_id").alias("h"))
        sizes = stored.groupBy("bucket").agg(F.count("*").alias("n"))
        dealt = stored.join(F.broadcast(sizes), "bucket").repartition("bucket").sortWithinPartitions("bucket")  # sizes: a row for each bucket

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, bits = None, None
            told = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bucket", "bits"])
            for b in batches:
                own, h, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "h", "n"))
                for bucket in np.unique(own):
                    at = np.flatnonzero(own == bucket)
                    if bucket != now:
                        if now is not None:
                            yield told()
                        now, bits = int(bucket), np.zeros(-(-int(n[at[0]]) * BITS // 8) * 8, bool)
                    bits[_probes(h[at], len(bits)).ravel()] = True
            if now is not None:
                yield told()

        return dealt.mapInArrow(run, _FILTERS)

    def _maybe(self, rows: DataFrame) -> DataFrame:
        """The rows (knowledge_base_id, content_md5) whose digest may be stored."""
        spark = rows.sparkSession
        asked = rows.select(self.digests.bucket().alias("bucket"), F.lit(1).alias("kind"), F.xxhash64("content_md5", "knowledge_base_id").alias("h"), F.lit(None).cast("binary").alias("bits"), "knowledge_base_id", "content_md5")
        numbers = self.digests.touched(rows)
        filters = self.filters.read(spark, [r[0] for r in spark.createDataFrame([(k,) for k in numbers], "bucket int").select(self.filters.bucket()).distinct().collect()] if numbers else [])
        first = filters.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("h"), "bits", F.lit(None).cast("long").alias("knowledge_base_id"), F.lit(None).cast("string").alias("content_md5"))
        dealt = asked.unionByName(first).repartition("bucket").sortWithinPartitions("bucket", "kind")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, bits = None, None
            for b in batches:
                own, kind = b.column("bucket").to_numpy(), b.column("kind").to_numpy()
                keep = np.zeros(len(own), bool)
                for start in np.flatnonzero(np.diff(own, prepend=own[0] - 1) if len(own) else own):
                    end = start + int(np.argmin(np.append(own[start:] == own[start], False)))
                    at = np.arange(start, end)
                    for f in at[kind[at] == 0]:
                        now, bits = own[start], np.unpackbits(np.frombuffer(b.column("bits")[int(f)].as_py(), np.uint8))
                    rows = at[kind[at] == 1]
                    if len(rows) and now == own[start]:
                        h = b.column("h").take(pa.array(rows)).to_numpy()
                        keep[rows] = bits[_probes(h, len(bits))].all(1)
                yield b.filter(pa.array(keep)).select(["knowledge_base_id", "content_md5"])

        return dealt.mapInArrow(run, "knowledge_base_id long, content_md5 string")

    def judge(self, batch: DataFrame) -> DataFrame:
        """(id, content_md5, first): for each document of the batch (id, knowledge_base_id, content_md5) the one that had its content first, stored or in the batch; its own id if it is new.

        A document without a digest is always new.
        """
        spark = batch.sparkSession
        docs = batch.select("id", "knowledge_base_id", "content_md5")
        one = held(docs.where("content_md5 IS NOT NULL AND knowledge_base_id IS NOT NULL").groupBy("knowledge_base_id", "content_md5").agg(F.min("id").alias("least")))
        maybe = held(self._maybe(one))
        there = self.digests.read(spark, self.digests.touched(maybe)).join(maybe, ["knowledge_base_id", "content_md5"], "left_semi").select("knowledge_base_id", "content_md5", F.col("id").alias("stored"))
        known = one.join(there, ["knowledge_base_id", "content_md5"], "left").select("knowledge_base_id", "content_md5", F.coalesce("stored", "least").alias("first"))
        return docs.join(known, ["knowledge_base_id", "content_md5"], "left").select("id", "content_md5", F.coalesce("first", "id").alias("first"))


def validated_links(links: DataFrame, most: int = 20, title_bytes: int = 256, url_bytes: int = 1024) -> DataFrame:
    """(request_id, n, reason) of links (request_id, n, title, url): 'ok', or the first thing that is wrong.

    A request of more than `most` links is refused whole; of links with the same address the first of a request stands.
    """
    title, url = trim_ws(F.col("title")), trim_ws(F.col("url"))
    first = F.min("n").over(Window.partitionBy("request_id", url))
    many = F.count("*").over(Window.partitionBy("request_id"))
    reason = (
        F.when(many > most, "too many links").when(title == "", "no title").when(F.octet_length(title) > title_bytes, "title too long").when(url == "", "no link").when(F.octet_length(url) > url_bytes, "link too long")
        .when(link_file_name(url).isNull(), "bad link").when(first < F.col("n"), F.concat(F.lit("same as "), first)).otherwise("ok")
    )
    return links.select("request_id", "n", reason.alias("reason"))
