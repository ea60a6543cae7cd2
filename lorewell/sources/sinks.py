"""Sinks: chunk and posting tables partitioned by knowledge base, reports as JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators import postings
from lorewell.sources.shared import exists, held, marks, release, remove


@dataclass(frozen=True)
class ChunkStore:
    """Chunks with their vectors at `path`, in partitions by tenant, base and bucket of documents.

    A scope reaches the scan as partitions: a literal one when the plan is made, a
    table of tenants and bases when it runs. Documents are replaced in the buckets
    that they are in; files of other tenants, bases and buckets stay.
    """

    path: str
    buckets: int = 16

    def _parts(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int"))

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def replace(self, chunks: DataFrame) -> int:
        """Stores the chunks (tenant_id, kb_id, doc_id, ...) of their documents instead of what these had in that base; gives the number of partitions rewritten."""
        since, spark = marks(), chunks.sparkSession
        fresh = held(self._parts(chunks))
        places = fresh.select("tenant_id", "kb_id", "bucket").distinct()
        count = places.count()
        rows = fresh
        if exists(spark, self.path):
            old = self.read(spark).join(F.broadcast(places), ["tenant_id", "kb_id", "bucket"], "left_semi")  # a row for each partition touched
            kept = old.join(fresh.select("tenant_id", "kb_id", "doc_id").distinct(), ["tenant_id", "kb_id", "doc_id"], "left_anti")
            rows = held(kept.unionByName(fresh, allowMissingColumns=True))
        (
            rows.repartitionByRange("tenant_id", "kb_id", "bucket", "doc_id", F.xxhash64("content")).sortWithinPartitions("tenant_id", "kb_id", "bucket", "doc_id")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id", "kb_id", "bucket").parquet(self.path)
        )
        release(since)
        return count

    def remove_bases(self, spark: SparkSession, tenant: int, bases: list[int]) -> None:
        """Whole bases go by their folders."""
        for kb in bases:
            remove(spark, f"{self.path}/tenant_id={tenant}/kb_id={kb}")

    def scoped(self, scope: DataFrame) -> DataFrame:
        """The chunks of the tenants and bases of `scope` (tenant_id, kb_id), and maybe documents (doc_id): partitions are pruned by it when it is known."""
        keys = [c for c in ("tenant_id", "kb_id", "doc_id") if c in scope.columns]
        wanted = self._parts(scope.select(*keys)) if "doc_id" in keys else scope.select(*keys)
        return self.read(scope.sparkSession).join(wanted.distinct(), [*wanted.columns], "left_semi")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replaces the partitions of the knowledge bases that the chunks are in; others stay."""
    by_kb = chunks.repartition("kb_id")
    by_kb.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kb_id").parquet(path)


def write_postings(chunks: DataFrame, path: str) -> postings.Postings:
    """The stored lexical index of chunks (doc_id, content), which `postings.search` reads."""
    return postings.build(chunks, path)


def without_documents(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """The chunks of all documents but `gone` (doc_id)."""
    return chunks.join(gone.select("doc_id"), "doc_id", "left_anti")


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)  # a report is one row
