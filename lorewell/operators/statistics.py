"""Statistics of documents kept up to date: new hits and labels change the buckets of their documents only.

What counts for a document is kept as members of its sets, one row each: answers that
cite it by chunk, questions it is labelled for, questions that found it in the first
`k` ranks. A set of any size is rows, not an array. Members and results lie in buckets
by document; a batch adds its members to the buckets of its documents, and their results
are computed again from those buckets. A member of several batches has a row of each,
which count once; a bucket of more than `files` files is rewritten without them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lorewell.operators.quality import recall_ratio
from lorewell.sources.buckets import BucketTable

_L, _S = T.LongType(), T.StringType()
#: kind: cited (chunk_index, answer), label and hit (question); tenant and base where the kind has them.
MEMBERS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", _S), ("kind", _S), ("tenant_id", _L), ("knowledge_base_id", _L), ("chunk_index", _L), ("member", _L))])
RESULTS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", _S), ("tenant_id", _L), ("knowledge_base_id", _L), ("labeled", _L), ("hits", _L), ("recall", T.DoubleType()), ("cited_count", _L), ("cited_chunks", _S))])


@dataclass(frozen=True)
class Statistics:
    """Document statistics at `path`; `k` ranks count as found, the `top` most cited chunks are listed."""

    path: str
    k: int = 3
    top: int = 3
    buckets: int = 64
    #: Files that a bucket of members may have before it is rewritten.
    files: int = 256

    @property
    def members(self) -> BucketTable:
        return BucketTable(f"{self.path}/members", tuple(MEMBERS.names), MEMBERS, self.buckets, ("doc_id",))

    @property
    def results(self) -> BucketTable:
        return BucketTable(f"{self.path}/results", ("doc_id", "tenant_id", "knowledge_base_id"), RESULTS, self.buckets, ("doc_id",))

    def members_of(self, hits: DataFrame | None, labels: DataFrame | None) -> DataFrame:
        """The set members that hits (tenant_id, knowledge_base_id, user_message_id, assistant_message_id, rank, doc_id, chunk_index, cited) and labels give."""
        none = F.lit(None).cast("long")
        key = lambda kind, chunk, member: [F.col("doc_id").cast("string").alias("doc_id"), F.lit(kind).alias("kind"), (none if kind == "cited" else F.col("tenant_id").cast("long")).alias("tenant_id"), (none if kind == "cited" else F.col("knowledge_base_id").cast("long")).alias("knowledge_base_id"), chunk.alias("chunk_index"), F.col(member).cast("long").alias("member")]
        parts = []
        if hits is not None:
            parts.append(hits.where(F.col("cited") & (F.col("assistant_message_id") > 0)).select(*key("cited", F.col("chunk_index").cast("long"), "assistant_message_id")))
            parts.append(hits.where((F.col("rank") > 0) & (F.col("rank") <= self.k)).select(*key("hit", none, "user_message_id")))
        if labels is not None:
            parts.append(labels.select(*key("label", none, "user_message_id")))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.where("doc_id IS NOT NULL").distinct()

    def update(self, spark: SparkSession, hits: DataFrame | None = None, labels: DataFrame | None = None) -> list[int]:
        """Adds a batch; gives the buckets that it adds to, whose results are computed again."""
        if hits is None and labels is None:
            return []
        numbers = self.members.append(self.members_of(hits, labels))
        self.members.compact(spark, [n for n in numbers if self.members.files(spark, n) > self.files])
        if numbers:
            self.results.write(self.computed(self.members.read(spark, numbers)), deal=False)
        return numbers

    def computed(self, members: DataFrame) -> DataFrame:
        """One row for each document and the tenant and base it is labelled in, or one without these if it is cited only."""
        keys = ["doc_id", "tenant_id", "knowledge_base_id"]
        asked = members.where("kind IN ('label', 'hit')").groupBy(*keys, "member").agg(F.bool_or(F.col("kind") == "label").alias("labeled"), F.bool_or(F.col("kind") == "hit").alias("hit"))
        recall = asked.where("labeled").groupBy(*keys).agg(F.count("*").alias("labeled"), F.count_if("hit").alias("hits"))
        # an answer's rows for a document in order of the chunk: one counts for its chunk if the chunk is new, one for the document
        before = F.lag("chunk_index").over(Window.partitionBy("doc_id", "member").orderBy("chunk_index"))
        place = F.row_number().over(Window.partitionBy("doc_id", "member").orderBy("chunk_index"))
        cited = members.where("kind = 'cited'").select("doc_id", "chunk_index", ((place == 1) | ~F.col("chunk_index").eqNullSafe(before)).alias("other"), (place == 1).alias("first"))
        chunks = cited.groupBy("doc_id", "chunk_index").agg(F.count_if("other").alias("n"), F.count_if("first").alias("answers"))
        named = F.col("chunk_index") >= 0
        order = Window.partitionBy("doc_id").orderBy(F.coalesce(named, F.lit(False)).desc(), F.desc("n"), "chunk_index")
        best = chunks.withColumn("rank", F.row_number().over(order))
        some = F.collect_list(F.when(named & (F.col("rank") <= self.top), F.struct("rank", "chunk_index", "n")))
        listed = F.array_join(F.transform(F.array_sort(some), lambda x: F.concat_ws(":", x["rank"], x["chunk_index"], x["n"])), ",")
        both = best.groupBy("doc_id").agg(F.sum("answers").alias("cited_count"), listed.alias("cited_chunks"))
        zero = F.lit(0).cast("long")
        return recall.join(both, "doc_id", "full").select(
            *keys, F.coalesce("labeled", zero).alias("labeled"), F.coalesce("hits", zero).alias("hits"), F.round(recall_ratio(F.col("labeled"), F.col("hits")), 6).alias("recall"),
            F.coalesce("cited_count", zero).alias("cited_count"), F.coalesce("cited_chunks", F.lit("")).alias("cited_chunks"),
        )
