"""A stored lexical index: postings in blocks with a maximum each, searched by score bounds.

Documents are dealt into buckets by a hash of their id, about `block_docs` to a
bucket, the same for every term: a block holds the postings of one term in one
bucket, and its largest impact (a posting's share of a BM25 score but for the term's
weight). A term of many documents has many blocks and no task or row has all of
them. Blocks lie in partitions by a hash of the term, sorted by term; a small table
of terms has document frequencies and largest impacts.

A search reads the partitions of its terms only, and of a common term few blocks:

1. each question's strongest term gives the buckets of its largest impacts; what
   those documents score in full is a bound that the k-th result reaches;
2. terms whose largest impacts together stay under the bound cannot lift a document
   to it; only buckets that the others bring up to the bound are candidates;
3. the candidates' blocks, of all terms, give the scores: blocks meet by bucket, where
   they and the questions' weights are one product, and a task sends on its k best.

The result is that of `lexical.search` over the same chunks, row for row. Text is
read at the build only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.functions.text import tokenize
from lorewell.operators import scoring
from lorewell.operators.lexical import body
from lorewell.sources.shared import held, marks, release

#: Goes up when what is stored changes its form.
LAYOUT = 1
#: Questions and buckets, each with each, whose blocks are looked up one by one.
FEW = 5000
#: Scores are rounded to six places; bounds leave that much room.
ROOM = 2e-6


@dataclass(frozen=True)
class PostingsParams:
    k1: float = 1.2
    b: float = 0.75
    #: Documents of a bucket, about.
    block_docs: int = 256
    #: Postings of one partition of terms, about, and the most partitions.
    shard_postings: int = 4_000_000
    max_shards: int = 4096
    #: Buckets that are scored first to find a question's bound.
    first_buckets: int = 4
    #: Postings of a term, about, that one file has.
    file_docs: int = 1_000_000


@dataclass(frozen=True)
class Postings:
    """A stored index: where it is, documents, mean length, and how terms and documents were dealt out."""

    path: str
    docs: int
    mean: float
    shards: int
    buckets: int
    #: Type of the ids.
    kind: str
    params: PostingsParams = PostingsParams()

    def blocks(self, spark: SparkSession) -> DataFrame:
        """term, bucket, most, df, docs, impacts, shard."""
        return spark.read.schema(f"term string, bucket bigint, most double, df bigint, docs array<{self.kind}>, impacts array<double>, shard int").parquet(f"{self.path}/blocks")

    def terms(self, spark: SparkSession) -> DataFrame:
        """term, df, most, shard."""
        return spark.read.schema("term string, df bigint, most double, shard int").parquet(f"{self.path}/terms")


def _shard(term: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def build(chunks: DataFrame, path: str, params: PostingsParams = PostingsParams()) -> Postings:
    """Writes the index of `chunks` (doc_id, content, and title if there is one) to `path`. Repeated ids are one document each time.

    A first pass counts chunks and their terms. Then texts are dealt out by bucket, and
    the blocks of a bucket are made where its texts are: words make no rows.
    """
    p, spark = params, chunks.sparkSession
    kind = chunks.schema["doc_id"].dataType.simpleString()
    words = chunks.select("doc_id", F.size(tokenize(body(chunks))).cast("bigint").alias("length")).groupBy("doc_id", "length").count()
    # as many postings as there are words, at most
    n, total = words.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    found = Postings(path, n, total / n if n else 0.0, max(1, min(p.max_shards, -(-total // p.shard_postings))), max(1, -(-n // p.block_docs)), kind, p)
    mean, k1, b = found.mean or 1.0, p.k1, p.b

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scoring.whole(batches, "bucket"):
            bucket = batch.column("bucket").to_numpy()
            for own in np.split(np.arange(batch.num_rows), np.flatnonzero(bucket[1:] != bucket[:-1]) + 1):
                part = batch.slice(own[0], len(own))
                ids, lists = part.column("doc_id").dictionary_encode(null_encoding="encode"), part.column("terms")
                order = pc.sort_indices(ids.dictionary, null_placement="at_start")
                place = np.empty(len(order), np.int64)
                place[order.to_numpy()] = np.arange(len(order))
                doc, size = place[ids.indices.to_numpy()], pc.list_value_length(lists).to_numpy().astype(np.int64)
                words = lists.flatten().dictionary_encode()
                _, copy = np.unique(np.stack([doc, size]), axis=1, return_inverse=True)  # rows of one id and length are one
                copies = copy.max() + 1
                of_copy, length = np.zeros(copies, np.int64), np.zeros(copies, np.int64)
                of_copy[copy], length[copy] = doc, size
                both, tf = np.unique(words.indices.to_numpy().astype(np.int64) * copies + np.repeat(copy, size), return_counts=True)
                impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[both % copies] / mean))
                merged, at, times = np.unique(both // copies * len(order) + of_copy[both % copies], return_inverse=True, return_counts=True)
                impact, term = np.bincount(at, impact, len(merged)), merged // len(order)
                starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
                if len(starts):
                    bounds = pa.array(np.r_[starts, len(term)].astype(np.int32))
                    docs = ids.dictionary.take(order).take(pa.array(merged % len(order)))
                    yield pa.RecordBatch.from_arrays(
                        [words.dictionary.take(pa.array(term[starts])), pa.array(np.full(len(starts), bucket[own[0]])), pa.array(np.maximum.reduceat(impact, starts)), pa.array(np.add.reduceat(times, starts)), pa.ListArray.from_arrays(bounds, docs), pa.ListArray.from_arrays(bounds, pa.array(impact))],
                        ["term", "bucket", "most", "df", "docs", "impacts"],
                    )

    dealt = chunks.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(found.buckets)).alias("bucket"), body(chunks).alias("content")).repartition("bucket").sortWithinPartitions("bucket")
    blocks = dealt.select("doc_id", "bucket", tokenize(F.col("content")).alias("terms")).mapInArrow(make, f"term string, bucket bigint, most double, df bigint, docs array<{kind}>, impacts array<double>")
    # a shard's blocks, of buckets that are so many that a term in every document spans several files
    placed = blocks.withColumn("shard", _shard(F.col("term"), found.shards)).repartition("shard", F.pmod("bucket", F.lit(max(1, n // p.file_docs))))
    placed.sortWithinPartitions("shard", "term", "bucket").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/blocks")
    stored = found.blocks(spark)
    terms = stored.groupBy("shard", "term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))
    terms.repartitionByRange("shard", "term").sortWithinPartitions("shard", "term").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/terms")
    row = (found.docs, found.mean, found.shards, found.buckets, found.kind, p.k1, p.b, p.block_docs)
    spark.createDataFrame([row], "docs long, mean double, shards int, buckets long, kind string, k1 double, b double, block_docs int").coalesce(1).write.mode("overwrite").parquet(f"{path}/learnt")
    return found


def load(spark: SparkSession, path: str) -> Postings:
    """The index that `build` wrote."""
    r = spark.read.parquet(f"{path}/learnt").first()
    return Postings(path, r.docs, r.mean, r.shards, r.buckets, r.kind, PostingsParams(r.k1, r.b, r.block_docs))


def search(index: Postings, questions: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best chunks of each question (query_id, query), any term counts."""
    spark, p = questions.sparkSession, index.params
    asked = held(questions.select("query_id", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term")).distinct())
    named = asked.select(_shard(F.col("term"), index.shards).alias("shard")).distinct().collect()  # at most `max_shards`
    inside = F.col("shard").isin([r.shard for r in named])
    idf = F.log(1 + (index.docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(index.terms(spark).where(inside).drop("shard"), "term").select("query_id", "term", idf.alias("idf"), (idf * F.col("most")).alias("bound"), "df")
    blocks = index.blocks(spark).where(inside)
    terms = held(weighed)
    # 1: the strongest term's best buckets, scored in full
    strong = Window.partitionBy("query_id").orderBy(F.desc("bound"), "df", "term")
    strongest = terms.withColumn("_n", F.row_number().over(strong)).where("_n = 1").select("query_id", "term")
    best = Window.partitionBy("query_id").orderBy(F.desc("most"), "bucket")
    first = blocks.select("term", "bucket", "most").join(strongest, "term").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= p.first_buckets).select("query_id", "bucket", F.lit(k).alias("k"))
    top = Window.partitionBy("query_id").orderBy(F.desc("score"))
    reached = _scored(blocks, first, terms).withColumn("_n", F.row_number().over(top)).where(F.col("_n") == k).select("query_id", (F.col("score") - ROOM).alias("reached"))
    # 2: weak terms together stay under the bound
    rising = Window.partitionBy("query_id").orderBy("bound", F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    judged = held(terms.join(reached, "query_id", "left").withColumn("reached", F.coalesce("reached", F.lit(0.0))).withColumn("below", F.sum("bound").over(rising)).withColumn("weak", F.col("below") < F.col("reached")))
    rest = judged.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("weak"), F.col("bound"))), F.lit(0.0)).alias("rest"))
    lifted = blocks.select("term", "bucket", "most").join(judged.where("NOT weak").select("query_id", "term", "idf", "reached"), "term")
    candidates = lifted.groupBy("query_id", "bucket", "reached").agg(F.sum(F.col("idf") * F.col("most")).alias("lift")).join(rest, "query_id").where(F.col("lift") + F.col("rest") >= F.col("reached")).select("query_id", "bucket", F.lit(k).alias("k"))
    # 3
    scored = _scored(blocks, candidates, terms).withColumn("score", F.round("score", 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def _scored(blocks: DataFrame, buckets: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): full scores of the documents in the buckets (query_id, bucket, k) that may be among a question's k best of these."""
    spark = blocks.sparkSession
    buckets = held(buckets)
    most = buckets.agg(F.count("*"), F.max("k")).first()
    if terms.agg(F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0))).first()[0] > scoring.MAX_TERM_BYTES:
        wanted = buckets.join(terms.select("query_id", "term", "idf"), "query_id")
        rows = blocks.select("term", "bucket", "docs", "impacts").join(wanted, ["term", "bucket"]).select("query_id", "idf", F.explode(F.arrays_zip("docs", "impacts")).alias("p"))
        return rows.groupBy("query_id", F.col("p.docs").alias("doc_id")).agg(F.sum(F.col("idf") * F.col("p.impacts")).alias("score"))
    schema = f"query_id {terms.schema['query_id'].dataType.simpleString()}, doc_id {blocks.schema['docs'].dataType.elementType.simpleString()}, score double"
    told = terms.select("query_id", "term", "idf").toArrow()  # at most `MAX_TERM_BYTES`
    if not told.num_rows or not most[0]:
        return spark.createDataFrame([], schema)
    w = scoring.weights(*(told.column(c).to_pylist() for c in ("query_id", "term", "idf")), told.schema.field("query_id").type)
    number = {t: i for i, t in enumerate(w.terms)}
    spread = spark.sparkContext.broadcast((w, number, most[1]))
    if most[0] <= FEW:  # the blocks of these questions in these buckets
        meant = buckets.join(terms.select("query_id", "term"), "query_id").select("term", "bucket").distinct()
    else:
        meant = terms.select("term").distinct()
    rows = blocks.select("term", "bucket", "docs", "impacts").join(F.broadcast(meant), meant.columns, "left_semi")
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    asked = buckets.select("bucket", F.col("query_id"), none("term"), none("docs"), none("impacts"))
    both = asked.unionByName(rows.withColumn("query_id", F.lit(None).cast(terms.schema["query_id"].dataType)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, number, k = spread.value
        top = scoring.Top(len(w.ids), k)
        for batch in scoring.whole(batches, "bucket"):
            bucket = batch.column("bucket").to_numpy()
            for own in np.split(np.arange(batch.num_rows), np.flatnonzero(bucket[1:] != bucket[:-1]) + 1):
                part = batch.slice(own[0], len(own))
                lists = part.filter(pc.is_valid(part.column("term")))
                if lists.num_rows in (0, part.num_rows):
                    continue
                asked = np.zeros(len(w.ids), bool)
                asked[pc.index_in(part.filter(pc.is_null(part.column("term"))).column("query_id"), w.ids).drop_null().to_numpy()] = True
                code = np.array([number[t] for t in lists.column("term").to_pylist()])
                ids = lists.column("docs").flatten().dictionary_encode(null_encoding="encode")
                code = np.repeat(code, pc.list_value_length(lists.column("docs")).to_numpy())
                yield from scoring.send(w, top, ids.dictionary, ids.indices.to_numpy().astype(np.int64), code, lists.column("impacts").flatten().to_numpy(), asked)

    return both.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)
