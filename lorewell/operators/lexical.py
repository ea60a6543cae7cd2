"""Lexical index and BM25 search as joins and sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.functions.text import tokenize
from lorewell.operators import scoring
from lorewell.sources.shared import held

#: Bytes of question terms that are broadcast; more are looked up by shuffle.
MAX_TERM_BYTES = scoring.MAX_TERM_BYTES
#: Parts into which the rows of one term are dealt for that.
SALTS = 32


def body(chunks: DataFrame) -> Column:
    """What is indexed: the title, where there is one, and the content."""
    return F.concat_ws("\n", "title", "content") if "title" in chunks.columns else F.col("content")


def postings(chunks: DataFrame) -> DataFrame:
    """(doc_id, term, tf, length) of every term; length is the chunk's number of terms."""
    terms = chunks.select("doc_id", tokenize(body(chunks)).alias("terms"))
    # an outer explode: a filter for empty arrays would tokenise every text again
    rows = terms.select("doc_id", F.size("terms").cast("bigint").alias("length"), F.explode_outer("terms").alias("term"))
    return rows.where("term IS NOT NULL").groupBy("doc_id", "term", "length").agg(F.count("*").alias("tf"))


def search(chunks: DataFrame, questions: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best chunks of each question (query_id, query), any term counts.

    Chunks are read and tokenised once. While the questions' terms are measured and
    small they go to the chunks: what is kept of a chunk is its length and how often
    it has each of them, statistics come from that, and a task sends on its k best
    of each question only. Beyond, words meet the terms by shuffle.
    """
    asked = questions.select("query_id", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term"))
    if asked.agg(F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0))).first()[0] <= MAX_TERM_BYTES:  # 32 for what a row takes beside its text
        scored = _by_broadcast(chunks, asked, k, k1, b)
    else:
        scored = _by_shuffle(chunks, asked, k1, b)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def _by_broadcast(chunks: DataFrame, asked: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """(query_id, doc_id, score) of every chunk that may be among the k best of a question."""
    spark = chunks.sparkSession
    pairs = asked.distinct().toArrow()  # at most `MAX_TERM_BYTES`
    terms = sorted(set(pairs.column("term").to_pylist()))
    spread = spark.sparkContext.broadcast(terms)
    kind, asked_kind = chunks.schema["doc_id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's length, and the numbers and counts of the terms that it shares with the questions."""
        known = pa.array(spread.value, pa.string())
        for batch in batches:
            lists = batch.column("terms")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            code = pc.fill_null(pc.index_in(lists.flatten(), known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            own = np.repeat(np.arange(len(sizes)), sizes)[code >= 0]
            both, tf = np.unique(own * len(known) + code[code >= 0], return_counts=True)
            bounds = pa.array(np.searchsorted(both, np.arange(len(sizes) + 1) * len(known)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(bounds, pa.array((both % max(1, len(known))).astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int64)))], ["doc_id", "length", "codes", "tfs"])

    # a chunk that comes twice, with the same length, is one
    counted = chunks.select("doc_id", tokenize(body(chunks)).alias("terms")).mapInArrow(count, f"doc_id {kind}, length long, codes array<int>, tfs array<long>")
    found = held(counted.repartition("doc_id").groupBy("doc_id", "length").agg(F.flatten(F.collect_list("codes")).alias("codes"), F.flatten(F.collect_list("tfs")).alias("tfs")))
    n, mean = found.agg(F.count("*"), F.avg("length")).first()
    df = {r.code: r.df for r in found.select(F.explode(F.array_distinct("codes")).alias("code")).groupBy("code").agg(F.count("*").alias("df")).collect()}  # one row for each of the terms
    number = {t: i for i, t in enumerate(terms)}
    rows = [(q, t, float(np.log(1 + (n - df[number[t]] + 0.5) / (df[number[t]] + 0.5)))) for q, t in zip(pairs.column("query_id").to_pylist(), pairs.column("term").to_pylist()) if number[t] in df]
    w = scoring.weights(*(list(x) for x in zip(*rows)), pairs.schema.field("query_id").type) if rows else None
    schema = f"query_id {asked_kind}, doc_id {kind}, score double"
    if w is None:
        return spark.createDataFrame([], schema)
    # weights number the terms that some chunk has, chunks number all of them
    renumber = np.full(len(terms), -1)
    renumber[[number[t] for t in w.terms]] = np.arange(len(w.terms))
    sent = spark.sparkContext.broadcast((w, renumber, mean or 1.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, renumber, mean = sent.value
        top = scoring.Top(len(w.ids), k)
        for batch in scoring.whole(batches, "doc_id", scoring.ROWS):
            docs = batch.column("doc_id").dictionary_encode(null_encoding="encode")
            length, codes, tfs = batch.column("length").to_numpy(zero_copy_only=False), batch.column("codes"), batch.column("tfs")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(codes).to_numpy(zero_copy_only=False))
            both, at = np.unique(row * len(renumber) + codes.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            tf = np.bincount(at, tfs.flatten().to_numpy(zero_copy_only=False), len(both))
            row, code = both // len(renumber), renumber[both % len(renumber)]
            value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / mean))
            yield from scoring.send(w, top, docs.dictionary, docs.indices.to_numpy(zero_copy_only=False)[row].astype(np.int64), code, value)

    return found.sortWithinPartitions("doc_id").mapInArrow(score, schema)


def _by_shuffle(chunks: DataFrame, asked: DataFrame, k1: float, b: float) -> DataFrame:
    """(query_id, doc_id, score) of every chunk that shares a term with a question, as joins and sums.

    An empty term for each chunk carries its length. Words are counted first and meet
    the terms by shuffle, a term's documents dealt out to `SALTS` parts, as a common
    word is in most of them.
    """
    wanted = asked.select("term").union(asked.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    terms = chunks.select("doc_id", F.concat(F.array(F.lit("")), tokenize(body(chunks))).alias("terms"))
    rows = terms.select("doc_id", (F.size("terms") - 1).alias("length"), F.explode_outer("terms").alias("term"))
    dealt = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # every use reads the same columns and rows, so that the exchange below is shared
    tf = rows.groupBy("doc_id", "term", "length").agg(F.count("*").alias("tf")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(dealt, ["term", "salt"], "left_semi").drop("salt")
    sums = tf.groupBy("term").agg(F.count("tf").alias("df"), F.avg("length").alias("mean"))
    stats = sums.agg(F.max(F.when(F.col("term") == "", F.col("df"))).alias("n"), F.max(F.when(F.col("term") == "", F.col("mean"))).alias("mean"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    # no question has the empty term, which is in every chunk; by `tf` too, as a filter of the term alone would move below the exchange
    weighed = tf.where(F.col("tf") * F.length("term") > 0).join(sums.select("term", "df"), "term").crossJoin(F.broadcast(stats)).select("doc_id", "term", part.alias("part"))  # stats is one row
    return weighed.join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
