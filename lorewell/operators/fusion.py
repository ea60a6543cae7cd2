"""Reciprocal rank fusion of ranked lists, as one union and one sum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.sources.shared import held


def rrf(lists: list[DataFrame], k: int = 60, top: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) from lists (query_id, doc_id, rank); ties by best rank, then id."""
    k = k if k > 0 else 60
    rows = reduce(DataFrame.unionByName, [x.select("query_id", "doc_id", "rank") for x in lists])
    fused = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "best", "doc_id")
    ranked = fused.withColumn("rank", F.row_number().over(order).cast("bigint")).drop("best")
    return ranked if top is None or top <= 0 else ranked.where(F.col("rank") <= top)


def hybrid(dense: DataFrame, sparse: DataFrame, k: int = 60, top: int | None = None) -> DataFrame:
    """Fused lists; a question without any sparse result keeps its dense list and scores as they are."""
    dense, sparse = held(dense), held(sparse)  # each is read more than once, and has a few rows for each question
    fused = rrf([dense, sparse], k)
    alone = dense.join(sparse.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "doc_id", "score", "rank")
    out = fused.join(alone.select("query_id").distinct(), "query_id", "left_anti").unionByName(alone)
    return out if top is None or top <= 0 else out.where(F.col("rank") <= top)


def documents(fused: DataFrame, lists: list[DataFrame]) -> DataFrame:
    """The fused rows with content and the other columns of the lists (query_id, doc_id, content, ...).

    They are those of the first list that has content for the document, or of the first that has it at all.
    """
    others = [c for c in lists[0].columns if c not in ("query_id", "doc_id", "rank", "score")]
    rows = reduce(DataFrame.unionByName, [x.select("query_id", "doc_id", *others, F.lit(k).alias("_list")) for k, x in enumerate(lists)])
    place = F.struct(F.coalesce(F.col("content") == "", F.lit(True)), "_list")
    best = rows.groupBy("query_id", "doc_id").agg(F.min_by(F.struct(*others), place).alias("_d"))
    return fused.join(best, ["query_id", "doc_id"], "left").select(*fused.columns, "_d.*")
