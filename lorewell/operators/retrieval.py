"""Retrieval as one call: scope, expansion, hybrid search for each variant, fusion, reranking."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.functions.rules import tool_query
from lorewell.functions.text import canonical_id, preview
from lorewell.operators import fusion, lexical, vectors
from lorewell.operators.models import Expander, Reranker
from lorewell.sources.parameters import Parameters
from lorewell.sources.shared import held

#: Most results that are broadcast to the texts.
MAX_FOUND = 200_000
#: Backends by name; a blank name is the first.
BACKENDS = ("redis", "milvus")


def backend(name: str | None) -> str:
    """The name of a known backend; ValueError for another."""
    found = (name or "").strip().lower() or BACKENDS[0]
    if found not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}")
    return found


def meta_id(c: Column, optional: bool = False) -> Column:
    """An id as index metadata: '' for none; an optional one that is absent is '0'."""
    c = F.coalesce(c, F.lit(0)) if optional else F.nullif(c, F.lit(0))
    return F.coalesce(c.cast("string"), F.lit(""))


def scoped(chunks: DataFrame, tenant: int | None = None, user: str | None = None, kb: object = None, directories: Iterable[int] | DataFrame | None = None) -> DataFrame:
    """The chunks within a scope; a part that is None or empty does not limit.

    Directories are ids, or a table of ids as a tree of them gives it. The filters
    stand on the scan, below every search.
    """
    for column, value in (("tenant_id", tenant), ("user_id", user), ("kb_id", kb)):
        if value:
            chunks = chunks.where(F.col(column) == value)
    if isinstance(directories, DataFrame):
        return chunks.join(directories.select(F.col("id").alias("directory_id")), "directory_id", "left_semi")
    directories = list(directories or ())
    return chunks.where(F.col("directory_id").isin(directories)) if directories else chunks


def expand(questions: DataFrame, expander: Expander, n: int = 2) -> DataFrame:
    """(query_id, variant, query): the question as variant 0, then up to n other ones; alone if the expander fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for number, query in zip(rows["query_id"], rows["query"]):
                try:
                    found = expander.expand(query, n)
                except Exception:  # the question itself is still asked
                    found = []
                seen = {" ".join(query.lower().split())}
                out.append((number, 0, query.strip()))
                for x in found:
                    key = " ".join(str(x).lower().split())
                    if key and key not in seen and len(seen) <= n:
                        out.append((number, len(seen), str(x).strip()))
                        seen.add(key)
            yield pd.DataFrame(out, columns=["query_id", "variant", "query"])

    return questions.select("query_id", "query").mapInPandas(run, "query_id bigint, variant int, query string")


def rerank(pool: DataFrame, reranker: Reranker, n: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the n best of each question's pool (query_id, query, doc_id, rank, text).

    A question's pool is as large as retrieval made it. A result for a place that
    is not in the pool is skipped; if the model fails or returns nothing, the pool
    keeps its order.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "doc_id"]).reset_index(drop=True)
        try:
            found = list(reranker.rerank(rows["query"][0], rows["text"].tolist()))[: len(rows)]
        except Exception:  # the fused order stands
            found = []
        rows["score"] = found + [float("-inf")] * (len(rows) - len(found)) if found else [float(-r) for r in rows["rank"]]
        best = rows.sort_values(["score", "rank"], ascending=[False, True], kind="stable").head(n)
        return best.assign(rank=range(1, len(best) + 1))[["query_id", "doc_id", "score", "rank"]]

    return pool.select("query_id", "query", "doc_id", "rank", "text").groupBy("query_id").applyInPandas(run, "query_id bigint, doc_id bigint, score double, rank bigint")


def fuse_variants(lists: DataFrame, k: int) -> DataFrame:
    """One list for each question from those of its variants (query_id, variant, doc_id, score, rank); a single one as it is."""
    lists = held(lists)
    several = lists.groupBy("query_id").agg(F.count_distinct("variant").alias("n"))
    known = lists.join(several, "query_id")
    fused = fusion.rrf([known.where("n > 1")], k)
    return fused.unionByName(known.where("n = 1").select("query_id", "doc_id", "score", "rank"))


def with_texts(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Results joined with the texts (doc_id, ...) of their documents; while they are few they go to the texts, which stay where they are."""
    found = held(found)
    return texts.join(F.broadcast(found) if found.limit(MAX_FOUND + 1).count() <= MAX_FOUND else found, "doc_id")


def retrieve(chunks: DataFrame, questions: DataFrame, vectors_of_chunks: DataFrame | None, vectors_of_variants: DataFrame | None, p: Parameters = Parameters(), reranker: Reranker | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the best chunks of each question.

    chunks: (doc_id, title, content) of the scope; questions: (query_id, variant,
    query), as `expand` gives them; vectors: (doc_id, vec), and (query_id, variant,
    qvec). Each variant is searched densely and lexically, its lists are fused, and
    then those of the variants; the reranker sees title and content and the
    question itself.
    """
    pool, code = p.pool(), F.col("query_id") * 1024 + F.col("variant")
    apart = lambda df: df.withColumn("variant", F.pmod("query_id", F.lit(1024)).cast("int")).withColumn("query_id", F.floor(F.col("query_id") / 1024))
    sparse = lexical.search(chunks, questions.select(code.alias("query_id"), "query"), pool) if p.hybrid or vectors_of_chunks is None else None
    if vectors_of_chunks is not None:
        inside = vectors_of_chunks.join(chunks.select("doc_id"), "doc_id", "left_semi")
        dense = vectors.nearest(inside, vectors_of_variants.select(code.alias("query_id"), "qvec"), pool)
        one = dense if sparse is None else fusion.hybrid(dense, sparse, p.rrf_k, pool)
    else:
        one = sparse
    fused = fuse_variants(apart(one), p.rrf_k)
    if reranker is None:
        return fused.where(F.col("rank") <= p.top_k)
    first = questions.where("variant = 0").select("query_id", "query")
    text = F.concat_ws("\n", F.nullif(F.coalesce("title", F.lit("")), F.lit("")), "content").alias("text")
    candidates = with_texts(fused.where(F.col("rank") <= pool), chunks.select("doc_id", text)).join(first, "query_id")
    return rerank(candidates, reranker, p.rerank_top_n if p.rerank_top_n > 0 else p.top_k)


def tool_questions(calls: DataFrame, tenant: int) -> DataFrame:
    """(query_id, variant, query) of an agent's search calls (query_id, arguments as JSON); a blank question asks nothing.

    Calls without a tenant are refused: a search must not leave its scope.
    """
    if not tenant or tenant < 0:
        raise ValueError("a search needs a tenant")
    return calls.select("query_id", F.lit(0).alias("variant"), tool_query(F.col("arguments")).alias("query")).where("query <> ''")


def merge_rounds(rounds: DataFrame) -> DataFrame:
    """(answer_id, number, chunk_id, round, rank): the chunks of an answer's rounds (answer_id, round, rank, chunk_id), each where it was seen first."""
    first = rounds.groupBy("answer_id", "chunk_id").agg(F.min(F.struct("round", "rank")).alias("f"))
    order = Window.partitionBy("answer_id").orderBy("f", "chunk_id")
    return first.select("answer_id", F.row_number().over(order).cast("bigint").alias("number"), "chunk_id", "f.round", "f.rank")


def agent_hits(rounds: DataFrame, cited: DataFrame) -> DataFrame:
    """(answer_id, round, rank, doc_id, chunk_index, cited): every hit of an answer's rounds (answer_id, round, rank, chunk_id, doc_id, chunk_index).

    A hit is cited if its chunk's number over all rounds is among `cited` (answer_id,
    number). Hits without a valid document id are left out, their numbers stay.
    """
    numbers = merge_rounds(rounds).select("answer_id", "chunk_id", "number")
    told = numbers.join(cited.select("answer_id", "number").distinct().withColumn("cited", F.lit(True)), ["answer_id", "number"], "left").select("answer_id", "chunk_id", F.coalesce("cited", F.lit(False)).alias("cited"))
    hits = rounds.join(told, ["answer_id", "chunk_id"]).select("answer_id", "round", "rank", canonical_id(F.col("doc_id")).alias("doc_id"), "chunk_index", "cited")
    return hits.where("doc_id IS NOT NULL")


def source_documents(chunks: DataFrame) -> DataFrame:
    """(answer_id, n, title, preview, page, section): what is shown of an answer's sources (answer_id, n, title, content, page, section)."""
    return chunks.select("answer_id", "n", "title", preview(F.col("content"), 300).alias("preview"), F.coalesce("page", F.lit(0)).cast("bigint").alias("page"), F.coalesce("section", F.lit("")).alias("section"))


def prompt_contexts(chunks: DataFrame) -> DataFrame:
    """(answer_id, context): the numbered sources of each answer as one text. A context is as long as a prompt may be."""
    where = F.concat(F.when(F.col("page") > 0, F.concat(F.lit(" p."), "page")).otherwise(""), F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" "), "section")).otherwise(""))
    block = F.concat(F.lit("["), "n", F.lit("] "), F.coalesce("title", F.lit("")), where, F.lit("\n"), F.coalesce("content", F.lit("")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("block")))), lambda x: x["block"])
    return chunks.groupBy("answer_id").agg(F.array_join(listed, "\n\n").alias("context"))


def agent_context(messages: DataFrame, question: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """(session_id, n, role, content): a session's summary first, its turns in order, the question last."""
    turns = messages.where(F.col("role").isin("user", "assistant") & (F.trim("content") != "")).select("session_id", F.lit(1).alias("part"), "id", "role", "content")
    asked = question.select("session_id", F.lit(2).alias("part"), F.lit(0).cast("long").alias("id"), F.lit("user").alias("role"), F.col("query").alias("content"))
    every = turns.unionByName(asked)
    if summaries is not None:
        first = summaries.where(F.trim("summary") != "").select("session_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("id"), F.lit("system").alias("role"), F.col("summary").alias("content"))
        every = every.unionByName(first)
    order = Window.partitionBy("session_id").orderBy("part", "id")
    return every.select("session_id", F.row_number().over(order).cast("bigint").alias("n"), "role", "content")
