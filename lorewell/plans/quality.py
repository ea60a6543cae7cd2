"""Queries: document recall, citations, chunk ranks and the statistics shown with a document list."""

from pyspark.sql import functions as F

from lorewell.operators import quality
from lorewell.plans.registry import query
from lorewell.sources.relations import with_inputs

_RECALL = """SELECT l.tenant_id, l.knowledge_base_id, l.doc_id, count(DISTINCT l.user_message_id) AS labeled,
  count(DISTINCT CASE WHEN h.rank > 0 AND h.rank <= 3 THEN l.user_message_id END) AS hits,
  round(CASE WHEN count(DISTINCT l.user_message_id) > 0 THEN least(count(DISTINCT CASE WHEN h.rank > 0 AND h.rank <= 3 THEN l.user_message_id END), count(DISTINCT l.user_message_id)) / CAST(count(DISTINCT l.user_message_id) AS DOUBLE) END, 6) AS recall
  FROM retrieval_labels l LEFT JOIN retrieval_hits h ON l.tenant_id = h.tenant_id AND l.knowledge_base_id = h.knowledge_base_id AND l.user_message_id = h.user_message_id AND l.doc_id = h.doc_id
  GROUP BY 1, 2, 3"""


@query("doc_recall", with_inputs(_RECALL, "retrieval_hits", "retrieval_labels"))
def doc_recall(t):
    return quality.doc_recall(t("retrieval_labels"), t("retrieval_hits"), 3)


@query("doc_recall_single", with_inputs("SELECT count(DISTINCT l.user_message_id) AS hits FROM retrieval_labels l JOIN retrieval_hits h USING (tenant_id, knowledge_base_id, user_message_id, doc_id) WHERE h.rank > 0 AND h.rank <= 5 AND l.doc_id = '7'", "retrieval_hits", "retrieval_labels"))
def doc_recall_single(t):
    one = lambda df: df.where(F.col("doc_id") == "7")
    hits = one(t("retrieval_hits")).where("rank > 0 AND rank <= 5")
    return one(t("retrieval_labels")).join(hits, quality.KEYS).agg(F.count_distinct("user_message_id").alias("hits"))


@query("doc_cited_count", with_inputs("SELECT d.id, count(DISTINCT CASE WHEN h.cited AND h.assistant_message_id > 0 THEN h.assistant_message_id END) AS cited_count FROM kb_documents d LEFT JOIN retrieval_hits h ON CAST(d.id AS VARCHAR) = h.doc_id GROUP BY 1", "kb_documents", "retrieval_hits"))
def doc_cited_count(t):
    counts = quality.cited_counts(t("retrieval_hits"), "doc_id")
    docs = t("kb_documents").select("id", F.col("id").cast("string").alias("doc_id"))
    return docs.join(counts, "doc_id", "left").select("id", F.coalesce("cited_count", F.lit(0).cast("long")).alias("cited_count"))


@query("doc_chunk_rank", with_inputs("SELECT * FROM (SELECT doc_id, chunk_index, cited_count, row_number() OVER (PARTITION BY doc_id ORDER BY cited_count DESC, chunk_index) AS rank FROM (SELECT doc_id, chunk_index, count(DISTINCT assistant_message_id) AS cited_count FROM retrieval_hits WHERE cited AND assistant_message_id > 0 GROUP BY 1, 2) WHERE chunk_index >= 0) WHERE rank <= 3", "retrieval_hits"))
def doc_chunk_rank(t):
    return quality.top_chunks(t("retrieval_hits"))


@query("document_list_stats", with_inputs(f""", r AS ({_RECALL}), c AS (SELECT doc_id, count(DISTINCT assistant_message_id) AS cited_count FROM retrieval_hits WHERE cited AND assistant_message_id > 0 GROUP BY 1),
  k AS (SELECT doc_id, string_agg(rank || ':' || chunk_index || ':' || n, ',' ORDER BY rank) AS cited_chunks FROM (SELECT doc_id, chunk_index, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, chunk_index) AS rank FROM (SELECT doc_id, chunk_index, count(DISTINCT assistant_message_id) AS n FROM retrieval_hits WHERE cited AND assistant_message_id > 0 GROUP BY 1, 2)) WHERE rank <= 3 GROUP BY 1)
  SELECT d.id, d.tenant_id, coalesce(labeled, 0) AS labeled_queries, coalesce(hits, 0) AS hit_queries, recall, coalesce(cited_count, 0) AS cited_count, coalesce(cited_chunks, '') AS cited_chunks
  FROM kb_documents d LEFT JOIN r ON r.doc_id = CAST(d.id AS VARCHAR) AND r.tenant_id = d.tenant_id AND r.knowledge_base_id = d.knowledge_base_id LEFT JOIN c ON c.doc_id = CAST(d.id AS VARCHAR) LEFT JOIN k ON k.doc_id = CAST(d.id AS VARCHAR)""", "kb_documents", "retrieval_hits", "retrieval_labels"))
def document_list_stats(t):
    hits = t("retrieval_hits")
    recall = quality.doc_recall(t("retrieval_labels"), hits, 3)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_index", "cited_count"))), lambda x: F.concat_ws(":", x["rank"], x["chunk_index"], x["cited_count"])), ",")
    chunks = quality.top_chunks(hits).groupBy("doc_id").agg(listed.alias("cited_chunks"))
    docs = t("kb_documents").select("id", "tenant_id", "knowledge_base_id", F.col("id").cast("string").alias("doc_id"))
    none = F.lit(0).cast("long")
    return (
        docs.join(recall, ["tenant_id", "knowledge_base_id", "doc_id"], "left").join(quality.cited_counts(hits, "doc_id"), "doc_id", "left").join(chunks, "doc_id", "left")
        .select("id", "tenant_id", F.coalesce("labeled", none).alias("labeled_queries"), F.coalesce("hits", none).alias("hit_queries"), "recall", F.coalesce("cited_count", none).alias("cited_count"), F.coalesce("cited_chunks", F.lit("")).alias("cited_chunks"))
    )
