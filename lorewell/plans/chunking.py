"""Queries: chunking of the corpus."""

from pyspark.sql import functions as F

from lorewell.operators import chunking
from lorewell.plans.registry import query

_PIECES = """SELECT doc_id, i AS chunk_index, regexp_replace(substring(text, CAST(i * 700 + 1 AS BIGINT), 800), '\\A[\\s\\x0b\\p{Z}\\x{85}]+|[\\s\\x0b\\p{Z}\\x{85}]+\\z', '', 'g') AS content FROM
 (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 800) / 700.0) AS BIGINT), 0) + 1)) AS i FROM (SELECT doc_id, regexp_replace(text, '\\A[\\s\\x0b\\p{Z}\\x{85}]+|[\\s\\x0b\\p{Z}\\x{85}]+\\z', '', 'g') AS text FROM documents) WHERE text <> '')"""


@query("chunk_documents", f"SELECT doc_id, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS characters, md5(string_agg(content, '|' ORDER BY chunk_index)) AS digest FROM ({_PIECES}) WHERE content <> '' GROUP BY 1")
def chunk_documents(t):
    chunks = chunking.chunk(t("documents").select("doc_id", F.lit("text").alias("format"), "text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "|")
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).cast("bigint").alias("characters"), F.md5(joined).alias("digest"))


@query("list_chunks", f"SELECT concat(doc_id, '-', n) AS chunk_id, n AS chunk_index, content FROM (SELECT doc_id, content, row_number() OVER (ORDER BY chunk_index) - 1 AS n FROM ({_PIECES}) WHERE content <> '' AND doc_id = 12) ORDER BY n LIMIT 10000")
def list_chunks(t):
    """The chunks of one document, in order; the filter reaches the scan."""
    chunks = chunking.chunk(t("documents").where("doc_id = 12").select("doc_id", F.lit("text").alias("format"), "text"))
    return chunks.orderBy("chunk_index").limit(10_000).select("chunk_id", "chunk_index", "content")


@query("chunk_recursive")
def chunk_recursive(t):
    """Chunks cut at line ends and sentence ends where these allow it; held against its definition in the tests."""
    chunks = chunking.chunk(t("documents").select("doc_id", F.lit("text").alias("format"), "text"), recursive=True)
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("content")).alias("longest"))
