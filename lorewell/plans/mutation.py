"""Queries: dedup, upserts, replacements and deletes as new snapshots built from joins."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.functions.text import canonical_id
from lorewell.plans.registry import query
from lorewell.sources.relations import with_inputs as q


@query("md5_dedup", q("SELECT id, content_md5, row_number() OVER (PARTITION BY knowledge_base_id, content_md5 ORDER BY id) > 1 AS duplicated FROM kb_documents", "kb_documents"))
def md5_dedup(t):
    docs = t("kb_documents").select("id", "knowledge_base_id", "content_md5")
    first = docs.groupBy("knowledge_base_id", "content_md5").agg(F.min("id").alias("first"))
    return docs.join(first, ["knowledge_base_id", "content_md5"]).select("id", "content_md5", (F.col("id") > F.col("first")).alias("duplicated"))


_NEW = "SELECT DISTINCT tenant_id, knowledge_base_id, user_message_id, CAST(CAST(doc_id AS BIGINT) + 1 AS VARCHAR) AS doc_id FROM retrieval_labels WHERE user_message_id % 11 = 0"


@query("replace_labels", q(f", fresh AS ({_NEW}) SELECT user_message_id, doc_id FROM retrieval_labels WHERE user_message_id NOT IN (SELECT user_message_id FROM fresh) UNION ALL SELECT user_message_id, doc_id FROM fresh", "retrieval_labels"))
def replace_labels(t):
    old = t("retrieval_labels")
    fresh = old.where("user_message_id % 11 = 0").select("user_message_id", (F.col("doc_id").cast("bigint") + 1).cast("string").alias("doc_id"), "tenant_id", "knowledge_base_id").distinct()
    kept = old.join(fresh.select("user_message_id"), "user_message_id", "left_anti")
    return kept.select("user_message_id", "doc_id").unionByName(fresh.select("user_message_id", "doc_id"))


@query("reindex_replace", q("SELECT id, content_md5, 'old' AS version FROM kb_documents WHERE id % 10 <> 3 UNION ALL SELECT id, md5(concat(content_md5, '2')), 'new' FROM kb_documents WHERE id % 10 = 3", "kb_documents"))
def reindex_replace(t):
    docs = t("kb_documents").select("id", "content_md5")
    fresh = docs.where("id % 10 = 3").select("id", F.md5(F.concat("content_md5", F.lit("2"))).alias("content_md5"), F.lit("new").alias("version"))
    return docs.join(fresh.select("id"), "id", "left_anti").withColumn("version", F.lit("old")).unionByName(fresh)


@query("feedback_merge", q(", now AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'up' ELSE 'down' END AS vote, CAST(id % 6 AS INT) AS score FROM messages WHERE role = 'assistant' AND id % 3 = 0), patch AS (SELECT id, CASE WHEN id % 5 = 0 THEN '' WHEN id % 5 = 1 THEN 'up' END AS vote, CASE WHEN id % 4 = 0 THEN 0 WHEN id % 4 = 1 THEN 5 END AS score FROM messages WHERE role = 'assistant' AND id % 2 = 0) SELECT coalesce(now.id, patch.id) AS id, coalesce(patch.vote, now.vote, '') AS vote, coalesce(patch.score, now.score, 0) AS score FROM now FULL JOIN patch ON now.id = patch.id WHERE coalesce(patch.vote, now.vote, '') <> '' OR coalesce(patch.score, now.score, 0) > 0", "messages"))
def feedback_merge(t):
    now, patch = feedback_rows(t)
    merged = now.join(patch, "id", "full").select("id", F.coalesce("new_vote", "vote", F.lit("")).alias("vote"), F.coalesce("new_score", "score", F.lit(0)).alias("score"))
    return merged.where((F.col("vote") != "") | (F.col("score") > 0))


def feedback_rows(t):
    """Stored votes and scores, and a patch of them: '' and 0 clear, null keeps."""
    m = t("messages").where("role = 'assistant'")
    now = m.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "up").otherwise("down").alias("vote"), (F.col("id") % 6).cast("int").alias("score"))
    patch = m.where("id % 2 = 0").select("id", F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 5 == 1, "up").alias("new_vote"), F.when(F.col("id") % 4 == 0, 0).when(F.col("id") % 4 == 1, 5).alias("new_score"))
    return now, patch


@query("conversation_backfill", q("SELECT session_id, max(CASE WHEN tenant_id = 1 THEN 9 ELSE 0 END)::BIGINT AS old_kb, CASE WHEN max(CASE WHEN tenant_id = 1 THEN 9 ELSE 0 END) = 0 THEN max(tenant_id) ELSE 9 END AS knowledge_base_id FROM messages GROUP BY 1", "messages"))
def conversation_backfill(t):
    old = t("messages").groupBy("session_id").agg(F.max(F.when(F.col("tenant_id") == 1, 9).otherwise(0)).cast("bigint").alias("old_kb"))
    asked = t("messages").groupBy("session_id").agg(F.max("tenant_id").alias("kb"))
    return old.join(asked, "session_id", "full").select("session_id", "old_kb", F.coalesce(F.nullif("old_kb", F.lit(0)), "kb").cast("bigint").alias("knowledge_base_id"))


@query("cascade_delete", q("SELECT d.id FROM kb_documents d WHERE NOT (d.knowledge_base_id = 4 AND d.status <> 'indexing')", "kb_documents"))
def cascade_delete(t):
    docs = t("kb_documents")
    gone = docs.where("knowledge_base_id = 4 AND status <> 'indexing'").select("id")
    return docs.join(gone, "id", "left_anti").select("id")


@query("apply_patches", q("SELECT k.id, CASE WHEN k.id % 2 = 0 THEN 'renamed' ELSE k.name END AS name FROM knowledge_bases k", "knowledge_bases"))
def apply_patches(t):
    kbs = t("knowledge_bases").select("id", "name")
    patch = kbs.where("id % 2 = 0").select("id", F.lit("renamed").alias("new"))
    return kbs.join(patch, "id", "left").select("id", F.coalesce("new", "name").alias("name"))


@query("linear_hits", q("SELECT user_message_id, doc_id, position FROM (SELECT user_message_id, CASE WHEN chunk_index = 3 THEN ' x' ELSE doc_id END AS doc_id, row_number() OVER (PARTITION BY user_message_id ORDER BY rank, doc_id, chunk_index, assistant_message_id) AS position FROM retrieval_hits) WHERE doc_id <> ' x'", "retrieval_hits"))
def linear_hits(t):
    """A source's place is its rank; one without a valid document id is left out but keeps its place."""
    order = Window.partitionBy("user_message_id").orderBy("rank", "doc_id", "chunk_index", "assistant_message_id")
    placed = t("retrieval_hits").select("user_message_id", F.when(F.col("chunk_index") == 3, " x").otherwise(F.col("doc_id")).alias("raw"), F.row_number().over(order).cast("bigint").alias("position"))
    return placed.select("user_message_id", canonical_id(F.col("raw")).alias("doc_id"), "position").where("doc_id IS NOT NULL")
