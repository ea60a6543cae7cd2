"""Queries over stored tables: tree labels, import dedup, incremental statistics, upserts by bucket."""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.operators import tree
from lorewell.operators.imports import DigestStore
from lorewell.operators.statistics import Statistics
from lorewell.plans.mutation import _NEW, feedback_rows
from lorewell.plans.quality import _RECALL
from lorewell.plans.registry import query
from lorewell.sources.buckets import BucketTable
from lorewell.sources.relations import with_inputs as q
from lorewell.sources.shared import scratch
from lorewell.sources.sinks import ChunkStore

_WALK = """, w AS (SELECT d.id, d.parent_id, d.id AS root, [struct_pack(s := d.sort_order, i := d.id)] AS path FROM directories d WHERE NOT EXISTS (SELECT 1 FROM directories p WHERE p.id = d.parent_id)
  UNION ALL SELECT d.id, d.parent_id, w.root, list_append(w.path, struct_pack(s := d.sort_order, i := d.id)) FROM directories d JOIN w ON d.parent_id = w.id),
 o AS (SELECT id, root, path, row_number() OVER (PARTITION BY root ORDER BY path) AS pre FROM w),
 a AS (SELECT x.i AS id, count(*) AS size FROM (SELECT unnest(path) AS x FROM w) GROUP BY 1)
 """


@query("directory_labels", q(_WALK + "SELECT id, root, pre, pre + size - 1 AS last, CAST(len(path) - 1 AS BIGINT) AS depth FROM o JOIN a USING (id)", "directories"))
def directory_labels(t):
    """Reading order: a directory's subtree is the range from `pre` to `last`."""
    return tree.labels(t("directories")).select("id", "root", "pre", "last", "depth")


@query("directory_reading_order", q(_WALK + "SELECT o.id, d.name, CAST(len(path) - 1 AS BIGINT) AS depth, o.pre AS place FROM o JOIN directories d USING (id) ORDER BY root, pre", "directories"))
def directory_reading_order(t):
    """The tree as it is shown: each directory after its parent, siblings by their order."""
    # as many names as directories: not to be broadcast by an estimate
    found = tree.labels(t("directories")).join(t("directories").select("id", "name").hint("merge"), "id")
    return found.orderBy("root", "pre").select("id", "name", "depth", F.col("pre").alias("place"))


_TREE = ", tree AS (SELECT id FROM directories WHERE id = 3 UNION ALL SELECT d.id FROM directories d JOIN tree ON d.parent_id = tree.id) "


@query("filter_by_tree_range", q(_TREE + "SELECT id, directory_id FROM kb_documents WHERE directory_id IN (SELECT id FROM tree)", "directories", "kb_documents"))
def filter_by_tree_range(t):
    """Documents below a directory by a range of the number that they are stored with; no join answers it."""
    found = tree.labels(t("directories"))
    path = scratch(t.spark, "labelled")
    own = found.select(F.col("id").alias("directory_id"), "root", "pre").hint("merge")  # not to be broadcast by an estimate
    t("kb_documents").select("id", "directory_id").join(own, "directory_id").repartitionByRange("root", "pre").sortWithinPartitions("root", "pre").write.parquet(path)
    at = found.where("id = 3").first()
    stored = t.spark.read.parquet(path)
    return (tree.below(stored, at.root, at.pre, at["last"]) if at else stored.where("FALSE")).select("id", "directory_id")


@query("import_dedup", q(", s AS (SELECT knowledge_base_id, content_md5, min(id) FILTER (id % 3 <> 0) AS stored, min(id) AS least FROM kb_documents GROUP BY 1, 2) SELECT d.id, d.content_md5, coalesce(stored, least) AS first, coalesce(stored, least) <> d.id AS duplicated FROM kb_documents d JOIN s USING (knowledge_base_id, content_md5) WHERE d.id % 3 = 0", "kb_documents"))
def import_dedup(t):
    """Every third document is a new batch, judged against the stored others and within the batch."""
    docs = t("kb_documents").select("id", "knowledge_base_id", "content_md5")
    store = DigestStore(scratch(t.spark, "digests"), 16)
    store.add(docs.where("id % 3 <> 0"))
    judged = store.judge(docs.where("id % 3 = 0"))
    return judged.select("id", "content_md5", "first", (F.col("first") != F.col("id")).alias("duplicated"))


_STATS = f""", r AS ({_RECALL}), c AS (SELECT doc_id, count(DISTINCT assistant_message_id) AS cited_count FROM retrieval_hits WHERE cited AND assistant_message_id > 0 GROUP BY 1),
 k AS (SELECT doc_id, string_agg(rank || ':' || chunk_index || ':' || n, ',' ORDER BY rank) AS cited_chunks FROM (SELECT doc_id, chunk_index, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, chunk_index) AS rank FROM (SELECT doc_id, chunk_index, count(DISTINCT assistant_message_id) AS n FROM retrieval_hits WHERE cited AND assistant_message_id > 0 GROUP BY 1, 2)) WHERE rank <= 3 GROUP BY 1)
 SELECT coalesce(r.doc_id, c.doc_id) AS doc_id, tenant_id, knowledge_base_id, coalesce(labeled, 0) AS labeled, coalesce(hits, 0) AS hits, recall, coalesce(cited_count, 0) AS cited_count, coalesce(cited_chunks, '') AS cited_chunks FROM r FULL JOIN c ON r.doc_id = c.doc_id LEFT JOIN k ON k.doc_id = coalesce(r.doc_id, c.doc_id)"""


@query("stats_incremental", q(_STATS, "retrieval_hits", "retrieval_labels"))
def stats_incremental(t):
    """The statistics after hits and labels came in three batches, each merged into the buckets of its documents."""
    hits, labels = t("retrieval_hits"), t("retrieval_labels")
    stats = Statistics(scratch(t.spark, "statistics"), buckets=16)
    for k in range(3):
        stats.update(t.spark, hits.where(F.col("user_message_id") % 3 == k), labels.where(F.col("user_message_id") % 3 == k))
    return stats.results.read(t.spark)


def _longs(*names):
    return [T.StructField(n, T.LongType()) for n in names]


@query("labels_upsert", q(f", fresh AS ({_NEW}) SELECT user_message_id, doc_id FROM retrieval_labels WHERE user_message_id NOT IN (SELECT user_message_id FROM fresh) UNION ALL SELECT user_message_id, doc_id FROM fresh", "retrieval_labels"))
def labels_upsert(t):
    """The labels of some questions replaced in a stored table, in the buckets of those questions only."""
    rows = t("retrieval_labels").select("user_message_id", "doc_id")
    stored = BucketTable(scratch(t.spark, "labels"), ("user_message_id", "doc_id"), T.StructType([*_longs("user_message_id"), T.StructField("doc_id", T.StringType())]), 16, ("user_message_id",))
    stored.write(rows)
    fresh = rows.where("user_message_id % 11 = 0").select("user_message_id", (F.col("doc_id").cast("bigint") + 1).cast("string").alias("doc_id")).distinct()
    stored.change(fresh, lambda old, new: old.join(new.select("user_message_id").distinct(), "user_message_id", "left_anti").select("user_message_id", "doc_id").unionByName(new))
    return stored.read(t.spark)


@query("feedback_upsert", q(", now AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'up' ELSE 'down' END AS vote, CAST(id % 6 AS INT) AS score FROM messages WHERE role = 'assistant' AND id % 3 = 0), patch AS (SELECT id, CASE WHEN id % 5 = 0 THEN '' WHEN id % 5 = 1 THEN 'up' END AS vote, CASE WHEN id % 4 = 0 THEN 0 WHEN id % 4 = 1 THEN 5 END AS score FROM messages WHERE role = 'assistant' AND id % 2 = 0) SELECT coalesce(now.id, patch.id) AS id, coalesce(patch.vote, now.vote, '') AS vote, coalesce(patch.score, now.score, 0) AS score FROM now FULL JOIN patch ON now.id = patch.id WHERE coalesce(patch.vote, now.vote, '') <> '' OR coalesce(patch.score, now.score, 0) > 0", "messages"))
def feedback_upsert(t):
    """Votes and scores merged into a stored table; a row that is left with neither goes."""
    now, patch = feedback_rows(t)
    stored = BucketTable(scratch(t.spark, "feedback"), ("id",), T.StructType([*_longs("id"), T.StructField("vote", T.StringType()), T.StructField("score", T.IntegerType())]), 16)
    stored.write(now)

    def merge(old, new):
        both = old.join(new, "id", "full").select("id", F.coalesce("new_vote", "vote", F.lit("")).alias("vote"), F.coalesce("new_score", "score", F.lit(0)).alias("score"))
        return both.where((F.col("vote") != "") | (F.col("score") > 0))

    stored.change(patch, merge)
    # rows of buckets without a patch are checked as well when they are read
    return stored.read(t.spark).where((F.col("vote") != "") | (F.col("score") > 0))


@query("reindex_upsert", q("SELECT id, content_md5, 'old' AS version FROM kb_documents WHERE id % 10 <> 3 UNION ALL SELECT id, md5(concat(content_md5, '2')), 'new' FROM kb_documents WHERE id % 10 = 3", "kb_documents"))
def reindex_upsert(t):
    docs = t("kb_documents").select("id", "content_md5")
    stored = BucketTable(scratch(t.spark, "reindexed"), ("id",), T.StructType([*_longs("id"), T.StructField("content_md5", T.StringType()), T.StructField("version", T.StringType())]), 16)
    stored.write(docs.withColumn("version", F.lit("old")))
    stored.upsert(docs.where("id % 10 = 3").select("id", F.md5(F.concat("content_md5", F.lit("2"))).alias("content_md5"), F.lit("new").alias("version")))
    return stored.read(t.spark)


@query("cascade_buckets", q("SELECT d.id FROM kb_documents d WHERE NOT (d.knowledge_base_id = 4 AND d.status <> 'indexing')", "kb_documents"))
def cascade_buckets(t):
    """Documents of a base deleted from a table in buckets by base: one bucket is read and written."""
    docs = t("kb_documents").select("id", "knowledge_base_id", "status")
    stored = BucketTable(scratch(t.spark, "documents"), ("knowledge_base_id", "id"), T.StructType([*_longs("id", "knowledge_base_id"), T.StructField("status", T.StringType())]), 16, ("knowledge_base_id",))
    stored.write(docs)
    stored.delete(docs.where("knowledge_base_id = 4 AND status <> 'indexing'"))
    return stored.read(t.spark).select("id")


@query("scoped_chunks", q("SELECT d.id AS doc_id, d.tenant_id, d.knowledge_base_id AS kb_id, md5(d.content) AS digest, CAST(e.label AS INT) AS label FROM kb_documents d JOIN knowledge_bases k ON k.id = d.knowledge_base_id AND k.tenant_id = d.tenant_id LEFT JOIN embeddings e ON e.vec_id = d.id - 1 WHERE k.name LIKE '%_1%'", "kb_documents", "knowledge_bases"))
def scoped_chunks(t):
    """The chunks, with what their vectors carry, of the bases whose name a scope asks for: partitions of others are not read."""
    path = scratch(t.spark, "chunks")
    vectors = t("embeddings").select((F.col("vec_id") + 1).alias("id"), "embedding", F.col("label").cast("int").alias("label"))
    chunks = t("kb_documents").join(vectors, "id", "left").select("tenant_id", F.col("knowledge_base_id").alias("kb_id"), F.col("id").alias("doc_id"), "content", "embedding", "label")
    store = ChunkStore(path, 4)
    store.replace(chunks)
    scope = t("knowledge_bases").where("name LIKE '%_1%'").select("tenant_id", F.col("id").alias("kb_id"))
    return store.scoped(scope).select("doc_id", F.col("tenant_id").cast("bigint").alias("tenant_id"), F.col("kb_id").cast("bigint").alias("kb_id"), F.md5("content").alias("digest"), "label")
