"""Queries: lists, access, quotas, counts and the directory tree."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.operators import catalog, retrieval
from lorewell.plans.registry import query
from lorewell.sources.relations import with_inputs as q

BIG = "bigint"


@query("index_build_dedup", q("SELECT a.id, a.document_id, a.status FROM index_builds a WHERE NOT EXISTS (SELECT 1 FROM index_builds b WHERE a.document_id = b.document_id AND a.id > b.id AND a.status = b.status AND a.triggered_at >= b.triggered_at AND a.triggered_at < b.triggered_at + INTERVAL '2' SECOND AND a.finished_at IS NOT DISTINCT FROM b.finished_at)", "index_builds"))
def index_build_dedup(t):
    return catalog.index_build_dedup(t("index_builds")).select("id", "document_id", "status")


@query("index_build_history", q("SELECT id, document_id, status FROM index_builds WHERE document_id = 5 ORDER BY triggered_at DESC, id DESC LIMIT 100", "index_builds"))
def index_build_history(t):
    return t("index_builds").where("document_id = 5").orderBy(F.desc("triggered_at"), F.desc("id")).limit(100).select("id", "document_id", "status")


@query("index_build_state", q("SELECT document_id, last(status ORDER BY triggered_at, id) AS status, count(*) AS builds, sum(CASE WHEN finished_at IS NULL THEN 1 ELSE 0 END)::BIGINT AS unfinished FROM index_builds GROUP BY 1", "index_builds"))
def index_build_state(t):
    last = F.max_by("status", F.struct("triggered_at", "id"))
    return t("index_builds").groupBy("document_id").agg(last.alias("status"), F.count("*").alias("builds"), F.count_if(F.col("finished_at").isNull()).alias("unfinished"))


@query("document_list", q("SELECT id, status, (SELECT count(*) FROM kb_documents WHERE tenant_id = 3 AND status = 'ready') AS total FROM kb_documents WHERE tenant_id = 3 AND status = 'ready' ORDER BY id DESC LIMIT 20 OFFSET 20", "kb_documents"))
def document_list(t):
    found = catalog.documents_where(t("kb_documents"), tenant_id=3, status="ready", knowledge_base_id=None)
    total = found.agg(F.count("*").alias("total"))
    return catalog.page(found.select("id", "status"), 2, 0, 20, F.desc("id")).crossJoin(F.broadcast(total))


@query("pending_docs", q("SELECT id FROM kb_documents WHERE status IN ('pending', 'indexing') ORDER BY id", "kb_documents"))
def pending_docs(t):
    return t("kb_documents").where(F.col("status").isin("pending", "indexing")).select("id").orderBy("id")


@query("point_lookup", q("SELECT id, status, knowledge_base_id FROM kb_documents WHERE id = 42", "kb_documents"))
def point_lookup(t):
    return t("kb_documents").where("id = 42").select("id", "status", "knowledge_base_id")


@query("filter_chunks", q("SELECT id, knowledge_base_id, directory_id FROM kb_documents WHERE tenant_id = 2 AND knowledge_base_id = 7 AND directory_id IN (7, 32, 57, 107, 157)", "kb_documents"))
def filter_chunks(t):
    docs = t("kb_documents").withColumnRenamed("knowledge_base_id", "kb_id")
    return retrieval.scoped(docs, tenant=2, user=None, kb=7, directories=[7, 32, 57, 107, 157]).select("id", F.col("kb_id").alias("knowledge_base_id"), "directory_id")


_TREE = ", tree AS (SELECT id, CAST(0 AS BIGINT) AS depth FROM directories WHERE id = {root} UNION ALL SELECT d.id, tree.depth + 1 FROM directories d JOIN tree ON d.parent_id = tree.id) "


@query("filter_by_directory_tree", q(_TREE.format(root=3) + "SELECT id, directory_id FROM kb_documents WHERE directory_id IN (SELECT id FROM tree)", "directories", "kb_documents"))
def filter_by_directory_tree(t):
    tree = catalog.descendants(t("directories"), t("directories").where("id = 3"))
    return retrieval.scoped(t("kb_documents"), directories=tree).select("id", "directory_id")


@query("directory_descendants", q(_TREE.format(root=3) + "SELECT id, depth FROM tree", "directories"))
def directory_descendants(t):
    return catalog.descendants(t("directories"), t("directories").where("id = 3")).select("id", "depth")


@query("directory_tree", q(", tree AS (SELECT d.id, d.name, d.sort_order, CAST(0 AS BIGINT) AS depth, d.id AS root FROM directories d WHERE NOT EXISTS (SELECT 1 FROM directories p WHERE p.id = d.parent_id) UNION ALL SELECT d.id, d.name, d.sort_order, tree.depth + 1, tree.root FROM directories d JOIN tree ON d.parent_id = tree.id) SELECT tree.id, tree.name, tree.depth, root, (SELECT count(*) FROM directories c WHERE c.parent_id = tree.id) AS children FROM tree ORDER BY depth, sort_order, id", "directories"))
def directory_tree(t):
    dirs = t("directories")
    roots = dirs.alias("d").join(dirs.select(F.col("id").alias("pid")), F.col("parent_id") == F.col("pid"), "left_anti")
    children = dirs.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    tree = catalog.descendants(dirs, roots).join(dirs.select("id", "name", "sort_order"), "id").join(children, "id", "left")
    return tree.orderBy("depth", "sort_order", "id").select("id", "name", "depth", "root", F.coalesce("children", F.lit(0).cast(BIG)).alias("children"))


@query("directory_move_check", q(_TREE.format(root=3) + "SELECT d.id AS target, d.id NOT IN (SELECT id FROM tree) AS allowed FROM directories d", "directories"))
def directory_move_check(t):
    below = catalog.descendants(t("directories"), t("directories").where("id = 3")).select(F.col("id").alias("inside"))
    targets = t("directories").select(F.col("id").alias("target"))
    return targets.join(below, F.col("target") == F.col("inside"), "left").select("target", F.col("inside").isNull().alias("allowed"))


@query("deletable_dirs", q("SELECT id FROM directories d WHERE NOT EXISTS (SELECT 1 FROM directories c WHERE c.parent_id = d.id) AND NOT EXISTS (SELECT 1 FROM kb_documents k WHERE k.directory_id = d.id)", "directories", "kb_documents"))
def deletable_dirs(t):
    dirs = t("directories")
    used = dirs.select(F.col("parent_id").alias("id")).union(t("kb_documents").select("directory_id")).where("id IS NOT NULL")
    return dirs.join(used, "id", "left_anti").select("id")


@query("acl_visibility", q("SELECT d.id, d.tenant_id = 2 AS can_read, d.tenant_id = 2 AND k.tenant_id = 2 AND d.id % 3 = 0 AS can_write FROM kb_documents d LEFT JOIN knowledge_bases k ON k.id = d.knowledge_base_id", "kb_documents", "knowledge_bases"))
def acl_visibility(t):
    kbs = t("knowledge_bases").select(F.col("id").alias("knowledge_base_id"), F.col("tenant_id").alias("kb_tenant"))
    mine, owner = F.col("tenant_id") == 2, F.col("id") % 3 == 0
    return t("kb_documents").join(kbs, "knowledge_base_id", "left").select("id", mine.alias("can_read"), (mine & (F.col("kb_tenant") == 2) & owner).alias("can_write"))


@query("user_roles", q("SELECT u.id, u.username = 'u7' AS tenant_admin, t.code = 'africa' AND u.username = 'u7' AS platform_admin FROM users u JOIN tenants t ON t.id = u.tenant_id", "users", "tenants"))
def user_roles(t):
    admin = F.col("username") == "u7"
    tenants = t("tenants").select(F.col("id").alias("tenant_id"), "code")
    return t("users").join(tenants, "tenant_id").select("id", admin.alias("tenant_admin"), (admin & (F.col("code") == "africa")).alias("platform_admin"))


@query("tenant_usage", q("SELECT t.id, t.code, CASE WHEN t.max_files > 0 THEN t.max_files ELSE 5 END AS max_files, (SELECT count(*) FROM users u WHERE u.tenant_id = t.id) AS user_count, (SELECT count(*) FROM kb_documents d WHERE d.tenant_id = t.id) AS file_count, (SELECT count(DISTINCT session_id) FROM messages m WHERE m.tenant_id = t.id) AS session_count, (SELECT count(*) FROM usage_events e WHERE e.tenant_id = t.id AND e.kind = 'voice') AS voice_inputs FROM tenants t ORDER BY t.id DESC", "tenants", "users", "kb_documents", "messages", "usage_events"))
def tenant_usage(t):
    by = lambda df, agg, name: df.groupBy(F.col("tenant_id").alias("id")).agg(agg.alias(name))
    out = t("tenants").select("id", "code", catalog.effective_limit(F.col("max_files")).alias("max_files"))
    parts = [by(t("users"), F.count("*"), "user_count"), by(t("kb_documents"), F.count("*"), "file_count"), by(t("messages"), F.count_distinct("session_id"), "session_count"), by(t("usage_events").where("kind = 'voice'"), F.count("*"), "voice_inputs")]
    for part in parts:
        out = out.join(part, "id", "left")
    return out.fillna(0, ["user_count", "file_count", "session_count", "voice_inputs"]).orderBy(F.desc("id"))


@query("quota_status", q(", s AS (SELECT tenant_id, CAST(ts + INTERVAL '8' HOUR AS DATE) AS day, sum(CASE WHEN kind = 'voice' THEN 1 ELSE 0 END) AS used FROM usage_events GROUP BY 1, 2) SELECT t.id, CAST(s.day AS VARCHAR) AS day, CAST(s.used AS BIGINT) AS used, s.used >= CASE WHEN t.max_files > 0 THEN t.max_files ELSE 5 END AS rejected, CAST(greatest(0, CASE WHEN t.max_files > 0 THEN t.max_files ELSE 5 END - s.used) AS BIGINT) AS remaining FROM tenants t JOIN s ON s.tenant_id = t.id", "tenants", "usage_events"))
def quota_status(t):
    limit = catalog.effective_limit(F.col("max_files"))
    used = t("usage_events").groupBy(F.col("tenant_id").alias("id"), F.date_format(catalog.shanghai(F.col("ts")), "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("kind") == "voice").alias("used"))
    return used.join(t("tenants"), "id").select("id", "day", "used", (F.col("used") >= limit).alias("rejected"), F.greatest(F.lit(0), limit - F.col("used")).cast(BIG).alias("remaining"))


@query("speech_usage_daily", q("SELECT tenant_id, CAST(CAST(ts + INTERVAL '8' HOUR AS DATE) AS VARCHAR) AS day, CAST(sum(CASE WHEN kind = 'voice' THEN 1 ELSE 0 END) AS BIGINT) AS voice_inputs, CAST(sum(CASE WHEN kind = 'tts' THEN 1 ELSE 0 END) AS BIGINT) AS tts_count FROM usage_events GROUP BY 1, 2", "usage_events"))
def speech_usage_daily(t):
    day = F.date_format(catalog.shanghai(F.col("ts")), "yyyy-MM-dd").alias("day")
    return t("usage_events").groupBy("tenant_id", day).agg(F.count_if(F.col("kind") == "voice").alias("voice_inputs"), F.count_if(F.col("kind") == "tts").alias("tts_count"))


@query("upload_limits", q("SELECT t.id, CASE WHEN t.max_files > 0 THEN t.max_files ELSE 5 END AS max_files, count(d.id) AS used_files, least(CASE WHEN t.max_files > 0 THEN t.max_files ELSE 5 END, 4) AS size_limit, count(d.id) + 1 > CASE WHEN t.max_files > 0 THEN t.max_files ELSE 5 END AS full FROM tenants t LEFT JOIN kb_documents d ON d.tenant_id = t.id GROUP BY t.id, t.max_files", "tenants", "kb_documents"))
def upload_limits(t):
    limit = catalog.effective_limit(F.col("max_files"))
    used = t("kb_documents").groupBy(F.col("tenant_id").alias("id")).agg(F.count("*").alias("used_files"))
    system = F.lit(4)  # 0 would mean none: least(limit, nullif(system, 0))
    rows = t("tenants").join(used, "id", "left").fillna(0, ["used_files"])
    return rows.select("id", limit.alias("max_files"), "used_files", F.least(limit, F.nullif(system, F.lit(0))).alias("size_limit"), (F.col("used_files") + 1 > limit).alias("full"))


@query("entity_counts", q("SELECT d.id, (SELECT count(*) FROM directories c WHERE c.parent_id = d.id) AS children, (SELECT count(*) FROM kb_documents k WHERE k.directory_id = d.id) AS documents FROM directories d", "directories", "kb_documents"))
def entity_counts(t):
    dirs = t("directories")
    children = dirs.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    docs = t("kb_documents").where("directory_id IS NOT NULL").groupBy(F.col("directory_id").alias("id")).agg(F.count("*").alias("documents"))
    return dirs.select("id").join(children, "id", "left").join(docs, "id", "left").fillna(0)


@query("kbs_by_user", q("SELECT id, name FROM knowledge_bases WHERE tenant_id = 2 ORDER BY id DESC", "knowledge_bases"))
def kbs_by_user(t):
    return t("knowledge_bases").where("tenant_id = 2").select("id", "name").orderBy(F.desc("id"))


@query("docs_with_username", q("SELECT d.id, coalesce(u.username, '') AS username FROM kb_documents d LEFT JOIN users u ON u.id = d.id * 7 % (SELECT count(*) FROM users) + 1", "kb_documents", "users"))
def docs_with_username(t):
    """Owners are dealt out over all users."""
    users = t("users").select(F.col("id").alias("user_id"), "username")
    many = F.broadcast(users.agg(F.count("*").alias("many")))  # one row
    return t("kb_documents").crossJoin(many).withColumn("user_id", F.col("id") * 7 % F.col("many") + 1).join(users, "user_id", "left").select("id", F.coalesce("username", F.lit("")).alias("username"))


@query("attach_sources", q("SELECT h.doc_id, h.chunk_index, coalesce(nullif(CASE WHEN h.chunk_index % 2 = 0 THEN 'given' ELSE '' END, ''), d.source, '') AS source FROM (SELECT DISTINCT doc_id, chunk_index FROM retrieval_hits) h LEFT JOIN kb_documents d ON CAST(d.id AS VARCHAR) = h.doc_id", "retrieval_hits", "kb_documents"))
def attach_sources(t):
    given = F.when(F.col("chunk_index") % 2 == 0, "given").otherwise("")
    docs = t("kb_documents").select(F.col("id").cast("string").alias("doc_id"), "source")
    hits = t("retrieval_hits").select("doc_id", "chunk_index").distinct()
    return hits.join(docs, "doc_id", "left").select("doc_id", "chunk_index", F.coalesce(F.nullif(given, F.lit("")), "source", F.lit("")).alias("source"))


@query("session_list", q("SELECT session_id, max(id) AS last_id FROM messages WHERE tenant_id = 2 GROUP BY 1 ORDER BY last_id DESC, session_id LIMIT 100", "messages"))
def session_list(t):
    return t("messages").where("tenant_id = 2").groupBy("session_id").agg(F.max("id").alias("last_id")).orderBy(F.desc("last_id"), "session_id").limit(100)


@query("history_visible", q("SELECT id, session_id FROM messages WHERE session_id IN ('s1', 's6', 's11') AND tenant_id IN (0, 2) ORDER BY id", "messages"))
def history_visible(t):
    return t("messages").where(F.col("session_id").isin("s1", "s6", "s11") & F.col("tenant_id").isin(0, 2)).select("id", "session_id").orderBy("id")


@query("history_enriched", q(", f AS (SELECT id AS message_id, CASE WHEN id % 2 = 0 THEN 'up' ELSE 'down' END AS vote FROM messages WHERE role = 'assistant' AND id % 3 = 0), l AS (SELECT user_message_id, string_agg(doc_id, ',' ORDER BY CAST(doc_id AS BIGINT)) AS relevant FROM retrieval_labels GROUP BY 1) SELECT m.id, m.role, coalesce(f.vote, '') AS vote, CASE WHEN m.role = 'user' THEN coalesce(l.relevant, '') ELSE '' END AS relevant FROM messages m LEFT JOIN f ON f.message_id = m.id LEFT JOIN l ON l.user_message_id = m.id", "messages", "retrieval_labels"))
def history_enriched(t):
    m = t("messages")
    votes = m.where("role = 'assistant' AND id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "up").otherwise("down").alias("vote"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.col("doc_id").cast(BIG))), lambda x: x.cast("string")), ",")
    labels = t("retrieval_labels").groupBy(F.col("user_message_id").alias("id")).agg(ids.alias("relevant"))
    relevant = F.when(F.col("role") == "user", F.coalesce("relevant", F.lit(""))).otherwise("")
    return m.join(votes, "id", "left").join(labels, "id", "left").select("id", "role", F.coalesce("vote", F.lit("")).alias("vote"), relevant.alias("relevant"))


@query("feedback_eligibility", q("SELECT id, CASE WHEN tenant_id NOT IN (0, 2) THEN 'forbidden' WHEN session_id <> 's1' THEN 'other session' WHEN role <> 'assistant' THEN 'not an answer' ELSE 'ok' END AS reason FROM messages", "messages"))
def feedback_eligibility(t):
    reason = F.when(~F.col("tenant_id").isin(0, 2), "forbidden").when(F.col("session_id") != "s1", "other session").when(F.col("role") != "assistant", "not an answer").otherwise("ok")
    return t("messages").select("id", reason.alias("reason"))


@query("label_eligibility", q("SELECT m.id, d.id AS doc, CASE WHEN m.tenant_id <> 2 THEN 'forbidden' WHEN m.role <> 'user' THEN 'not a question' WHEN d.tenant_id <> 2 THEN 'no access' WHEN d.knowledge_base_id <> 7 THEN 'other knowledge base' ELSE 'ok' END AS reason FROM messages m JOIN kb_documents d ON d.id = m.id % (SELECT count(*) FROM kb_documents) + 1", "messages", "kb_documents"))
def label_eligibility(t):
    """Questions are asked of all documents in turn."""
    many = F.broadcast(t("kb_documents").agg(F.count("*").alias("many")))  # one row
    m = t("messages").crossJoin(many).select(F.col("id"), F.col("tenant_id").alias("mt"), "role", (F.col("id") % F.col("many") + 1).alias("doc"))
    d = t("kb_documents").select(F.col("id").alias("doc"), F.col("tenant_id").alias("dt"), "knowledge_base_id")
    reason = F.when(F.col("mt") != 2, "forbidden").when(F.col("role") != "user", "not a question").when(F.col("dt") != 2, "no access").when(F.col("knowledge_base_id") != 7, "other knowledge base").otherwise("ok")
    return m.join(d, "doc").select("id", "doc", reason.alias("reason"))


_REINDEX = "SELECT o_custkey AS id, o_orderkey AS pos FROM orders"
_PLAN = f", r AS (SELECT id, pos, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM ({_REINDEX})) SELECT r.pos, r.id, CASE WHEN r.id = 0 THEN 'invalid id' WHEN r.n > 1 THEN 'repeated' WHEN d.id IS NULL THEN 'missing' WHEN d.tenant_id <> 2 THEN 'forbidden' WHEN d.status = 'indexing' THEN 'indexing' WHEN d.source = '' THEN 'source gone' ELSE 'triggered' END AS outcome FROM r LEFT JOIN kb_documents d ON d.id = r.id"


def _reindex(t):
    asked = t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos"))
    asked = asked.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("pos")))
    docs = t("kb_documents").select("id", "tenant_id", "status", "source", F.lit(True).alias("there"))
    outcome = (
        F.when(F.col("id") == 0, "invalid id").when(F.col("n") > 1, "repeated").when(F.col("there").isNull(), "missing").when(F.col("tenant_id") != 2, "forbidden")
        .when(F.col("status") == "indexing", "indexing").when(F.col("source") == "", "source gone").otherwise("triggered")
    )
    return asked.join(docs, "id", "left").select("pos", "id", outcome.alias("outcome"))


@query("reindex_plan", q(_PLAN, "kb_documents"))
def reindex_plan(t):
    return _reindex(t)


@query("import_summary", q(_PLAN.replace(", r AS", ", r AS", 1).replace("SELECT r.pos", ", p AS (SELECT r.pos", 1).replace(") , p", "), p") + ") SELECT outcome, count(*) AS n FROM p GROUP BY 1", "kb_documents"))
def import_summary(t):
    return _reindex(t).groupBy("outcome").agg(F.count("*").alias("n"))


@query("turns_per_session", q("SELECT session_id, count(*) AS turns FROM messages WHERE role = 'user' GROUP BY 1", "messages"))
def turns_per_session(t):
    return t("messages").where("role = 'user'").groupBy("session_id").agg(F.count("*").alias("turns"))
