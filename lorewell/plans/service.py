"""Queries: quotas, sessions and their owners, lookups, inserts, cascades, the queue after a restart."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.functions.text import leading_digits
from lorewell.operators import catalog, quality, retrieval
from lorewell.plans.registry import query
from lorewell.sources.relations import with_inputs as q

BIG = "bigint"
_NOW = "2024-01-15 12:00:00"
_MAX = "CASE WHEN t.max_files > 0 THEN t.max_files ELSE 5 END"
_QUOTA = (
    "SELECT t.id AS tenant_id, '{kind}' AS kind, coalesce(u.used, 0) AS used, CAST(" + _MAX + " AS BIGINT) AS max, coalesce(u.used, 0) >= " + _MAX
    + " AS rejected, CAST(greatest(0, " + _MAX + " - coalesce(u.used, 0)) AS BIGINT) AS remaining FROM tenants t LEFT JOIN ({used}) u ON u.tenant_id = t.id"
)
_LOCAL = "date_trunc('day', TIMESTAMP '" + _NOW + "' + INTERVAL '8' HOUR) - INTERVAL '8' HOUR"


@query("quota_report", q(" UNION ALL ".join(_QUOTA.format(kind=kind, used=used) for kind, used in (
    ("files", "SELECT tenant_id, count(*) AS used FROM kb_documents GROUP BY 1"),
    ("sessions", f"SELECT tenant_id, count(*) AS used FROM session_starts WHERE created_at >= {_LOCAL} GROUP BY 1"),
    ("voice", f"SELECT tenant_id, count(*) AS used FROM usage_events WHERE kind = 'voice' AND CAST(ts + INTERVAL '8' HOUR AS DATE) = DATE '2024-01-15' GROUP BY 1"),
    ("tts", f"SELECT tenant_id, count(*) AS used FROM usage_events WHERE kind = 'tts' AND CAST(ts + INTERVAL '8' HOUR AS DATE) = DATE '2024-01-15' GROUP BY 1"),
)), "tenants", "kb_documents", "session_starts", "usage_events"))
def quota_report(t):
    """Files ever, sessions since local midnight, voice inputs and spoken answers of the local day, against each tenant's limit."""
    now, limit = F.lit(_NOW).cast("timestamp_ntz"), F.col("max_files")
    count = lambda df: df.groupBy("tenant_id").agg(F.count("*").alias("used"))
    today = t("usage_events").where(F.to_date(catalog.shanghai(F.col("ts"))) == F.to_date(catalog.shanghai(now)))
    parts = (
        ("files", t("kb_documents")), ("sessions", t("session_starts").where(catalog.since_midnight(F.col("created_at"), now))),
        ("voice", today.where("kind = 'voice'")), ("tts", today.where("kind = 'tts'")),
    )
    out = None
    for kind, rows in parts:
        one = catalog.quota(count(rows), t("tenants"), limit, kind)
        out = one if out is None else out.unionByName(one)
    return out


@query("turn_quota", q("SELECT session_id, count(*) AS used, count(*) >= 3 AS rejected FROM turns WHERE role = 'user' GROUP BY 1", "turns"))
def turn_quota(t):
    used = t("turns").where("role = 'user'").groupBy("session_id").agg(F.count("*").alias("used"))
    return used.withColumn("rejected", F.col("used") >= 3)


@query("session_list_scoped", q("SELECT id, session_id, title FROM sessions WHERE tenant_id = 2 AND user_id = 3 AND directory_id IS NOT DISTINCT FROM NULL ORDER BY id DESC LIMIT 100", "sessions"))
def session_list_scoped(t):
    """A tenant's and user's sessions outside any directory; without a knowledge base given, of all."""
    mine = (F.col("tenant_id") == 2) & (F.col("user_id") == 3) & F.col("directory_id").eqNullSafe(F.lit(None))
    return t("sessions").where(mine).orderBy(F.desc("id")).limit(100).select("id", "session_id", "title")


@query("history_owner", q(", f AS (SELECT session_id, arg_min(user_id, id) AS owner FROM turns GROUP BY 1) SELECT m.id, m.session_id FROM turns m JOIN f USING (session_id) WHERE f.owner = 3 AND m.user_id = 3 AND m.tenant_id IN (0, 3)", "turns"))
def history_owner(t):
    """Rows of the sessions that the user began, of their own and of their tenant or none."""
    owner = t("turns").groupBy("session_id").agg(F.min_by("user_id", "id").alias("owner")).where("owner = 3").select("session_id")
    return t("turns").where("user_id = 3 AND tenant_id IN (0, 3)").join(owner, "session_id", "left_semi").select("id", "session_id")


@query("entity_totals", q("SELECT 'tenant documents' AS what, tenant_id AS id, count(*) AS n FROM kb_documents GROUP BY 2 UNION ALL SELECT 'base documents', knowledge_base_id, count(*) FROM kb_documents GROUP BY 2 UNION ALL SELECT 'base directories', knowledge_base_id, count(*) FROM directories GROUP BY 2 UNION ALL SELECT 'tenants', 0, count(*) FROM tenants", "kb_documents", "directories", "tenants"))
def entity_totals(t):
    by = lambda df, key, what: df.groupBy(F.col(key).cast(BIG).alias("id")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "id", "n")
    tenants = t("tenants").agg(F.count("*").alias("n")).select(F.lit("tenants").alias("what"), F.lit(0).cast(BIG).alias("id"), "n")
    return by(t("kb_documents"), "tenant_id", "tenant documents").unionByName(by(t("kb_documents"), "knowledge_base_id", "base documents")).unionByName(by(t("directories"), "knowledge_base_id", "base directories")).unionByName(tenants)


@query("default_bases", q("SELECT u.id AS user_id, coalesce(k.name, 'default') AS name, k.id IS NULL AS created FROM users u LEFT JOIN knowledge_bases k ON k.id = u.id", "users", "knowledge_bases"))
def default_bases(t):
    """Each user's own base; who has none gets one. A base's id stands for its user's."""
    existing = t("knowledge_bases").select(F.col("id").alias("user_id"), "name").join(t("users").select(F.col("id").alias("user_id")), "user_id", "left_semi")
    return catalog.get_or_create(existing, t("users").select(F.col("id").alias("user_id"), F.lit("default").alias("name")), "user_id")


_ASKED = "SELECT session_id, tenant_id, user_id, CAST(7 AS BIGINT) AS knowledge_base_id, CAST(11 AS BIGINT) AS directory_id, 'asked' AS title FROM sessions WHERE id % 2 = 0 UNION ALL SELECT concat(session_id, 'x'), tenant_id, user_id, CAST(8 AS BIGINT), CAST(NULL AS BIGINT), 'new' FROM sessions WHERE id % 10 = 1"


@query("conversation_get_or_create", q(f", a AS ({_ASKED}) SELECT coalesce(s.session_id, a.session_id) AS session_id, coalesce(s.tenant_id, a.tenant_id) AS tenant_id, coalesce(s.user_id, a.user_id) AS user_id, coalesce(nullif(s.knowledge_base_id, 0), a.knowledge_base_id, s.knowledge_base_id) AS knowledge_base_id, coalesce(s.directory_id, a.directory_id) AS directory_id, coalesce(nullif(s.title, ''), a.title, s.title) AS title FROM sessions s FULL JOIN a ON a.session_id = s.session_id", "sessions"))
def conversation_get_or_create(t):
    s = t("sessions")
    known = s.where("id % 2 = 0").select("session_id", "tenant_id", "user_id", F.lit(7).cast(BIG).alias("knowledge_base_id"), F.lit(11).cast(BIG).alias("directory_id"), F.lit("asked").alias("title"))
    fresh = s.where("id % 10 = 1").select(F.concat("session_id", F.lit("x")).alias("session_id"), "tenant_id", "user_id", F.lit(8).cast(BIG).alias("knowledge_base_id"), F.lit(None).cast(BIG).alias("directory_id"), F.lit("new").alias("title"))
    return catalog.backfill(s, known.unionByName(fresh))


@query("cascade_tables", q(", gone AS (SELECT id FROM kb_documents WHERE knowledge_base_id = 4 AND status <> 'indexing') SELECT 'documents' AS name, count(*) AS n FROM kb_documents WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'chunks', count(*) FROM retrieval_hits WHERE doc_id NOT IN (SELECT CAST(id AS VARCHAR) FROM gone) UNION ALL SELECT 'builds', count(*) FROM index_builds WHERE document_id NOT IN (SELECT id FROM gone)", "kb_documents", "retrieval_hits", "index_builds"))
def cascade_tables(t):
    docs = t("kb_documents")
    left = catalog.cascade(docs, docs.where("knowledge_base_id = 4"), chunks=(t("retrieval_hits"), "doc_id"), builds=(t("index_builds"), "document_id"))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("label_affected", q(", old AS (SELECT user_message_id, doc_id FROM retrieval_labels WHERE knowledge_base_id = 7), fresh AS (SELECT DISTINCT user_message_id, CAST(CAST(doc_id AS BIGINT) + 1 AS VARCHAR) AS doc_id FROM old) SELECT DISTINCT doc_id FROM (SELECT doc_id FROM old UNION ALL SELECT doc_id FROM fresh)", "retrieval_labels"))
def label_affected(t):
    """The documents whose recall changes when a message's labels are replaced: the old ones and the new."""
    old = t("retrieval_labels").where("knowledge_base_id = 7").select("user_message_id", "doc_id")
    return quality.affected(old, old.select("user_message_id", (F.col("doc_id").cast(BIG) + 1).cast("string").alias("doc_id")))


@query("stats_touched", q(", touched AS (SELECT DISTINCT doc_id FROM retrieval_hits WHERE rank = 7) SELECT h.doc_id, count(DISTINCT CASE WHEN h.cited AND h.assistant_message_id > 0 THEN h.assistant_message_id END) AS cited_count FROM retrieval_hits h WHERE h.doc_id IN (SELECT doc_id FROM touched) GROUP BY 1", "retrieval_hits"))
def stats_touched(t):
    """Statistics of the documents that the last answers touched; the others are not read again."""
    return quality.refreshed(t("retrieval_hits"), t("retrieval_hits").where("rank = 7"))


@query("agent_index_answers", q("SELECT user_message_id, chunk, row_number() OVER (PARTITION BY user_message_id ORDER BY seen, chunk) AS number FROM (SELECT user_message_id, concat(doc_id, '-', CAST(chunk_index AS VARCHAR)) AS chunk, min(rank) AS seen FROM retrieval_hits GROUP BY 1, 2)", "retrieval_hits"))
def agent_index_answers(t):
    """Citation numbers of each answer's chunks, in the order in which its rounds first saw them."""
    seen = t("retrieval_hits").groupBy("user_message_id", F.concat_ws("-", "doc_id", "chunk_index").alias("chunk")).agg(F.min("rank").alias("seen"))
    order = Window.partitionBy("user_message_id").orderBy("seen", "chunk")
    return seen.select("user_message_id", "chunk", F.row_number().over(order).cast(BIG).alias("number"))


@query("lookups", q("SELECT 'document' AS what, CAST(id AS VARCHAR) AS key, status AS found FROM kb_documents WHERE id = 17 UNION ALL SELECT 'base', CAST(id AS VARCHAR), name FROM knowledge_bases WHERE id = 3 UNION ALL SELECT 'directory', CAST(id AS VARCHAR), name FROM directories WHERE id = 5 UNION ALL SELECT 'message', CAST(id AS VARCHAR), role FROM turns WHERE id = 1001 UNION ALL SELECT 'session', session_id, title FROM sessions WHERE session_id = 's7' UNION ALL SELECT 'tenant', code, CAST(max_files AS VARCHAR) FROM tenants WHERE code = 'asia' UNION ALL SELECT 'user', username, CAST(id AS VARCHAR) FROM users WHERE tenant_id = 2 AND username = 'u7' UNION ALL SELECT 'default tenant', CAST(min(id) AS VARCHAR), arg_min(code, id) FROM tenants", "kb_documents", "knowledge_bases", "directories", "turns", "sessions", "tenants", "users"))
def lookups(t):
    """Rows by key; each filter reaches its own scan."""
    one = lambda df, what, key, found: df.select(F.lit(what).alias("what"), F.col(key).cast("string").alias("key"), F.col(found).cast("string").alias("found"))
    first = t("tenants").agg(F.min("id").alias("id"), F.min_by("code", "id").alias("code"))
    parts = [
        one(t("kb_documents").where("id = 17"), "document", "id", "status"), one(t("knowledge_bases").where("id = 3"), "base", "id", "name"), one(t("directories").where("id = 5"), "directory", "id", "name"),
        one(t("turns").where("id = 1001"), "message", "id", "role"), one(t("sessions").where("session_id = 's7'"), "session", "session_id", "title"), one(t("tenants").where("code = 'asia'"), "tenant", "code", "max_files"),
        one(t("users").where("tenant_id = 2 AND username = 'u7'"), "user", "username", "id"), one(first, "default tenant", "id", "code"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("insert_users", q(", n AS (SELECT tenant_id, CASE WHEN id % 3 = 0 THEN username ELSE concat(username, 'n') END AS username FROM users WHERE id % 2 = 0) SELECT 'kept' AS what, count(*) AS n FROM users UNION ALL SELECT 'inserted', count(*) FROM n WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.tenant_id = n.tenant_id AND u.username = n.username) UNION ALL SELECT 'repeated', count(*) FROM n WHERE EXISTS (SELECT 1 FROM users u WHERE u.tenant_id = n.tenant_id AND u.username = n.username)", "users"))
def insert_users(t):
    """New rows enter one new snapshot; a key that is there already is refused and reported."""
    users = t("users").select("tenant_id", "username")
    rows = t("users").where("id % 2 = 0").select("tenant_id", F.when(F.col("id") % 3 == 0, F.col("username")).otherwise(F.concat("username", F.lit("n"))).alias("username"))
    table, repeated = catalog.insert(users, rows, "tenant_id", "username")
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    new = table.join(users, ["tenant_id", "username"], "left_anti")
    return count(users, "kept").unionByName(count(new, "inserted")).unionByName(count(repeated, "repeated"))


@query("queue_reclaim", q(", jobs AS (SELECT document_id AS doc_id, CAST(id % 3 + 1 AS INT) AS attempt, CAST(id % 2 AS INT) AS part FROM index_builds WHERE status IN ('pending', 'indexing')), every AS (SELECT * FROM jobs UNION ALL SELECT id, 1, 2 FROM kb_documents WHERE status IN ('pending', 'indexing')) SELECT doc_id, arg_min(attempt, part * 100 + attempt) AS attempt FROM every GROUP BY 1", "index_builds", "kb_documents"))
def queue_reclaim(t):
    open_jobs = t("index_builds").where(F.col("status").isin("pending", "indexing")).select(F.col("document_id").alias("doc_id"), (F.col("id") % 3 + 1).cast("int").alias("attempt"), (F.col("id") % 2).alias("part"))
    return catalog.reclaim(open_jobs.where("part = 0"), open_jobs.where("part = 1"), t("kb_documents"))


@query("chunk_meta", q("SELECT id, CASE WHEN tenant_id = 0 THEN '' ELSE CAST(tenant_id AS VARCHAR) END AS tenant, CAST(knowledge_base_id AS VARCHAR) AS kb, coalesce(CAST(directory_id AS VARCHAR), '0') AS directory, source <> '' AS source_available FROM kb_documents", "kb_documents"))
def chunk_meta(t):
    """What an index row carries of its document: ids as text, and whether the source can be read again."""
    m = retrieval.meta_id
    return t("kb_documents").select("id", m(F.col("tenant_id")).alias("tenant"), m(F.col("knowledge_base_id")).alias("kb"), m(F.col("directory_id"), optional=True).alias("directory"), (F.col("source") != "").alias("source_available"))


@query("leading_numbers", "SELECT page_id, coalesce(CAST(nullif(regexp_extract(regexp_extract(url, '([^/?]*)([?].*)?$', 1), '^[0-9]+'), '') AS BIGINT), 0) AS number FROM pages")
def leading_numbers(t):
    """The number that a page's address ends in; 0 without one."""
    return t("pages").select("page_id", leading_digits(F.regexp_extract("url", r"([^/?]*)(?:[?].*)?$", 1)).alias("number"))


@query("agent_messages", q(", x AS (SELECT session_id, 1 AS part, id, role, content FROM turns WHERE role IN ('user', 'assistant') AND trim(content) <> '' UNION ALL SELECT session_id, 2, 0, 'user', title FROM sessions UNION ALL SELECT session_id, 0, 0, 'system', concat('summary of ', title) FROM sessions WHERE title <> '') SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY part, id) AS n, role, md5(content) AS digest FROM x", "turns", "sessions"))
def agent_messages(t):
    """What a model is sent: the summary first, the turns, the question last."""
    s = t("sessions")
    sent = retrieval.agent_context(t("turns"), s.select("session_id", F.col("title").alias("query")), s.where("title <> ''").select("session_id", F.concat(F.lit("summary of "), "title").alias("summary")))
    return sent.select("session_id", "n", "role", F.md5("content").alias("digest"))


@query("deletable_bases", q("SELECT id FROM knowledge_bases k WHERE NOT EXISTS (SELECT 1 FROM kb_documents d WHERE d.knowledge_base_id = k.id AND d.status <> 'failed') AND NOT EXISTS (SELECT 1 FROM directories x WHERE x.knowledge_base_id = k.id)", "knowledge_bases", "kb_documents", "directories"))
def deletable_bases(t):
    """Bases without directories and without documents that are more than failed imports."""
    used = t("kb_documents").where("status <> 'failed'").select(F.col("knowledge_base_id").alias("id")).union(t("directories").select(F.col("knowledge_base_id").alias("id")))
    return t("knowledge_bases").select("id").join(used.where("id IS NOT NULL"), "id", "left_anti")
