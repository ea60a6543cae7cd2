"""Queries: message windows, token budgets and the plan for folding older turns."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.functions.text import approx_tokens, preview
from lorewell.operators import catalog, memory
from lorewell.plans.registry import query
from lorewell.sources.relations import with_inputs as q

_TOK = r"(CASE WHEN content = '' THEN 0 ELSE greatest(1, (length(content) - length(regexp_replace(content, '[\x00-\x7F]', '', 'g'))) // 4 + (length(regexp_replace(content, '[\x00-\x7F]', '', 'g')) * 2 + 2) // 3) END)"


@query("token_estimate", q(f"SELECT id, CAST({_TOK} AS BIGINT) AS tokens FROM messages", "messages"))
def token_estimate(t):
    return t("messages").select("id", approx_tokens(F.col("content")).alias("tokens"))


@query("recent_messages", q("SELECT id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS n FROM messages) WHERE n <= 3", "messages"))
def recent_messages(t):
    return memory.recent(t("messages"), 3).select("id", "session_id")


_BUDGET = f", s AS (SELECT *, sum({_TOK} + 4) OVER (PARTITION BY session_id ORDER BY id DESC ROWS UNBOUNDED PRECEDING) AS used FROM messages)"


@query("token_budget_fit", q(_BUDGET + " SELECT id, session_id, CAST(used AS BIGINT) AS used FROM s WHERE used <= 200", "messages"))
def token_budget_fit(t):
    return memory.fit_budget(t("messages"), 200).select("id", "session_id", "used")


@query("context_turns", q("SELECT id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS n, tenant_id % 2 = 0 AS short FROM messages) WHERE n <= CASE WHEN short THEN 2 ELSE 50 END", "messages"))
def context_turns(t):
    m = t("messages")
    return memory.context_source(memory.recent(m.where("tenant_id % 2 = 0"), 2), m, 50).select("id", "session_id")


@query("context_fold_plan", q(f", n AS (SELECT session_id, count(*) AS turns, sum({_TOK} + 4) AS tokens FROM messages GROUP BY 1) SELECT session_id, turns, CAST(tokens AS BIGINT) AS tokens, turns > 6 AND (turns >= 8 OR tokens > 300) AS fold, CASE WHEN turns > 6 AND (turns >= 8 OR tokens > 300) THEN turns - 6 ELSE 0 END AS folded FROM n", "messages"))
def context_fold_plan(t):
    return memory.fold_plan(t("messages"), keep=6, trigger=8, budget=300)


@query("session_titles", q("SELECT session_id, CASE WHEN length(content) > 40 THEN left(content, 40) || '...' ELSE content END AS title FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS n FROM messages WHERE role = 'user') WHERE n = 1", "messages"))
def session_titles(t):
    first = t("messages").where("role = 'user'").groupBy("session_id").agg(F.min_by("content", "id").alias("content"))
    return first.select("session_id", preview(F.col("content"), 40).alias("title"))


@query("prompt_messages", q("SELECT session_id, string_agg(role, ',' ORDER BY id) AS roles, count(*) AS turns FROM messages GROUP BY 1", "messages"))
def prompt_messages(t):
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "role"))), lambda x: x["role"]), ",")
    return t("messages").groupBy("session_id").agg(roles.alias("roles"), F.count("*").alias("turns"))


_COST = "CASE WHEN {s} = '' THEN 0 ELSE " + _TOK.replace("content", "{s}") + " + 8 END"
_SHRINK = "list_reduce(list_concat([title], list_transform(range(100), lambda z: '')), lambda s, z: CASE WHEN " + _COST.format(s="s") + " <= 40 THEN s WHEN length(s) <= 32 THEN '' ELSE concat(left(s, length(s) * 3 // 4), '…') END)"


@query("context_pack", q(f", h AS (SELECT session_id, concat(title, ' ', (SELECT left(min(t.content), sessions.id % 90) FROM turns t WHERE t.session_id = sessions.session_id)) AS title FROM sessions WHERE title <> '' UNION ALL SELECT session_id, '' FROM sessions WHERE title = ''), x AS (SELECT t.session_id, h.title, row_number() OVER w AS n, sum({_TOK} + 4) OVER w + {_COST.format(s='h.title')} AS used FROM turns t JOIN h USING (session_id) WINDOW w AS (PARTITION BY t.session_id ORDER BY t.id DESC)) SELECT h.session_id, {_SHRINK} AS summary, (SELECT count(*) FROM x WHERE x.session_id = h.session_id AND used <= 40 AND (h.title = '' OR n <= 5)) AS turns FROM h", "turns", "sessions"))
def context_pack(t):
    """Summaries of different lengths and turns, fitted into 40 tokens; with a summary at most five turns count."""
    first = t("turns").groupBy("session_id").agg(F.min("content").alias("text"))
    summary = F.concat("title", F.lit(" "), F.left("text", (F.col("id") % 90).cast("int")))
    summaries = t("sessions").where("title <> ''").join(first, "session_id").select("session_id", summary.alias("summary"))
    return memory.pack_context(t("turns"), summaries, keep=2, trigger=3, budget=40)[1]


@query("append_turns", q(", i AS (SELECT session_id, tenant_id, 'user' AS role, title AS content FROM sessions UNION ALL SELECT concat(session_id, 'x'), tenant_id, 'assistant', concat('a longer first message of the session ', session_id) FROM sessions), u AS (SELECT session_id, count(*) AS used FROM turns WHERE role = 'user' GROUP BY 1), r AS (SELECT t.id, (SELECT count(*) FROM session_starts s WHERE s.tenant_id = t.id) >= CASE WHEN t.max_files > 0 THEN t.max_files ELSE 5 END AS rejected FROM tenants t) SELECT i.session_id, CASE WHEN i.session_id NOT IN (SELECT session_id FROM sessions) AND r.rejected THEN 'session quota' WHEN i.role = 'user' AND coalesce(u.used, 0) >= 2 THEN 'turn quota' ELSE 'ok' END AS outcome, CASE WHEN length(content) > 40 THEN concat(left(content, 40), '...') ELSE content END AS title FROM i LEFT JOIN u USING (session_id) LEFT JOIN r ON r.id = i.tenant_id", "sessions", "turns", "session_starts", "tenants"))
def append_turns(t):
    s = t("sessions")
    old = s.select("session_id", "tenant_id", F.lit("user").alias("role"), F.col("title").alias("content"))
    new = s.select(F.concat("session_id", F.lit("x")).alias("session_id"), "tenant_id", F.lit("assistant").alias("role"), F.concat(F.lit("a longer first message of the session "), "session_id").alias("content"))
    starts = t("session_starts").groupBy("tenant_id").agg(F.count("*").alias("used"))
    room = catalog.quota(starts, t("tenants"), F.col("max_files"), "sessions")
    return memory.appended(old.unionByName(new), s, t("turns"), room, 2)


@query("session_gaps", "SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions FROM (SELECT user_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL '60' MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1")
def session_gaps(t):
    """Batch twin of the sliding hour after which a session's short-term list ends."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    late = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp")) > 3_600_000_000
    return t("events").select("user_id", (before.isNull() | late).cast("bigint").alias("new")).groupBy("user_id").agg(F.sum("new").alias("sessions"))
