"""Input relations: the raw Parquet tables and what is derived from them.

The derivations are plain SQL that Spark and DuckDB both accept; an oracle query
puts the same text in front of its own formulation of the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DERIVED = {
    "tenants": "SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, lower(r_name) AS code, CAST((r_regionkey * 7) % 11 AS INT) AS max_files FROM region",
    "knowledge_bases": "SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, CAST(n_regionkey + 1 AS BIGINT) AS tenant_id, n_name AS name FROM nation",
    "users": "SELECT c_custkey + 1 AS id, CAST(n_regionkey + 1 AS BIGINT) AS tenant_id, concat('u', CAST(c_custkey AS VARCHAR(20))) AS username, c_custkey % 17 <> 0 AS login_enabled FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "directories": "SELECT p_partkey + 1 AS id, CASE WHEN p_partkey = 0 THEN NULL ELSE CAST(floor((p_partkey + 1) / 2.0) AS BIGINT) END AS parent_id, CAST(1 AS BIGINT) AS knowledge_base_id, p_name AS name, p_size AS sort_order FROM part",
    "kb_documents": "SELECT doc_id + 1 AS id, doc_id % 5 + 1 AS tenant_id, doc_id % 25 + 1 AS knowledge_base_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 200 + 1 END AS directory_id, md5(text) AS content_md5, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('https://host.example/', CAST(doc_id AS VARCHAR(20)), '.md') END AS source, CASE doc_id % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'indexing' WHEN 2 THEN 'failed' ELSE 'ready' END AS status, text AS content FROM documents",
    "messages": "SELECT conv_id * 1000 + turn AS id, concat('s', CAST(conv_id AS VARCHAR(20))) AS session_id, conv_id % 5 + 1 AS tenant_id, role, text AS content FROM conversations",
    "retrieval_hits": "SELECT l_partkey % 5 + 1 AS tenant_id, l_partkey % 25 + 1 AS knowledge_base_id, l_orderkey + 1 AS user_message_id, CASE WHEN l_tax = 0.0 THEN 0 ELSE l_orderkey + 1000001 END AS assistant_message_id, 1 AS round, l_linenumber AS rank, CAST(l_partkey + 1 AS VARCHAR(20)) AS doc_id, CAST(l_suppkey % 20 AS INT) AS chunk_index, l_returnflag = 'R' AS cited FROM lineitem",
    "retrieval_labels": "SELECT DISTINCT l_partkey % 5 + 1 AS tenant_id, l_partkey % 25 + 1 AS knowledge_base_id, l_orderkey + 1 AS user_message_id, CAST(l_partkey + 1 AS VARCHAR(20)) AS doc_id FROM lineitem WHERE l_linestatus = 'O' UNION SELECT o_custkey % 5 + 1, o_custkey % 25 + 1, o_orderkey + 1, CAST(o_custkey + 1 AS VARCHAR(20)) FROM orders WHERE o_orderkey % 7 = 0",
    "index_builds": "SELECT event_id + 1 AS id, user_id + 1 AS document_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'indexing' WHEN 'signup' THEN 'pending' ELSE 'ready' END AS status, ts AS triggered_at, CASE WHEN event_type IN ('view', 'signup') THEN NULL ELSE ts + INTERVAL '5' MINUTE END AS finished_at FROM events UNION ALL SELECT event_id + 1000001, user_id + 1, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'indexing' WHEN 'signup' THEN 'pending' ELSE 'ready' END, ts + INTERVAL '1' SECOND, CASE WHEN event_type IN ('view', 'signup') THEN NULL ELSE ts + INTERVAL '5' MINUTE END FROM events WHERE event_id % 10 = 0",
    "sessions": "SELECT conv_id AS id, concat('s', CAST(conv_id AS VARCHAR(20))) AS session_id, conv_id % 5 + 1 AS tenant_id, conv_id % 7 + 1 AS user_id, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id % 25 + 1 END AS knowledge_base_id, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE conv_id % 200 + 1 END AS directory_id, CASE WHEN conv_id % 6 = 0 THEN '' ELSE concat('title ', CAST(conv_id AS VARCHAR(20))) END AS title FROM (SELECT DISTINCT conv_id FROM conversations) AS x",
    "turns": "SELECT conv_id * 1000 + turn AS id, concat('s', CAST(conv_id AS VARCHAR(20))) AS session_id, CASE WHEN turn % 3 = 1 THEN 0 ELSE conv_id % 5 + 1 END AS tenant_id, CASE WHEN turn % 5 = 4 THEN 99 ELSE conv_id % 7 + 1 END AS user_id, role, text AS content FROM conversations",
    "session_starts": "SELECT event_id AS id, user_id % 5 + 1 AS tenant_id, ts AS created_at FROM events WHERE event_type = 'signup'",
    "usage_events": "SELECT user_id % 5 + 1 AS tenant_id, ts, CASE event_type WHEN 'click' THEN 'voice' WHEN 'view' THEN 'tts' END AS kind FROM events WHERE event_type IN ('click', 'view')",
}


class Relations:
    """Tables of one folder by name, raw or derived, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in RAW:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        sql = DERIVED[name]
        needed = {t: self(t) for t in RAW if f" {t}" in f" {sql}".replace("\n", " ")}
        for table in needed:
            sql = sql.replace(f"FROM {table}", f"FROM {{{table}}}").replace(f"JOIN {table}", f"JOIN {{{table}}}")
        return self.spark.sql(sql, **{t: df for t, df in needed.items() if f"{{{t}}}" in sql})


def with_inputs(sql: str, *names: str) -> str:
    """The derivations `names` in front of an oracle query."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({DERIVED[n]})" for n in names) + " " + sql
