"""Retrieval quality: recall of documents, citation counts, chunk ranks, golden scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.functions.text import let, trim_ws

#: Most anchors that are broadcast at once.
MAX_ANCHORS = 100_000
KEYS = ["tenant_id", "knowledge_base_id", "user_message_id", "doc_id"]


def recall_ratio(labeled: Column, hits: Column) -> Column:
    """hits / labeled, at most 1; null without labels."""
    return F.when(labeled > 0, F.least(hits, labeled) / labeled)


def doc_recall(labels: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Per document: labelled questions, those with a hit in the first k ranks, and their ratio.

    Hits are reduced to their keys before the join: many hits of one question and
    document are one, so the join does not fan out.
    """
    top = hits.where((F.col("rank") > 0) & (F.col("rank") <= k)).select(*KEYS).distinct().withColumn("hit", F.lit(1))
    joined = labels.select(*KEYS).distinct().join(top, KEYS, "left")
    found = joined.groupBy("tenant_id", "knowledge_base_id", "doc_id").agg(F.count("*").alias("labeled"), F.count("hit").alias("hits"))
    return found.withColumn("recall", F.round(recall_ratio(F.col("labeled"), F.col("hits")), 6))


def cited_counts(hits: DataFrame, *by: str) -> DataFrame:
    """Distinct answers that cite each group; answer 0 is none."""
    return hits.where(F.col("cited") & (F.col("assistant_message_id") > 0)).groupBy(*by).agg(F.count_distinct("assistant_message_id").alias("cited_count"))


def top_chunks(hits: DataFrame, n: int = 3) -> DataFrame:
    """The n most cited chunks of each document; ties by chunk."""
    counts = cited_counts(hits, "doc_id", "chunk_index").where((F.col("chunk_index") >= 0) & (F.col("cited_count") > 0))
    order = Window.partitionBy("doc_id").orderBy(F.desc("cited_count"), "chunk_index")
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def affected(old: DataFrame, new: DataFrame) -> DataFrame:
    """The documents (doc_id) of labels before and after they are replaced."""
    return old.select("doc_id").unionByName(new.select("doc_id")).distinct()


def refreshed(hits: DataFrame, fresh: DataFrame) -> DataFrame:
    """Citation counts anew for the documents that the fresh hits touch, and for no others."""
    touched = hits.join(fresh.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = cited_counts(touched, "doc_id")
    return touched.select("doc_id").distinct().join(counts, "doc_id", "left").select("doc_id", F.coalesce("cited_count", F.lit(0).cast("long")).alias("cited_count"))


def golden_cases(lines: DataFrame) -> DataFrame:
    """(id, query, doc_ids, titles, contains, tenant_id, knowledge_base_id, directory_id) from lines (line, raw) of JSON.

    Blank lines and notes after # are skipped; a case without an id is named after
    its line. A line that is no JSON, has no query or no criterion is an error.
    """
    lists = ("doc_ids", "titles", "contains")
    schema = "id string, query string, " + ", ".join(f"relevant_{x} array<string>" for x in lists) + ", tenant_id bigint, knowledge_base_id bigint, directory_id bigint"
    rows = lines.where(~trim_ws(F.col("raw")).rlike(r"(?s)\A(#.*)?\z")).select("line", F.from_json("raw", schema, {"mode": "FAILFAST"}).alias("j"))
    none = F.array().cast("array<string>")
    cases = rows.select("line", F.coalesce(F.nullif("j.id", F.lit("")), F.concat(F.lit("case-"), "line")).alias("id"), F.coalesce("j.query", F.lit("")).alias("query"), *(F.coalesce(f"j.relevant_{x}", none).alias(x) for x in lists), "j.tenant_id", "j.knowledge_base_id", "j.directory_id")
    wrong = F.when(trim_ws(F.col("query")) == "", "empty query").when(F.size(F.concat(*lists)) == 0, "no criterion")
    message = F.concat(F.lit("golden line "), "line", F.lit(": "), wrong)
    return cases.withColumn("query", F.when(wrong.isNull(), F.col("query")).otherwise(F.raise_error(message))).drop("line")


def case_scores(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Per case: hit, first rank, reciprocal rank, matched criteria and recall.

    ranked: (case_id, rank, content), and doc_id and title for criteria on them;
    expected: (case_id, criterion), and kind, one of 'doc_id', 'title' or
    'contains', which it is where there is no such column. A document's id is
    equal, titles and contents contain the trimmed criterion; blank ones match
    nothing but count as expected, as do repeated ones; recall is at most 1.
    """
    kind = F.col("kind") if "kind" in expected.columns else F.lit("contains")
    wanted = expected.groupBy("case_id").agg(F.count("*").alias("expected"))
    trimmed = F.when(kind == "doc_id", F.col("criterion")).otherwise(F.trim("criterion"))
    keys = expected.select("case_id", kind.alias("kind"), trimmed.alias("criterion")).where("criterion <> ''").distinct()
    fits = (F.col("kind") == "contains") & F.col("content").contains(F.col("criterion"))
    if "title" in ranked.columns:
        fits = fits | (F.col("kind") == "title") & F.col("title").contains(F.col("criterion"))
    if "doc_id" in ranked.columns:
        fits = fits | (F.col("kind") == "doc_id") & (F.col("doc_id").cast("string") == F.col("criterion"))
    found = ranked.join(keys, "case_id").where(fits).groupBy("case_id").agg(F.min("rank").alias("first_rank"), F.count_distinct("kind", "criterion").alias("matched"))
    none = F.lit(0).cast("long")
    return wanted.join(found, "case_id", "left").select(
        "case_id", F.col("first_rank").isNotNull().alias("hit"), F.coalesce("first_rank", none).alias("first_rank"),
        F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("rr"), F.coalesce("matched", none).alias("matched"), "expected",
        F.round(F.least(F.lit(1.0), F.coalesce("matched", none) / F.col("expected")), 6).alias("recall"),
    )


def _runs(words: Column, n: Column) -> Column:
    """Hashes of the runs of n words of a non-empty array; none if it is shorter."""
    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(n, F.slice(words, i, n)))).otherwise(none)


def containing(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(case_id, doc_id) where a document's content (doc_id, content) contains an item (case_id, item) as it is.

    What stands between an item's first and last gap is whole words of the
    document too, and its first such words, up to four, are the item's anchor. An
    item without inner words is anchored by its first characters, up to eight. A
    document keeps the anchors that some item has, so its text goes no further than
    to the items that share one. Empty items are left out.
    """
    words = F.split(F.col("item"), r"[\x20\t\n\r]+")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    some = items.where("item <> ''").select("case_id", "item", F.slice(inner, 1, 4).alias("words"))
    n, m = F.size("words"), F.least(F.length("item"), F.lit(8))
    keyed = some.select("case_id", "item", n.alias("n"), F.when(n > 0, 0).otherwise(m).alias("m"), F.when(n > 0, F.xxhash64(n, F.slice("words", 1, n))).otherwise(F.xxhash64(-m, F.left("item", m))).alias("anchor"))
    lengths = keyed.select("n", "m").distinct().collect()  # at most twelve

    text = F.col("content")
    own = lambda k: let(F.split(text, r"[\x20\t\n\r]+"), lambda w: _runs(w, F.lit(k)))
    kinds = [own(r.n) for r in lengths if r.n]
    grams = lambda k: F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.xxhash64(F.lit(-k), F.substring(text, i, F.lit(k))))).otherwise(F.array().cast("array<bigint>"))
    kinds += [grams(r.m) for r in lengths if r.m]
    if not kinds:
        return documents.select(F.lit(None).cast(items.schema["case_id"].dataType).alias("case_id"), "doc_id").limit(0)
    anchors = keyed.select("anchor").distinct()
    every = F.array_distinct(F.concat(*kinds))
    if anchors.count() <= MAX_ANCHORS:
        known = anchors.agg(F.collect_list("anchor").alias("known"))  # one row, bounded
        rows = documents.crossJoin(F.broadcast(known)).select("doc_id", "content", F.array_intersect("known", every).alias("anchors")).where("size(anchors) > 0")
        rows = rows.select("doc_id", "content", F.explode("anchors").alias("anchor")).join(keyed, "anchor")
    else:
        near = documents.select("doc_id", F.explode(every).alias("anchor")).join(keyed.select("anchor", "case_id", "item"), "anchor").select("doc_id", "case_id", "item").distinct()
        rows = documents.join(near, "doc_id")
    return rows.where(F.col("content").contains(F.col("item"))).select("case_id", "doc_id").distinct()
