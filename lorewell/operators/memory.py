"""Conversation memory as windows over messages (id, session_id, role, content)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.functions.text import approx_tokens, preview, trim_ws
from lorewell.operators.models import Summarizer

#: Tokens that a turn costs besides its text.
TURN_COST = 4
#: Tokens that a summary costs besides its text.
SUMMARY_COST = 8
#: Times that a summary is cut at most: by then three quarters of any text are below 32 characters.
_CUTS = 100


def recent(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each session."""
    order = Window.partitionBy("session_id").orderBy(F.desc("id"))
    return messages.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).drop("n")


def fit_budget(messages: DataFrame, budget: int) -> DataFrame:
    """The longest suffix of each session that fits the budget; 0 or less means no limit."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    used = messages.withColumn("used", F.sum(approx_tokens(F.col("content")) + TURN_COST).over(newest))
    return used if budget <= 0 else used.where(F.col("used") <= budget)


def context_source(short: DataFrame, long: DataFrame, n: int) -> DataFrame:
    """A session's short-term turns if it has any, else its last n long-term ones."""
    rest = recent(long.join(short.select("session_id").distinct(), "session_id", "left_anti"), n)
    return short.unionByName(rest, allowMissingColumns=True)


def fold_plan(messages: DataFrame, keep: int = 6, trigger: int = 8, budget: int = 3000) -> DataFrame:
    """Per session whether older turns are folded into the summary, and how many."""
    totals = messages.groupBy("session_id").agg(F.count("*").alias("turns"), F.sum(approx_tokens(F.col("content")) + TURN_COST).alias("tokens"))
    over = F.col("tokens") > budget if budget > 0 else F.lit(False)
    fold = (F.col("turns") > keep) & ((F.col("turns") >= trigger) | over)
    return totals.select("session_id", "turns", "tokens", fold.alias("fold"), F.when(fold, F.col("turns") - keep).otherwise(0).cast("bigint").alias("folded"))


def summary_cost(summary: Column) -> Column:
    return F.when(summary != "", approx_tokens(summary) + SUMMARY_COST).otherwise(F.lit(0).cast("bigint"))


def shrunk(summary: Column, budget: int) -> Column:
    """A summary cut to three quarters until its cost fits; one of 32 characters or fewer goes entirely."""
    cut = lambda s: F.when(F.length(s) <= 32, "").otherwise(F.concat(F.left(s, F.floor(F.length(s) * 3 / 4).cast("int")), F.lit("…")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_CUTS)), summary, lambda s, _: F.when(summary_cost(s) <= budget, s).otherwise(cut(s)))


def load_summary(raw: Column) -> Column:
    """The content of a stored summary; what is no JSON is the summary itself."""
    return F.coalesce(F.get_json_object(raw, "$.content"), F.when(F.try_parse_json(raw).isNull(), trim_ws(raw)), F.lit(""))


def save_summaries(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(session_id, summary) after new ones replace those of their sessions."""
    return stored.join(new.select("session_id"), "session_id", "left_anti").select("session_id", "summary").unionByName(new.select("session_id", "summary"))


def fold(folded: DataFrame, summarizer: Summarizer) -> DataFrame:
    """(session_id, summary): each session's summary with its folded turns (session_id, summary, id, role, content) merged in.

    An empty or failed result keeps the summary that was there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for session, summary, turns in zip(rows["session_id"], rows["summary"], rows["turns"]):
                try:
                    new = summarizer.summarize(summary, [(t["role"], t["content"]) for t in turns])
                except Exception:  # the turns are left out, the summary stays
                    new = ""
                out.append((session, (new or "").strip() or summary))
            yield pd.DataFrame(out, columns=["session_id", "summary"])

    turns = F.array_sort(F.collect_list(F.struct("id", "role", "content"))).alias("turns")  # older turns of one session, at most those it keeps
    return folded.groupBy("session_id").agg(F.first("summary").alias("summary"), turns).mapInPandas(run, "session_id string, summary string")


def pack_context(messages: DataFrame, summaries: DataFrame, keep: int = 6, trigger: int = 8, budget: int = 3000, summarizer: Summarizer | None = None) -> tuple[DataFrame, DataFrame]:
    """What a model is sent of each session: its turns, and (session_id, summary, turns).

    With a summary, the last keep + trigger turns count. With a summarizer, turns
    beyond the last `keep` are folded where there are `trigger` of them or they cost
    more than the budget. Then the oldest turns go until the rest fits, and the
    summary shrinks if it does not fit alone; a budget of 0 or less is none.
    """
    known = messages.join(summaries.select("session_id", "summary"), "session_id", "left").withColumn("summary", F.coalesce("summary", F.lit("")))
    newest = Window.partitionBy("session_id").orderBy(F.desc("id"))
    turns = known.withColumn("n", F.row_number().over(newest)).where((F.col("summary") == "") | (F.col("n") <= keep + trigger))
    heads = messages.select("session_id").distinct().join(summaries.select("session_id", "summary"), "session_id", "left").withColumn("summary", F.coalesce("summary", F.lit("")))
    if summarizer is not None:
        cost = F.sum(approx_tokens(F.col("content")) + TURN_COST).over(Window.partitionBy("session_id")) + summary_cost(F.col("summary"))
        many = F.count("*").over(Window.partitionBy("session_id"))
        sized = turns.withColumn("_fold", (many > keep) & ((many >= trigger) | (F.lit(budget > 0) & (cost > budget))))
        old = sized.where(F.col("_fold") & (F.col("n") > keep))
        heads = save_summaries(heads, fold(old, summarizer))
        turns = sized.where(~F.col("_fold") | (F.col("n") <= keep)).drop("_fold", "summary").join(heads, "session_id")
    if budget > 0:
        used = F.sum(approx_tokens(F.col("content")) + TURN_COST).over(newest.rowsBetween(Window.unboundedPreceding, 0)) + summary_cost(F.col("summary"))
        turns = turns.withColumn("used", used).where(F.col("used") <= budget).drop("used")
        heads = heads.withColumn("summary", shrunk(F.col("summary"), budget))
    counts = turns.groupBy("session_id").agg(F.count("*").alias("turns"))
    packed = heads.join(counts, "session_id", "left").select("session_id", "summary", F.coalesce("turns", F.lit(0).cast("bigint")).alias("turns"))
    return turns.drop("n", "summary"), packed


def appended(incoming: DataFrame, sessions: DataFrame, messages: DataFrame, room: DataFrame, max_turns: int) -> DataFrame:
    """(session_id, outcome, title) of messages to append (session_id, tenant_id, role, content).

    A new session needs room in its tenant's quota (tenant_id, rejected), a user's
    message room among the session's turns.
    """
    there = sessions.select("session_id", F.lit(True).alias("_there")).distinct()
    used = messages.where("role = 'user'").groupBy("session_id").agg(F.count("*").alias("_used"))
    rows = incoming.join(there, "session_id", "left").join(used, "session_id", "left").join(room.select("tenant_id", "rejected"), "tenant_id", "left")
    outcome = (
        F.when(F.col("_there").isNull() & F.coalesce("rejected", F.lit(False)), "session quota")
        .when((F.col("role") == "user") & (F.coalesce("_used", F.lit(0)) >= max_turns), "turn quota").otherwise("ok")
    )
    return rows.select("session_id", outcome.alias("outcome"), preview(F.col("content"), 40).alias("title"))
