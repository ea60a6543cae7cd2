"""Mixing sources to target weights: temperature, then budgeted block permutations.

A source's share of all tokens is raised to an exponent between 0 (all sources
alike) and 1 (as they come). The exponent is bisected: the largest that reaches
the target entropy, raised where needed until no source repeats more often than
`max_repeats`. The normalised weights times the budget give each source's tokens.

A source is dealt into blocks of about `block_tokens` by a hash of its documents.
Each epoch of a source is a permutation of its blocks by a seeded hash; whole
epochs take all, the last one takes blocks in that order until the budget is
spent, and documents of the block where it ends by their hash. Prefix sums run
over slices of the permutation first and inside a slice then, so that no task
sees all blocks of a large source.

Only one number a document is gathered: texts are not shuffled. The table of
blocks to take is broadcast up to `broadcast_rows` rows and joined by shuffle
beyond. Up to `max_sources` sources are collected for the bisection; of more, each
step of it is one aggregation over their table.

Edge cases: a null or empty text has size 1 (its end), so it is dealt out too;
null and empty source are one source; repeated rows are dealt like any others;
an empty table gives an empty result. Tokens are words; a document's size is its
words and one end.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.llm import common

_RANGE = 1 << 30
_SLICES = 1 << 9


@dataclass(frozen=True)
class MixingParams:
    #: Target entropy as a share of that of equal weights.
    entropy: float = 0.97
    max_repeats: float = 3.0
    #: Tokens of the mixture as a multiple of those there are.
    budget: float = 1.0
    block_tokens: int = 1 << 15
    seed: int = 17
    max_sources: int = 200_000
    broadcast_rows: int = 400_000


def weights(tokens: list[float], exponent: float) -> list[float]:
    top = max(tokens)
    raised = [(t / top) ** exponent for t in tokens]
    total = sum(raised)
    return [x / total for x in raised]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def bisected(n: int, state: Callable[[float], tuple[float, float]], p: MixingParams) -> float:
    """The largest exponent with the target entropy, or the smallest above it that keeps the repetition limit.

    `state` gives the entropy of n sources and the most that one repeats, at an exponent.
    """

    def bisect(fine_at_low: Callable[[float], bool]) -> float:
        """The largest exponent for which `fine_at_low` holds, if it holds from 0 up to there."""
        low, high = 0.0, 1.0
        if fine_at_low(high):
            return high
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if fine_at_low(mid) else (low, mid)
        return low

    over = lambda a: state(a)[1] > p.max_repeats
    mixed = bisect(lambda a: state(a)[0] >= p.entropy * math.log(n) - 1e-12)
    return 1.0 if over(1.0) else max(mixed, bisect(over) if over(mixed) else 0.0)


def exponent(tokens: list[float], p: MixingParams) -> float:
    """`bisected` for sources of so many tokens."""
    budget = p.budget * sum(tokens)

    def state(a: float) -> tuple[float, float]:
        w = weights(tokens, a)
        return entropy(w), max(x * budget / t for x, t in zip(w, tokens))

    return bisected(len(tokens), state, p)


def plan(sizes: DataFrame, p: MixingParams) -> DataFrame:
    """(_source, _tokens, _take, _blocks): tokens, tokens to take and blocks of every source; `sizes` has source and size."""
    spark = sizes.sparkSession
    table = common.held(sizes.groupBy(F.col("source").alias("_source")).agg(F.sum("size").cast("double").alias("_tokens")))
    n, total, top = table.agg(F.count("*"), F.sum("_tokens"), F.max("_tokens")).first()
    if n > p.max_sources:
        share = F.col("_tokens") / top

        def summed(a: float) -> tuple[float, float]:
            raised = F.pow(share, F.lit(a))
            s, log, most = table.agg(F.sum(raised), F.sum(raised * F.log(raised)), F.max(raised / F.col("_tokens"))).first()
            return math.log(s) - log / s, most / s * p.budget * total

        a = bisected(n, summed, p)
        whole = table.agg(F.sum(F.pow(share, F.lit(a)))).first()[0]
        return table.select("_source", "_tokens", (F.pow(share, F.lit(a)) / whole * p.budget * total).alias("_take"), F.ceil(F.col("_tokens") / p.block_tokens).alias("_blocks"))
    found = sorted(table.collect(), key=lambda r: r._source)  # at most max_sources
    tokens = [r._tokens for r in found]

    w = weights(tokens, exponent(tokens, p)) if found else []
    rows = [(r._source, r._tokens, x * p.budget * total, max(1, math.ceil(r._tokens / p.block_tokens))) for r, x in zip(found, w)]
    return F.broadcast(spark.createDataFrame(rows, "_source string, _tokens double, _take double, _blocks long"))


def _dealt(documents: DataFrame, source: str, doc_id: str, text: str) -> list[Column]:
    body = F.coalesce(F.col(text), F.lit(""))
    return [F.coalesce(F.col(source), F.lit("")).alias("_source"), (F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long").alias("_size"), F.xxhash64(doc_id, text).alias("_hash")]


def mix(documents: DataFrame, p: MixingParams = MixingParams(), columns: tuple[str, ...] | None = None) -> DataFrame:
    """`columns` (all), epoch, block, tokens and mix_key of every document for each time that the mixture has it.

    Where a column has one of these names already, ours gets an underscore.
    Sorted by mix_key, any stretch of the mixture has about the target weights.
    """
    columns = columns or tuple(documents.columns)
    plain, names = common.renamed(documents)
    at = dict(zip(documents.columns, names))
    dealt = plain.select("*", *_dealt(plain, at["source"], at["doc_id"], at["text"]))
    slim = common.held(dealt.select(*(at[c] for c in columns if c != "text"), "_source", "_size", "_hash"))
    quota = plan(slim.select(F.col("_source").alias("source"), F.col("_size").alias("size")), p)

    def placed(df: DataFrame) -> DataFrame:
        return df.join(quota, "_source").withColumn("_block", F.pmod("_hash", F.col("_blocks")))

    blocks = placed(slim).groupBy("_source", "_block").agg(F.sum("_size").alias("_has"), F.first("_take").alias("_take"), F.first("_tokens").alias("_tokens"))
    many = quota.agg(F.coalesce(F.sum("_blocks"), F.lit(0))).first()[0]
    blocks = common.write_shared(blocks, rows=many)  # short rows in few files: what follows is planned without the tables behind them
    whole = F.floor(F.col("_take") / F.col("_tokens")).cast("int")
    epochs = blocks.withColumn("_whole", whole).withColumn("_epoch", F.explode(F.sequence(F.lit(0), "_whole")))
    epochs = epochs.withColumn("_order", F.pmod(F.xxhash64(F.lit(p.seed), "_source", "_epoch", "_block"), F.lit(_RANGE))).withColumn("_slice", F.floor(F.col("_order") * _SLICES / _RANGE).cast("int"))
    last = F.col("_epoch") == F.col("_whole")
    left = F.col("_take") - F.col("_whole") * F.col("_tokens")
    sums = epochs.where(last).groupBy("_source", "_slice").agg(F.sum("_has").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_source", "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_source", "_slice").orderBy("_order", "_block").rowsBetween(Window.unboundedPreceding, -1)
    partial = epochs.where(last).join(common.near(starts, many, p.broadcast_rows), ["_source", "_slice"]).withColumn("_room", left - F.col("_start") - F.coalesce(F.sum("_has").over(inside), F.lit(0)))
    repeats = F.col("_take") / F.col("_tokens")
    key = ((F.col("_epoch") + F.col("_order") / _RANGE) / F.greatest(repeats, F.lit(1e-9))).alias("_mix")
    taken = epochs.where(~last).withColumn("_room", F.col("_has").cast("double")).select("_source", "_block", "_epoch", "_room", "_has", key)
    taken = common.write_shared(taken.union(partial.where("_room > 0").select("_source", "_block", "_epoch", "_room", "_has", key)), rows=many)
    n_full, n_cut = taken.agg(F.count_if(F.expr("_room >= _has")), F.count_if(F.expr("_room < _has"))).first()
    full = common.near(taken.where("_room >= _has").drop("_room", "_has"), n_full, p.broadcast_rows)
    cut = common.near(taken.where("_room < _has").drop("_has"), n_cut, p.broadcast_rows)  # at most one block of each source

    wanted = [*(at[c] for c in columns), "_epoch", "_block", "_size", "_mix"]
    rows = placed(slim if "text" not in columns else dealt)
    every = rows.join(full, ["_source", "_block"]).select(*wanted)
    ties = F.xxhash64(*(at[c] for c in documents.columns if at[c] in rows.columns and c != "text"))  # rows of the same id and text
    spent = Window.partitionBy("_source", "_block").orderBy("_hash", ties).rowsBetween(Window.unboundedPreceding, -1)
    rest = rows.join(cut, ["_source", "_block"]).withColumn("_spent", F.coalesce(F.sum("_size").over(spent), F.lit(0))).where("_spent < _room").select(*wanted)
    return every.union(rest).toDF(*columns, *common.free_names(("epoch", "block", "tokens", "mix_key"), columns))


def op1_mixing(spark: SparkSession, sf_dir: str, params: MixingParams = MixingParams()) -> DataFrame:
    """The mixture of all documents: a row for each time that a document is in it."""
    return mix(common.read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), params, ("doc_id", "source"))
