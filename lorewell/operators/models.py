"""Models that callers supply, and deterministic stand-ins.

A model runs inside Arrow batches on the workers. A failed batch is tried again
with doubled waits; what fails for good raises.
"""

from __future__ import annotations

import hashlib
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.sources.buckets import BucketTable
from lorewell.sources.shared import held, marks, release


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Expander(Protocol):
    def expand(self, query: str, n: int) -> list[str]: ...


class Reranker(Protocol):
    def rerank(self, query: str, texts: list[str]) -> list[float]: ...


class Summarizer(Protocol):
    def summarize(self, summary: str, turns: list[tuple[str, str]]) -> str: ...


class HashEmbedder:
    """Unit vectors from digests: the same text, the same vector."""

    def __init__(self, size: int = 16) -> None:
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        rows = [[b / 255 - 0.5 for b in hashlib.sha512(t.encode()).digest()[: self.size]] for t in texts]
        return [[x / (sum(y * y for y in r) ** 0.5 or 1) for x in r] for r in rows]


class OverlapReranker:
    """Scores a text by how many of the query's words, runs of letters and digits, it has."""

    def rerank(self, query: str, texts: list[str]) -> list[float]:
        words = lambda t: set(regex.findall(r"[\p{L}\p{Nd}]+", t.lower()))
        asked = words(query)
        return [float(len(asked & words(t))) for t in texts]


class HeadExpander:
    """One variant: the first words of the question."""

    def __init__(self, words: int = 6) -> None:
        self.words = words

    def expand(self, query: str, n: int) -> list[str]:
        return [" ".join(query.split()[: self.words])][:n]


class TailSummarizer:
    """Keeps the last words of what it is given."""

    def summarize(self, summary: str, turns: list[tuple[str, str]]) -> str:
        return " ".join(" ".join([summary, *(c for _, c in turns)]).split()[-40:]) or summary


def with_retries(call: Callable, retryable: Callable[[Exception], bool], retries: int = 2, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """The call's result; retryable errors wait 1, 2, 4, ... times `wait`, at most 16."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as e:
            if attempt == retries or not retryable(e):
                raise
            sleep(min(16.0, wait * 2**attempt))
    raise AssertionError


def overlapped(calls: Iterator[Callable], width: int) -> Iterator:
    """Results of the calls in their order, at most `width` running at once; no call begins `width` ahead of the result that is waited for."""
    with ThreadPoolExecutor(width) as pool:
        running: deque = deque()
        for call in calls:
            running.append(pool.submit(call))
            if len(running) == width:
                yield running.popleft().result()
        while running:
            yield running.popleft().result()


def embed_chunks(chunks: DataFrame, embedder: Embedder, batch: int = 16, retries: int = 2, retryable: Callable[[Exception], bool] = lambda e: False, concurrency: int = 2) -> DataFrame:
    """chunks with a column `embedding`, `batch` texts in each call and at most `concurrency` calls of a task at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = rows["content"].tolist()
            parts = (texts[k : k + batch] for k in range(0, len(texts), batch))
            calls = ((lambda part=part: with_retries(lambda: embedder.embed(part), retryable, retries)) for part in parts)
            yield rows.assign(embedding=[v for found in overlapped(calls, concurrency) for v in found])

    return chunks.mapInPandas(run, T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def embedding_cache(path: str, buckets: int = 64) -> BucketTable:
    """A table of vectors by the digest of their text."""
    return BucketTable(path, ("digest",), T.StructType([T.StructField("digest", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]), buckets)


def embed_once(chunks: DataFrame, embedder: Embedder, cache: BucketTable, **how: object) -> DataFrame:
    """chunks with a column `embedding`: each text that the cache does not have is embedded once, and kept there.

    `how` goes to `embed_chunks`. Only buckets of digests that are asked for are
    read, and only those of new ones rewritten.
    """
    spark, since = chunks.sparkSession, marks()
    keyed = chunks.withColumn("_digest", F.sha2(F.coalesce("content", F.lit("")), 256))
    texts = held(keyed.groupBy(F.col("_digest").alias("digest")).agg(F.first(F.coalesce("content", F.lit(""))).alias("content")))
    stored = cache.read(spark, cache.touched(texts)).select("digest")
    fresh = held(embed_chunks(texts.join(stored, "digest", "left_anti"), embedder, **how).select("digest", "embedding"))
    cache.upsert(fresh)
    release(since)
    return keyed.join(cache.read(spark).withColumnRenamed("digest", "_digest"), "_digest", "left").drop("_digest")
