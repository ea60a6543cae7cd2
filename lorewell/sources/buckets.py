"""Tables in hash buckets: an upsert reads and rewrites the buckets that its rows fall into, and no others.

A bucket is a partition of the table, by a hash of the key columns. Writes replace
whole buckets by dynamic partition overwrite, so files of other buckets stay as they
are; `append` leaves the files of its own buckets too. A bucket of many rows is dealt
out to several files. What reaches the driver is the numbers of the buckets touched,
at most `buckets` of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.sources.shared import exists, files, held, marks, release, remove


@dataclass(frozen=True)
class BucketTable:
    """A table at `path` of the columns of `schema`, its rows in `buckets` partitions by a hash of `keys`."""

    path: str
    keys: tuple[str, ...]
    schema: T.StructType
    buckets: int = 64
    #: Columns that the bucket depends on, if not on all keys.
    by: tuple[str, ...] = ()

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(self.by or self.keys)), F.lit(self.buckets)).cast("int")

    def read(self, spark: SparkSession, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows, of some buckets or of all; an empty table if nothing was written yet."""
        if not exists(spark, self.path):
            return spark.createDataFrame([], self.schema)
        folders = [self.path]
        if buckets is not None and len(buckets := [*buckets]) <= 32:  # more folders are listed by a job of their own
            folders = [f for n in buckets if exists(spark, f := f"{self.path}/_bucket={n}")]
        if not folders:
            return spark.createDataFrame([], self.schema)
        rows = spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])).option("basePath", self.path).parquet(*folders)
        return (rows if buckets is None else rows.where(F.col("_bucket").isin([*buckets]))).select(*self.schema.names)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows with the key columns fall into."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def write(self, rows: DataFrame, deal: bool = True) -> None:
        """Replaces the buckets that the rows fall into by those rows, dealt out by bucket first or, for few rows, as they are."""
        dealt = rows.select(*self.schema.names).withColumn("_bucket", self.bucket())
        if deal:
            # a number that is given stays: partitions are not put together again, so that a large bucket has several files
            dealt = dealt.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_bucket", *self.keys, F.xxhash64(*self.schema.names))
        dealt.sortWithinPartitions("_bucket", *self.keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)

    def append(self, rows: DataFrame) -> list[int]:
        """Adds rows beside those that the buckets have, as they are dealt out; gives the numbers of the buckets."""
        seen = Observation()
        dealt = rows.select(*self.schema.names).withColumn("_bucket", self.bucket())
        told = dealt.observe(seen, F.to_json(F.collect_set("_bucket")).alias("buckets"))
        told.sortWithinPartitions("_bucket").write.mode("append").partitionBy("_bucket").parquet(self.path)
        return sorted(json.loads(seen.get["buckets"] or "[]"))

    def files(self, spark: SparkSession, number: int) -> int:
        """How many files a bucket has."""
        return files(spark, f"{self.path}/_bucket={number}")

    def compact(self, spark: SparkSession, numbers: Iterable[int]) -> None:
        """Rewrites buckets with each of their rows once."""
        if numbers := [*numbers]:
            since = marks()
            self.write(held(self.read(spark, numbers).distinct()))
            release(since)

    def change(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replaces the touched buckets by `merge(their stored rows, rows)`; gives their numbers. A bucket that is left without rows goes."""
        since = marks()
        fresh = held(rows)
        numbers = self.touched(fresh)
        if numbers:
            merged = held(merge(self.read(rows.sparkSession, numbers), fresh))
            left = self.touched(merged)
            if left:
                self.write(merged)
            for number in set(numbers) - set(left):
                remove(rows.sparkSession, f"{self.path}/_bucket={number}")
        release(since)
        return numbers

    def upsert(self, rows: DataFrame) -> list[int]:
        """Rows replace those of the same keys; of several with the same keys the greatest stands."""
        others = [n for n in self.schema.names if n not in self.keys]
        one = rows.groupBy(*self.keys).agg(F.max(F.struct(*others)).alias("_r")).select(*self.keys, "_r.*") if others else rows.select(*self.keys).distinct()
        return self.change(one.select(*self.schema.names), lambda old, new: old.join(new.select(*self.keys), [*self.keys], "left_anti").select(*new.columns).unionByName(new))

    def delete(self, gone: DataFrame) -> list[int]:
        """Rows with the keys of `gone` go."""
        return self.change(gone.select(*self.keys).distinct(), lambda old, new: old.join(new, [*self.keys], "left_anti"))
