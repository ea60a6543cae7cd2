"""Directory labels: reading order and subtree ranges by doubling steps towards the root.

In round k a directory knows its ancestor 2^k levels up and how many directories lie
below it within 2^k levels; the counts of those exactly 2^k levels below, summed, take
it to the next round. That gives sizes, depths and roots. A directory's number is that
of its parent, one, and the sizes of its earlier siblings: one sort, and the same steps
once more. A tree of depth d takes log2(d) rounds of equi-joins each time; directories
that have come to their root wait outside of them. Each round is written to the shared
folder, and only counts reach the driver.

With `pre` and `last` a subtree is a range: descendants of d are the directories of
the same root with d.pre <= pre <= d.last, a filter that reaches a scan of any table
that carries the number.

A directory whose parent is missing is a root. Null and repeated ids are left out,
the first by `sort_order` stands for those repeated. A cycle is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.sources.shared import stored


def _earlier(sizes: DataFrame) -> DataFrame:
    """(id, before): the sizes of earlier siblings, by `sort_order` and id, added up; from one global sort, so a parent of many children is split."""
    order = [F.col(c).asc_nulls_first() for c in ("parent", "sort_order", "id")]
    dealt = sizes.where("parent IS NOT NULL").select("parent", "sort_order", "id", "size").repartitionByRange(*order).sortWithinPartitions(*order).select("parent", "id", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums within the partition; a last row without id has what its last parent's children come to there."""
        number, last, total = TaskContext.get().partitionId(), None, 0
        told = lambda ids, parents, before: pa.RecordBatch.from_arrays([ids, pa.array(parents), pa.array(before), pa.array(np.full(len(parents), number))], ["id", "parent", "before", "part"])
        for b in batches:
            if not b.num_rows:
                continue
            parent, size = (b.column(c).to_numpy(zero_copy_only=False) for c in ("parent", "size"))
            through = np.cumsum(size)
            starts = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            run_of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(parent)]))
            base = (through - size)[starts]
            base[0] -= total if parent[0] == last else 0
            yield told(b.column("id"), parent, through - size - base[run_of])
            last, total = parent[-1], through[-1] - base[-1]
        if last is not None:
            yield told(pa.array([None], pa.int64()), np.array([last]), np.array([total]))

    found = stored(dealt.mapInArrow(run, "id long, parent long, before long, part long"))
    carried: dict[tuple[int, int], int] = {}
    edges = found.where("id IS NULL").orderBy("part").collect()  # one row for each partition
    for this, following in zip(edges, edges[1:]):
        carried[following.part, this.parent] = this.before + carried.get((this.part, this.parent), 0)
    more = found.sparkSession.createDataFrame([(*k, v) for k, v in carried.items()], "part long, parent long, more long")
    return found.where("id IS NOT NULL").join(F.broadcast(more), ["part", "parent"], "left").select("id", (F.col("before") + F.coalesce("more", F.lit(0).cast("long"))).alias("before"))


def _climbed(rows: DataFrame, most: int, step: Callable[[DataFrame, DataFrame], DataFrame], **ahead: Column) -> DataFrame:
    """Rows (id, up, ...) after rounds in which `up` doubles until it is null; `ahead` are the new columns, of the row and `_` columns of the one at `up`."""
    since = 0
    while rows.where("up IS NOT NULL").limit(1).count():
        if since > most.bit_length() + 1:
            raise ValueError("directories form a cycle")
        # all rows of a large directory have the same `up`: not to be broadcast by an estimate, split where it is skewed
        there = rows.select(F.col("id").alias("up"), *(F.col(c).alias(f"_{c}") for c in rows.columns if c != "id")).hint("merge")
        moved = rows.where("up IS NOT NULL").join(there, "up").select("id", F.col("_up").alias("up"), *(ahead.get(c, F.col(c)).alias(c) for c in rows.columns if c not in ("id", "up")))
        rows = stored(step(rows, moved.unionByName(rows.where("up IS NULL"))))
        since += 1
    return rows


def labels(directories: DataFrame) -> DataFrame:
    """(id, parent_id, root, pre, last, depth) of directories (id, parent_id, sort_order): `pre` from 1 within a root."""
    first = Window.partitionBy("id").orderBy(F.col("sort_order").asc_nulls_first(), F.col("parent_id").asc_nulls_first())
    rows = directories.where("id IS NOT NULL").select(F.col("id").cast("long"), F.col("parent_id").cast("long"), "sort_order").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    known = rows.select(F.col("id").alias("parent_id"), F.col("id").alias("parent")).hint("merge")
    nodes = stored(rows.where("parent_id IS NOT NULL").join(known, "parent_id", "left").select("id", "parent_id", "sort_order", "parent").unionByName(rows.where("parent_id IS NULL").select("id", "parent_id", "sort_order", F.lit(None).cast("long").alias("parent"))))
    n, one = nodes.count(), F.lit(1).cast("long")

    def counted(before: DataFrame, after: DataFrame) -> DataFrame:
        """What lies exactly as far below as `up` is above comes to the count."""
        below = before.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("_more")).hint("merge")
        return after.join(below, "id", "left").withColumn("size", F.col("size") + F.coalesce("_more", F.lit(0).cast("long"))).drop("_more")

    start = nodes.select("id", F.col("parent").alias("up"), one.alias("size"), F.col("parent").isNotNull().cast("long").alias("depth"), F.coalesce("parent", "id").alias("root"))
    sizes = _climbed(start, n, counted, depth=F.col("depth") + F.col("_depth"), root=F.col("_root"))
    whole = stored(nodes.join(sizes.drop("up").hint("merge"), "id"))
    earlier = _earlier(whole).hint("merge")
    numbered = stored(whole.select("id", F.col("parent").alias("up")).join(earlier, "id", "left").select("id", "up", (one + F.coalesce("before", F.lit(0).cast("long"))).alias("pre")))
    pre = _climbed(numbered, n, lambda before, after: after, pre=F.col("pre") + F.col("_pre")).select("id", "pre").hint("merge")
    return stored(whole.join(pre, "id").select("id", "parent_id", "root", "pre", (F.col("pre") + F.col("size") - 1).alias("last"), "depth"))


def below(labelled: DataFrame, root: int, pre: int, last: int) -> DataFrame:
    """The rows of a table that carries `root` and `pre` which lie in a subtree: a range that is pushed to the scan."""
    return labelled.where((F.col("root") == root) & (F.col("pre") >= pre) & (F.col("pre") <= last))
