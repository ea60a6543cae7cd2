"""Connected components of a distributed graph, by alternating star contraction.

Every round links the neighbours of a node to its smallest neighbour, first the
larger ones and then the smaller, until each component is a star around its
smallest node. Rounds grow with the logarithm of the graph's diameter. Nothing
but a count and a checksum reaches the driver. While the links are few, a round's
smallest neighbours are broadcast: the driver plans a shuffle for each grouping and
none for the joins.

`contract` comes first where links are known by group: what it leaves are links
between the groups' roots, of which a node has as many as there are groups that
it is in, not as many as it has neighbours.

Edge cases: no links, links of a node with itself, and repeated links are fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.common import cut_lineage, files_for, held, near


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, int(row.h or 0)


def contract(stars: DataFrame) -> DataFrame:
    """(u, v) links between the roots that a node has, from rows with `roots`, all roots of a node, and `root`, the smallest."""
    return stars.where("size(roots) > 1").select(F.explode("roots").alias("u"), F.col("root").alias("v")).where("u != v")


def components(edges: DataFrame, max_rounds: int = 60, broadcast_rows: int = 100_000) -> DataFrame:
    """(node, root) for every node of `edges` (u, v); a root is its component's smallest node."""
    now = held(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    # the number of edges hardly changes: it says how many partitions the next ones need
    now = now.coalesce(files_for(state[0]))
    for _ in range(max_rounds):
        if not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        nodes = 2 * state[0]
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(near(least, nodes, broadcast_rows), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")  # a row for each edge at most
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near(least, nodes, broadcast_rows), "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(files_for(state[0])))
        before, state = state, _state(now)
        if state == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
