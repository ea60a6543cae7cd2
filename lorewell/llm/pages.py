"""HTML extraction by site style trees.

The pages of a host are merged into one tree. A node is an element at its place:
below its parent's place, in one presentation (the sequence of labels) of the
parent's branches. Three tables hold the tree, each aggregated in the tasks before
any shuffle: pages that have a node, pages that show its branches in a presentation,
and pages that have a text there.

Importance, with m pages at a node: of content, the mean over its distinct texts of
1 - log n / log m, n the pages with that text (0 if all pages repeat it, 1 if none
does); of presentation, the entropy of its presentations to base m; composite, (1 - g^l)
times the presentation's and g^l times the mean over branches, weighted by
presentation, g the decay and l the number of presentations. As composites are sums
of descendants' own importances with factors that multiply along the way down, they
are made by one join and two aggregations at any depth.

A branch is removed where it and all below it have a composite under `threshold`.
The highest such places of each host go back to its pages. Exact checks follow on
each page (`dom.article`): names that pages give themselves, and prose of an article
stays. The places are written; Spark broadcasts them while they are under the
session's threshold and else joins by shuffle, where a host of many pages is split.

Edge cases: null html is an empty text; pages without a host (null or relative url)
are one site; hosts with fewer than `min_pages` pages at a place remove nothing there
by importance; repeated pages count each; pages of any length are read whole; other
columns are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.llm import common, dom


@dataclass(frozen=True)
class PageParams:
    decay: float = 0.9
    #: A text that stands at a place of m pages on more than m ** (1 - threshold) of them counts against it.
    threshold: float = 0.5
    min_pages: int = 8
    #: Whether pages' own names for their parts are followed after the tree.
    named: bool = True
    #: Counts that a task gathers before it passes them on.
    task_counts: int = 200_000


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute url, else the empty string."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


NODE, STYLE, TEXT = 0, 1, 2
_COUNTS = "host string, kind int, place long, other long, many int, path array<long>, n long"


def _counts(pages: DataFrame, html: str, p: PageParams) -> DataFrame:
    """Pages by host and kind: (place, parent's presentation, -, path from the root), (place, presentation, its branches, -), (place, text, -, -)."""

    def told(counts: Counter) -> pa.RecordBatch:
        columns = zip(*((*key, n) for key, n in counts.items()))
        types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["host", "kind", "place", "other", "many", "path", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for host, page in zip(b.column(0), b.column(1)):
                counts.update(_seen(host.as_py(), page.as_py() or ""))
                if len(counts) > p.task_counts:
                    yield told(counts)
                    counts.clear()
        if counts:
            yield told(counts)

    made = pages.select(host_of(F.col("url")).alias("host"), F.col(html).alias("html")).mapInArrow(run, _COUNTS)
    return made.groupBy("host", "kind", "place", "other", "many").agg(F.first("path", ignorenulls=True).alias("path"), F.sum("n").alias("n"))


def _seen(host: str, page: str) -> set[tuple]:
    """What one page has, each once."""
    elements, blocks = dom.read(page)
    place, style = dom.places(elements)
    path: list[tuple[int, ...]] = [(place[0],)] * len(elements)
    seen = {(host, TEXT, place[k], dom.key_of(text), 0, None) for k, text in blocks}
    for k, e in enumerate(elements):
        if place[k] and (not k or place[k] != place[e.parent]):
            path[k] = (*path[e.parent], place[k]) if k else path[0]
            seen.add((host, NODE, place[k], style[e.parent][0] if k else 0, 0, path[k]))
            seen.add((host, STYLE, place[k], *style[k], None))
        else:
            path[k] = path[e.parent]
    return seen


def importance(counts: DataFrame, p: PageParams = PageParams()) -> DataFrame:
    """(host, place, parent, pages, composite, highest): the composite importance of every node, and the highest in its branch."""
    nodes = counts.where(F.col("kind") == NODE).select("host", "place", F.col("other").alias("shown"), "path", F.col("n").alias("pages"))
    texts = counts.where(F.col("kind") == TEXT).groupBy("host", "place").agg(F.count("*").alias("texts"), F.sum(F.log("n")).alias("text_logs"))
    styles = counts.where((F.col("kind") == STYLE) & (F.col("many") > 0)).groupBy("host", "place").agg(F.count("*").alias("l"), F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("n_logs"))
    joined = nodes.join(texts, ["host", "place"], "left").join(styles, ["host", "place"], "left")
    content = F.when(F.col("pages") > 1, 1 - F.col("text_logs") / F.col("texts") / F.log("pages")).otherwise(1.0)
    # entropy of shares n / all, from their sum of n log n
    shape = F.when(F.col("pages") > 1, F.least(F.lit(1.0), (F.log("all") - F.col("n_logs") / F.col("all")) / F.log("pages"))).otherwise(1.0)
    own = joined.select(
        "host", "place", "shown", "path", "pages", F.col("texts").isNotNull().alias("has_text"), F.pow(F.lit(p.decay), F.coalesce("l", F.lit(0))).alias("passed"),
        F.when(F.col("texts").isNotNull(), content).otherwise(F.coalesce((1 - F.pow(F.lit(p.decay), F.col("l"))) * shape, F.lit(0.0))).alias("own"), "all",
    )
    own = common.write_shared(own)
    # what a node passes to its parent: the parent's decay, the share of the presentation that it stands in, one of its branches
    shares = counts.where((F.col("kind") == STYLE) & (F.col("many") > 0)).select("host", F.col("place").alias("parent"), F.col("other").alias("shown"), "many", F.col("n").alias("shows"))
    above = own.select("host", F.col("place").alias("parent"), F.col("passed").alias("parent_passed"), F.col("has_text").alias("parent_text"), F.col("all").alias("parent_all"))
    parent = F.get("path", F.size("path") - 2)
    edges = (
        own.withColumn("parent", parent).where("parent IS NOT NULL").join(shares, ["host", "parent", "shown"]).join(above, ["host", "parent"])
        .select("host", "place", F.when(F.col("parent_text"), 0.0).otherwise(F.col("parent_passed") * F.col("shows") / F.col("parent_all") / F.col("many")).alias("factor"))
    )
    steps = own.select("host", "place", "path", "own", F.posexplode("path").alias("at", "step")).join(edges.withColumnRenamed("place", "step"), ["host", "step"], "left")
    ways = steps.groupBy("host", "place").agg(F.first("own").alias("own"), F.sort_array(F.collect_list(F.struct("at", "step", F.coalesce("factor", F.lit(1.0)).alias("factor")))).alias("way"))
    given = F.transform("way", lambda x: F.struct(x["step"].alias("place"), (F.col("own") * F.aggregate(F.filter("way", lambda y: y["at"] > x["at"]), F.lit(1.0), lambda a, y: a * y["factor"])).alias("part")))
    composite = ways.select("host", F.explode(given).alias("g")).groupBy("host", "g.place").agg(F.sum("g.part").alias("composite"))
    rated = own.withColumn("parent", parent).join(composite, ["host", "place"]).select("host", "place", "parent", "path", "pages", F.when(F.col("pages") >= p.min_pages, F.col("composite")).otherwise(1.0).alias("composite"))
    highest = rated.select("host", F.explode("path").alias("place"), "composite").groupBy("host", "place").agg(F.max("composite").alias("highest"))
    return rated.drop("path").join(highest, ["host", "place"])


def low_places(pages: DataFrame, html: str = "html", params: PageParams = PageParams()) -> DataFrame:
    """(host, low): the highest places of each host whose whole branch has little importance."""
    low = importance(common.write_shared(_counts(pages, html, params)), params).where(F.col("highest") < params.threshold).select("host", "place", "parent")
    tops = low.join(low.select("host", F.col("place").alias("parent")), ["host", "parent"], "left_anti")
    return tops.groupBy("host").agg(F.collect_list("place").alias("low"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", params: PageParams = PageParams(), out: str = "text") -> DataFrame:
    """The rows with the main text of each page as `out` (renamed where taken)."""
    plain, names = common.renamed(pages)
    at = {c: n for c, n in zip(pages.columns, names)}
    keyed = plain.withColumn("host", host_of(F.col(at[url])))
    model = common.write_shared(low_places(plain.select(F.col(at[url]).alias("url"), F.col(at[html]).alias("html")), params=params), rows=1)
    both = keyed.join(model, "host", "left").select(*names, "low")
    schema = T.StructType([*plain.schema.fields, T.StructField("_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = []
                for page, low in zip(part.column(names.index(at[html])), part.column(len(names))):
                    elements, blocks = dom.read(page.as_py() or "")
                    place, _ = dom.places(elements)
                    texts.append("\n\n".join(dom.article(elements, blocks, place, frozenset(low.as_py() or ()), params.named)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(texts, pa.string())], [*names, "_text"])

    return both.mapInArrow(run, schema).toDF(*pages.columns, *common.free_names([out], pages.columns))


def op13_pages(spark: SparkSession, sf_dir: str, params: PageParams = PageParams()) -> DataFrame:
    """The main text of every page."""
    done = extract(common.read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), params=params)
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
