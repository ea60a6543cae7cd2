"""Listing, access, quota and directory operators over the service tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.sources.shared import cut_lineage

DEFAULT_LIMIT = 5


def effective_limit(limit: Column, fallback: int = DEFAULT_LIMIT) -> Column:
    """A stored limit of 0 or less means the default."""
    return F.when(limit > 0, limit).otherwise(F.lit(fallback))


def page(df: DataFrame, number: int, size: int, default: int, *order: Column | str) -> DataFrame:
    """One page of an ordered list; a page below 1 is the first, a size outside 1..100 the default."""
    number, size = max(1, number), size if 0 < size <= 100 else default
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def documents_where(df: DataFrame, **equal: object) -> DataFrame:
    """Optional equality filters; None leaves a column alone."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def since_midnight(ts: Column, now: Column) -> Column:
    """Whether a UTC time is on the local day of `now`, or later."""
    return shanghai(ts) >= F.date_trunc("day", shanghai(now))


def quota(used: DataFrame, tenants: DataFrame, limit: Column, kind: str) -> DataFrame:
    """(tenant_id, kind, used, max, rejected, remaining) of every tenant, from counts (tenant_id, used)."""
    rows = tenants.select(F.col("id").alias("tenant_id"), effective_limit(limit).cast("bigint").alias("max")).join(used, "tenant_id", "left")
    count = F.coalesce("used", F.lit(0).cast("bigint"))
    return rows.select("tenant_id", F.lit(kind).alias("kind"), count.alias("used"), "max", (count >= F.col("max")).alias("rejected"), F.greatest(F.lit(0).cast("bigint"), F.col("max") - count).alias("remaining"))


def get_or_create(existing: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The existing rows, and those wanted whose keys none of them has; columns that are missing are null, and a null key is a key like any other."""
    there = existing.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    fresh = wanted.dropDuplicates(list(keys)).join(there, same, "left_anti")
    return existing.withColumn("created", F.lit(False)).unionByName(fresh.withColumn("created", F.lit(True)), allowMissingColumns=True)


def insert(existing: DataFrame, rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """The table with the rows whose keys are new, as one new snapshot; and the rows that repeat a key."""
    first = Window.partitionBy(*keys).orderBy(*([c for c in rows.columns if c not in keys] or keys))
    numbered = rows.withColumn("_n", F.row_number().over(first))
    fresh = numbered.where("_n = 1").drop("_n").join(existing.select(*keys), list(keys), "left_anti")
    repeated = numbered.join(existing.select(*keys, F.lit(True).alias("_old")).distinct(), list(keys), "left").where("_n > 1 OR _old").drop("_n", "_old")
    return existing.unionByName(fresh, allowMissingColumns=True), repeated


def backfill(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """Sessions as asked for: those there keep what they have and take a base of 0, a missing directory and an empty title from the request."""
    new = asked.select("session_id", *(F.col(c).alias(f"_{c}") for c in ("tenant_id", "user_id", "knowledge_base_id", "directory_id", "title")))
    return sessions.join(new, "session_id", "full").select(
        "session_id", F.coalesce("tenant_id", "_tenant_id").alias("tenant_id"), F.coalesce("user_id", "_user_id").alias("user_id"),
        F.coalesce(F.nullif("knowledge_base_id", F.lit(0)), "_knowledge_base_id", "knowledge_base_id").alias("knowledge_base_id"),
        F.coalesce("directory_id", "_directory_id").alias("directory_id"), F.coalesce(F.nullif("title", F.lit("")), "_title", "title").alias("title"),
    )


def cascade(documents: DataFrame, gone: DataFrame, **dependents: tuple[DataFrame, str]) -> dict[str, DataFrame]:
    """New snapshots of the documents and of each dependent table (name = (table, its document column)) without `gone` (id).

    A document that is being indexed is not deleted, nor is what depends on it.
    """
    sure = gone.select("id").join(documents.where("status <> 'indexing'").select("id"), "id", "left_semi")
    out = {"documents": documents.join(sure, "id", "left_anti")}
    for name, (table, column) in dependents.items():
        keys = sure.select(F.col("id").cast(table.schema[column].dataType).alias(column))
        out[name] = table.join(keys, column, "left_anti")
    return out


def reclaim(active: DataFrame, queued: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, attempt): what a restarted queue holds, each document once.

    Jobs that were being worked on go back with their attempt, before those that
    waited; documents that the tables say are pending or indexing are added.
    """
    jobs = active.select("doc_id", "attempt", F.lit(0).alias("part")).unionByName(queued.select("doc_id", "attempt", F.lit(1).alias("part")))
    left = documents.where(F.col("status").isin("pending", "indexing")).select(F.col("id").alias("doc_id"), F.lit(1).alias("attempt"), F.lit(2).alias("part"))
    every = jobs.unionByName(left).where("doc_id > 0")
    return every.groupBy("doc_id").agg(F.min_by("attempt", F.struct("part", "attempt")).alias("attempt"))


def shanghai(ts: Column) -> Column:
    """Local wall time of a UTC time without zone."""
    return F.from_utc_timestamp(ts.cast("timestamp"), "Asia/Shanghai")


def descendants(directories: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, depth) of each root and all below it, at any depth.

    Steps double: what is found down to depth 2^k, joined with every directory's
    ancestor 2^k levels up, is what lies 2^k levels deeper. A tree of depth d takes
    log2(d) rounds of two equi-joins; each round is cut off to the shared folder,
    and only counts reach the driver. A root in a cycle never ends: steps beyond
    the number of directories are an error.
    """
    up = directories.where("parent_id IS NOT NULL").select(F.col("id").alias("child"), F.col("parent_id").alias("above"))
    found = directories.join(roots.select(F.col("id").alias("root")), F.col("id") == F.col("root"), "left_semi").select(F.col("id").alias("root"), "id", F.lit(0).cast("long").alias("depth"))
    all_of_them, known, step = directories.count(), 0, 1
    while True:
        deeper = found.join(up, F.col("id") == F.col("above")).select("root", F.col("child").alias("id"), (F.col("depth") + step).alias("depth"))
        found = cut_lineage(found.union(deeper).coalesce(_parts(directories)))
        before, known = known, found.count()
        if known == before:
            return found
        if step > all_of_them:
            raise ValueError("directories form a cycle")
        middle = up.select(F.col("child").alias("middle"), F.col("above").alias("top"))
        up = cut_lineage(up.join(middle, F.col("above") == F.col("middle")).select("child", F.col("top").alias("above")).coalesce(_parts(directories)))
        step *= 2


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def base_access(bases: DataFrame, tenant: int, user: int) -> DataFrame:
    """(id, can_read, can_write) of knowledge bases (id, tenant_id, user_id): one's tenant reads, the owner writes."""
    mine = F.col("tenant_id") == tenant
    return bases.select("id", mine.alias("can_read"), (mine & (F.col("user_id") == user)).alias("can_write"))


def directory_access(directories: DataFrame, bases: DataFrame, tenant: int, user: int) -> DataFrame:
    """(id, can_read, can_write) of directories (id, tenant_id, knowledge_base_id): as their base lets its owner write; one of tenant 0 is read as its base is."""
    of_base = base_access(bases, tenant, user).select(F.col("id").alias("knowledge_base_id"), F.col("can_read").alias("_read"), F.col("can_write").alias("_write"))
    rows = directories.join(of_base, "knowledge_base_id", "left")
    none = F.lit(False)
    read = (F.col("tenant_id") == tenant) | ((F.col("tenant_id") == 0) & F.coalesce("_read", none))
    return rows.select("id", read.alias("can_read"), (read & F.coalesce("_write", none)).alias("can_write"))


def build_history(builds: DataFrame, limit: int = 0) -> DataFrame:
    """Each document's newest builds first; a limit of 0 or less, or above 200, means 100."""
    order = Window.partitionBy("document_id").orderBy(F.desc("triggered_at"), F.desc("id"))
    return builds.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= (limit if 0 < limit <= 200 else 100))


OPEN = ("pending", "indexing")


def log_builds(builds: DataFrame, events: DataFrame) -> DataFrame:
    """The build log (id, document_id, status, triggered_at, finished_at, error) after events (document_id, seq, kind, status, at, error).

    ensure: opens a pending build if the document has no open one. begin: the open
    build is indexing now, or a new one is. note: the open build gets an error.
    finish: the open build ends with the event's status and error; without an open
    one nothing happens. Events of a document are folded in order of `seq`, from its
    newest open build; ids of new builds follow the largest there is.
    """
    order = Window.partitionBy("document_id").orderBy(F.desc("triggered_at"), F.desc("id"))
    is_open = F.col("status").isin(*OPEN)
    latest = builds.where(is_open).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    row = "struct<id: bigint, status: string, triggered_at: timestamp, finished_at: timestamp, error: string>"
    start = latest.select("document_id", F.struct("id", "status", F.col("triggered_at").cast("timestamp"), F.col("finished_at").cast("timestamp"), "error").cast(row).alias("now"))
    steps = events.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "status", F.col("at").cast("timestamp").alias("at"), "error"))).alias("steps"))  # what one batch says of a document
    none = F.lit(None)
    made = lambda status, at: F.struct(none.cast("bigint").alias("id"), F.lit(status).alias("status"), at.alias("triggered_at"), none.cast("timestamp").alias("finished_at"), none.cast("string").alias("error"))
    changed = lambda now, **new: F.struct(*(new.get(c, now[c]).alias(c) for c in ("id", "status", "triggered_at", "finished_at", "error")))

    def fold(acc: Column, e: Column) -> Column:
        now, done = acc["now"], acc["done"]
        begun = F.when(now.isNull(), made("indexing", e["at"])).otherwise(changed(now, status=F.lit("indexing")))
        after = (
            F.when(e["kind"] == "ensure", F.coalesce(now, made("pending", e["at"]))).when(e["kind"] == "begin", begun)
            .when(now.isNull(), now).when(e["kind"] == "note", changed(now, error=e["error"])).when(e["kind"] == "finish", F.lit(None).cast(row)).otherwise(now)
        )
        ended = F.when((e["kind"] == "finish") & now.isNotNull(), F.concat(done, F.array(changed(now, status=e["status"], finished_at=e["at"], error=F.coalesce(e["error"], now["error"]))))).otherwise(done)
        return F.struct(after.cast(row).alias("now"), ended.cast(f"array<{row}>").alias("done"))

    folded = steps.join(start, "document_id", "left").withColumn("r", F.aggregate("steps", F.struct(F.col("now"), F.array().cast(f"array<{row}>").alias("done")), fold))
    out = folded.select("document_id", F.explode(F.concat(F.col("r.done"), F.filter(F.array("r.now"), lambda x: x.isNotNull()))).alias("b")).select("document_id", "b.*")
    kept = builds.select("id", "document_id", "status", F.col("triggered_at").cast("timestamp").alias("triggered_at"), F.col("finished_at").cast("timestamp").alias("finished_at"), "error")
    fresh, old = out.where("id IS NULL"), out.where("id IS NOT NULL")
    most = builds.agg(F.coalesce(F.max("id"), F.lit(0)).alias("most"))
    # new builds are few beside the log: one for each document and opening
    numbered = fresh.withColumn("_k", F.row_number().over(Window.orderBy("triggered_at", "document_id"))).join(F.broadcast(most)).withColumn("id", F.col("most") + F.col("_k")).select(*kept.columns)
    return kept.join(old.select("id"), "id", "left_anti").unionByName(old.select(*kept.columns)).unionByName(numbered)


def index_build_dedup(builds: DataFrame, seconds: int = 2) -> DataFrame:
    """Drops a build that began less than `seconds` after an earlier id with the same document, status and end.

    A theta self-join would compare all builds of a document. Times are dealt into
    buckets of `seconds` instead, so a build meets those of its own bucket and the
    one before. Compares with the original rows, not with what is left.
    """
    micros = F.unix_micros(F.col("triggered_at").cast("timestamp"))
    keyed = builds.withColumn("at", micros).withColumn("bucket", F.floor(micros / (seconds * 1_000_000)))
    early = keyed.select("id", "document_id", "status", "at", "finished_at", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    a, b = keyed.alias("a"), early.alias("b")
    gap = F.col("a.at") - F.col("b.at")
    same = (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.status") == F.col("b.status")) & (F.col("a.bucket") == F.col("b.bucket")) & F.col("a.finished_at").eqNullSafe(F.col("b.finished_at"))
    return a.join(b, same & (F.col("a.id") > F.col("b.id")) & (gap >= 0) & (gap < seconds * 1_000_000), "left_anti").drop("bucket", "at")
