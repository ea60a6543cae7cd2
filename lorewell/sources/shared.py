"""The folder that driver and executors share, lineage cuts into it, and tables kept on executors' disks."""

from __future__ import annotations

import atexit
import hashlib
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names; one of its own only on a single machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "/tmp/checkpoints"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for tables of one call; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if the session still runs."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has already ended
        pass


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def files(spark: SparkSession, path: str) -> int:
    """How many files are below a folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getFileCount()


def signature(df: DataFrame) -> str:
    """A name for the files that a table is read from as they are now: their paths, sizes and times."""
    spark = df.sparkSession
    told = hashlib.sha256()
    for file in sorted(df.inputFiles()):
        target = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target)
        told.update(f"{file} {status.getLen()} {status.getModificationTime()}\n".encode())
    return told.hexdigest()[:32]


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() to the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: computed once, and smaller there than a checkpoint."""
    path = scratch(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Kept(list):
    """Tables that are kept now; travels to workers empty."""

    def __reduce__(self):
        return list, ()


_kept = _Kept()


def held(df: DataFrame) -> DataFrame:
    """Keeps a table that is read more than once on the executors' disks; what a lost executor had is computed again."""
    _kept.append(df.persist(StorageLevel.DISK_ONLY))
    return _kept[-1]


def marks() -> int:
    """How many tables are kept now."""
    return len(_kept)


def release(since: int = 0) -> None:
    """Frees the tables that were kept after the first `since`: for when a result is written."""
    while len(_kept) > since:
        _kept.pop().unpersist()
