"""Folders that driver and executors share, through Hadoop's file systems, so that any store works."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster has to be told one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strideline-"))
    return context.getCheckpointDir().get().rstrip("/")


#: Folders made by this process, until sweep.
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def sweep(spark: SparkSession) -> int:
    """Delete the folders that new_path gave since the last sweep, and say how many: for the end of a run, when nothing reads
    them any more. Checkpoints go with their DataFrames if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    n = len(_made)
    while _made:
        delete(spark, _made.pop())
    return n


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: what follows reads it as often as it likes, and a lost executor
    costs no recomputation of its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    p, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)
