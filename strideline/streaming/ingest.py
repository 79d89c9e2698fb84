"""Incremental imports: batches merged into a snapshot that is partitioned by the hash of its key.

Below the snapshot's folder:

    data/v000000007/part=12/...     rows of partition 12 as batch 7 left them
    manifest/v000000007             part and version of every partition that has rows, after batch 7

A batch reads and rewrites only the partitions that its keys fall into; all others keep the version they had. Its manifest
is written last and is the pointer: readers follow the newest complete one. A batch that is replayed after a failure starts
from the manifest before it and overwrites the same folders, so the result is exactly once. Versions that none of the
KEEP newest manifests points to are deleted; a reader has so many batches' time to end.

The number of partitions is fixed by the first batch. Keys are compared null-safely. Only part numbers and versions, at most
one of each for a partition, come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources import storage

Merge = Callable[[DataFrame, DataFrame], DataFrame]
PARTS, KEEP = 64, 2
_MANIFEST = "part int, version int, parts int"


def version(folder: str, kind: str, batch: int) -> str:
    return f"{folder}/{kind}/v{batch:09d}"


def versions(spark: SparkSession, folder: str, kind: str = "manifest") -> list[int]:
    """Numbers of the versions there are; of manifests the complete ones."""
    names = [n for n in storage.children(spark, f"{folder}/{kind}") if n.startswith("v")]
    return [int(n[1:]) for n in names if kind != "manifest" or storage.exists(spark, f"{folder}/{kind}/{n}/_SUCCESS")]


def manifest(spark: SparkSession, folder: str, batch: int) -> tuple[dict[int, int], int | None]:
    """The version of each partition with rows after a batch, and the number of partitions."""
    rows = spark.read.schema(_MANIFEST).parquet(version(folder, "manifest", batch)).collect()
    return {r["part"]: r["version"] for r in rows if r["version"] is not None}, rows[0]["parts"]


def snapshot(spark: SparkSession, folder: str, schema: StructType, batch: int | None = None, parts: list[int] | None = None) -> DataFrame:
    """The rows after a batch (the newest by default), or those of some partitions; empty before the first."""
    known = versions(spark, folder)
    batch = (known[-1] if known else -1) if batch is None else batch
    held = manifest(spark, folder, batch)[0] if batch in known else {}
    paths = [f"{version(folder, 'data', v)}/part={p}" for p, v in sorted(held.items()) if parts is None or p in parts]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge_batch(new: DataFrame, batch: int, folder: str, schema: StructType, keys: list[str], merge: Merge, parts: int = PARTS, touching: DataFrame | None = None) -> list[int]:
    """Merge the rows of a batch, and return the partitions that were rewritten. merge: (old, new) -> rows of the snapshot, with
    the keys of either side where they are. touching: rows that hold all keys of the batch and are cheaper to read than new,
    which is then computed once."""
    spark = new.sparkSession
    before = [v for v in versions(spark, folder) if v < batch]
    held, known = manifest(spark, folder, before[-1]) if before else ({}, None)
    parts = known or parts
    of = F.pmod(F.xxhash64(*[F.col(k).cast(schema[k].dataType) for k in keys]), F.lit(parts)).cast("int")
    touched = sorted(r["part"] for r in (new if touching is None else touching).select(of.alias("part")).distinct().collect())
    if touched:
        old = snapshot(spark, folder, schema, before[-1], touched) if before else spark.createDataFrame([], schema)
        path = version(folder, "data", batch)
        # One shuffle by partition, so that each has one file at most a task.
        merge(old, new).select(*schema.fieldNames()).withColumn("part", of).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)
        left = {int(n[5:]) for n in storage.children(spark, path) if n.startswith("part=")}
        held = {p: v for p, v in held.items() if p not in touched} | {p: batch for p in left}
    rows = [(p, v, parts) for p, v in sorted(held.items())] or [(None, None, parts)]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(version(folder, "manifest", batch))
    retire(spark, folder)
    return touched


def retire(spark: SparkSession, folder: str, keep: int = KEEP) -> None:
    """Delete what none of the newest manifests points to."""
    known = versions(spark, folder)
    if not known:
        return
    alive = {(v, p) for batch in known[-keep:] for p, v in manifest(spark, folder, batch)[0].items()}
    for v in versions(spark, folder, "data"):
        # A version above the newest manifest belongs to a batch that is still being written.
        if v > known[-1]:
            continue
        path = version(folder, "data", v)
        names = [n for n in storage.children(spark, path) if n.startswith("part=")]
        dead = [n for n in names if (v, int(n[5:])) not in alive]
        for one in [path] if len(dead) == len(names) else [f"{path}/{n}" for n in dead]:
            storage.delete(spark, one)
    for batch in known[:-keep]:
        storage.delete(spark, version(folder, "manifest", batch))


def merge_stream(spark: SparkSession, incoming: str, schema: StructType, folder: str, checkpoint: str, keys: list[str], merge: Merge, format: str = "parquet", once: bool = True, parts: int = PARTS) -> StreamingQuery:
    """Merge new files in incoming into the snapshot, a version a micro-batch."""
    stream = spark.readStream.format(format).schema(schema).load(incoming)
    writer = stream.writeStream.foreachBatch(lambda new, number: merge_batch(new, number, folder, schema, keys, merge, parts) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
