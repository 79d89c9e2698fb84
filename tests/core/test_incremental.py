"""Snapshots by partition and summaries by increments, against full recomputation."""

import os
import random

import pytest
from pyspark.sql import functions as F, types as T

from strideline.operators import incremental, merge
from strideline.sources import storage
from strideline.streaming import ingest

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])


def step(old, new):
    return merge.merge(old, merge.pick(new, ["k"], ["n"], last=True), ["k"], {})


def state(spark, folder, **where):
    return {r["k"]: r["n"] for r in ingest.snapshot(spark, folder, SCHEMA, **where).collect()}


def files(folder, batch):
    path = f"{folder}/data/v{batch:09d}"
    return sorted(n for n in os.listdir(path) if n.startswith("part=")) if os.path.isdir(path) else []


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_one_key_rewrites_one_partition(spark, tmp_path):
    folder, keys = str(tmp_path / "s"), [f"k{i}" for i in range(200)]
    assert len(ingest.merge_batch(batch(spark, [(k, 1) for k in keys]), 0, folder, SCHEMA, ["k"], step, 8)) == 8
    assert ingest.merge_batch(batch(spark, [("k7", 5)]), 1, folder, SCHEMA, ["k"], step) == [int(files(folder, 1)[0][5:])]
    assert len(files(folder, 0)) == 8 and len(files(folder, 1)) == 1
    assert state(spark, folder) == {k: 5 if k == "k7" else 1 for k in keys}
    assert state(spark, folder, batch=0) == dict.fromkeys(keys, 1)


def test_replay_gives_the_same_rows_and_old_versions_go(spark, tmp_path):
    folder = str(tmp_path / "s")
    batches = [[("a", 1), ("b", 2), (None, 3)], [("a", 5), ("c", 7), ("c", 8)], [("a", 6)], [(None, 9), ("d", 1)]]
    for i, rows in enumerate(batches):
        ingest.merge_batch(batch(spark, rows), i, folder, SCHEMA, ["k"], step, 4)
        before = state(spark, folder)
        ingest.merge_batch(batch(spark, rows), i, folder, SCHEMA, ["k"], step, 4)
        assert state(spark, folder) == before
    assert before == {"a": 6, "b": 2, "c": 8, "d": 1, None: 9}
    assert ingest.versions(spark, folder) == [2, 3]
    alive = [ingest.manifest(spark, folder, v)[0] for v in (2, 3)]
    assert {(v, n) for v in range(4) for n in files(folder, v)} == {(v, f"part={p}") for m in alive for p, v in m.items()}
    assert state(spark, folder, batch=2) == {"a": 6, "b": 2, "c": 8, None: 3}


def test_a_batch_that_broke_off_is_started_again(spark, tmp_path):
    folder = str(tmp_path / "s")
    ingest.merge_batch(batch(spark, [("a", 1)]), 0, folder, SCHEMA, ["k"], step, 4)
    # Data without a manifest: what a lost driver leaves.
    batch(spark, [("z", 1)]).withColumn("part", F.lit(0)).write.partitionBy("part").parquet(f"{folder}/data/v000000001")
    assert state(spark, folder) == {"a": 1}
    ingest.merge_batch(batch(spark, [("b", 2)]), 1, folder, SCHEMA, ["k"], step)
    assert state(spark, folder) == {"a": 1, "b": 2}


def test_partitions_that_lose_all_rows(spark, tmp_path):
    folder = str(tmp_path / "s")
    ingest.merge_batch(batch(spark, [("a", 1)]), 0, folder, SCHEMA, ["k"], step, 4)
    ingest.merge_batch(batch(spark, [("a", 0)]), 1, folder, SCHEMA, ["k"], lambda old, new: step(old, new).filter("n > 0"))
    assert state(spark, folder) == {}
    ingest.merge_batch(batch(spark, []), 2, folder, SCHEMA, ["k"], step)
    ingest.merge_batch(batch(spark, [("b", 2)]), 3, folder, SCHEMA, ["k"], step)
    assert state(spark, folder) == {"b": 2} and state(spark, str(tmp_path / "none")) == {}


def test_merge_stream_is_exactly_once(spark, tmp_path):
    paths = {x: str(tmp_path / x) for x in ("in", "out", "ck")}
    for rows in ([("a", 1), ("b", 2)], [("a", 5), ("c", 7), ("c", 8)]):
        batch(spark, rows).coalesce(1).write.mode("append").parquet(paths["in"])
        ingest.merge_stream(spark, paths["in"], SCHEMA, paths["out"], paths["ck"], ["k"], step, parts=4).awaitTermination()
    assert state(spark, paths["out"]) == {"a": 5, "b": 2, "c": 8}


@pytest.mark.parametrize("seed", [1, 2])
def test_increments_equal_recomputation(spark, tmp_path, seed):
    rng, live = random.Random(seed), {}
    folder = str(tmp_path / "s")
    kind = "id long, place long, v long"
    for number in range(4):
        new, old = [], []
        for i in rng.sample(range(60), 25):
            if i in live:
                old.append(live.pop(i))
            if rng.random() < 0.8:
                live[i] = (i, rng.choice([1, 1, 2, 3, None]), rng.choice([None, rng.randrange(9)]))
                new.append(live[i])
        rows = incremental.signed(spark.createDataFrame(new, kind), spark.createDataFrame(old, kind))
        incremental.refresh(incremental.parts(rows, "place", {"n": F.lit(1), "v": F.col("v")}, {"v": F.col("v")}), number, folder, "place", 4)
        got = incremental.current(spark, folder, "place", "long")
        table = incremental.totals(got, "place", ["n", "v"]).join(incremental.extremes(got, "place", ["v"]).withColumnRenamed("place", "p"), F.col("place").eqNullSafe(F.col("p")))
        table = table.join(incremental.percentiles(got, "place", {"median": ("v", 0.5)}).withColumnRenamed("place", "q"), F.col("place").eqNullSafe(F.col("q")), "left").drop("p", "q")
        want = spark.createDataFrame(list(live.values()), kind).groupBy("place").agg(
            F.count("*").alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.min("v").cast("double").alias("min_v"), F.max("v").cast("double").alias("max_v"), F.count_distinct("v").alias("distinct_v"), F.percentile("v", F.lit(0.5)).alias("median"))
        key = lambda df: sorted(map(repr, (tuple(r[c] for c in want.columns) for r in df.collect())))
        assert key(table) == key(want)


def test_storage(spark, tmp_path):
    base = str(tmp_path)
    (tmp_path / "x" / "y").mkdir(parents=True)
    assert storage.children(spark, base) == ["x"] and storage.children(spark, f"{base}/no") == [] and storage.exists(spark, f"{base}/x")
    storage.delete(spark, f"{base}/x")
    assert not storage.exists(spark, f"{base}/x")
    one, two = storage.new_path(spark, "a"), storage.new_path(spark, "a")
    spark.range(3).write.parquet(one)
    assert one != two and storage.sweep(spark) >= 2 and not storage.exists(spark, one)


def test_an_increment_is_computed_once_if_told_what_it_touches(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for one in batches:
            seen.add(one.num_rows)
            yield one

    data = spark.createDataFrame([(i, i % 7, i % 3) for i in range(40)], "id long, place long, v long")
    rows = incremental.signed(data.mapInArrow(counted, data.schema))
    sums, values = {"n": F.lit(1), "v": F.col("v")}, {"v": F.col("v")}
    want = sorted(map(tuple, incremental.parts(incremental.signed(data), "place", sums, values).collect()), key=repr)
    folder = str(tmp_path / "s")
    touched = incremental.refresh(incremental.parts(rows, "place", sums, values, 3), 0, folder, "place", 4, data)
    assert seen.value == 40 and touched == files_of(folder, 0)
    assert sorted(map(tuple, incremental.current(spark, folder, "place", "long").collect()), key=repr) == want


def files_of(folder, number):
    return sorted(int(n[5:]) for n in files(folder, number))
