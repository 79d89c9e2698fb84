"""Summaries kept up to date by increments instead of being computed anew.

A summary is kept as its additive parts: sums for each key, and for what isn't a sum (percentiles, least and greatest
values, distinct counts, modes) how often each value occurs. Rows that come in count once, rows that they replace count minus
once, so an increment is a small table of the same form; adding it to the parts of the keys it touches gives the parts of
all rows. Parts are kept in a snapshot partitioned by key (streaming.ingest), of which an increment rewrites only what it
touches, and the summary is derived from them.

Sums are exact for whole numbers and decimals. A key whose rows are all gone has count 0 and is dropped.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..streaming import ingest
from . import order

#: One form for sums (name, NULL, sum) and counted values (name, value, times).
PARTS = "name string, value double, n long"


def signed(new: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """Rows of an increment with __sign: 1 for new ones, -1 for those they replace."""
    out = new.withColumn("__sign", F.lit(1))
    return out if replaced is None else out.unionByName(replaced.select(*new.columns).withColumn("__sign", F.lit(-1)))


def parts(rows: DataFrame, key: str, sums: Mapping[str, Column], values: Mapping[str, Column], tasks: int | None = None) -> DataFrame:
    """key, name, value and n of signed rows: sums of whole numbers with a NULL value, and counted values. NULLs count for neither.
    tasks: how many the rows are dealt to by key before they become several each, which then move no more."""
    one = F.lit(None).cast("double")
    entries = [F.struct(F.lit(n).alias("name"), one.alias("value"), x.cast("long").alias("n")) for n, x in sums.items()]
    entries += [F.struct(F.lit(n).alias("name"), x.cast("double").alias("value"), F.when(x.isNotNull(), F.lit(1)).cast("long").alias("n")) for n, x in values.items()]
    long = (rows if tasks is None else rows.repartition(tasks, key)).select(key, "__sign", F.explode(F.array(*entries)).alias("e")).filter("e.n IS NOT NULL")
    return long.groupBy(key, F.col("e.name").alias("name"), F.col("e.value").alias("value")).agg(F.sum(F.col("e.n") * F.col("__sign")).alias("n"))


def add(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The parts of both; what adds up to nothing is dropped."""
    return old.unionByName(new).groupBy(key, "name", "value").agg(F.sum("n").alias("n")).filter("n != 0")


def _schema(key: str, kind: str) -> StructType:
    return StructType.fromDDL(f"{key} {kind}, {PARTS}")


def refresh(increment: DataFrame, batch: int, folder: str, key: str, partitions: int = ingest.PARTS, touching: DataFrame | None = None) -> list[int]:
    """Fold an increment's parts into those kept in folder, and return the partitions that were rewritten. A batch that is
    replayed changes nothing. touching: rows that hold all keys of the increment, if cheaper to read than it is to compute."""
    schema = _schema(key, dict(increment.dtypes)[key])
    return ingest.merge_batch(increment, batch, folder, schema, [key], lambda old, new: add(old, new, key), partitions, touching)


def current(spark: SparkSession, folder: str, key: str, kind: str, batch: int | None = None) -> DataFrame:
    """The parts kept in folder; kind: the key's type."""
    return ingest.snapshot(spark, folder, _schema(key, kind), batch)


def totals(state: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key and the sums of these names; 0 where a key has none."""
    wanted = F.col("value").isNull() & F.col("name").isin(*names)
    return state.groupBy(key).agg(*[F.coalesce(F.sum(F.when(wanted & (F.col("name") == n), F.col("n"))), F.lit(0)).alias(n) for n in names])


def extremes(state: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key and the least, greatest and number of distinct values of each name: min_, max_ and distinct_."""
    own = lambda n: F.when((F.col("name") == n) & F.col("value").isNotNull() & (F.col("n") > 0), F.col("value"))
    return state.groupBy(key).agg(*[x for n in names for x in (F.min(own(n)).alias(f"min_{n}"), F.max(own(n)).alias(f"max_{n}"), F.count(own(n)).alias(f"distinct_{n}"))])


def percentiles(state: DataFrame, key: str, wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """key and exact interpolated percentiles: name -> (name of the counted values, p)."""
    names = sorted({n for n, _ in wanted.values()})
    counts = state.filter(F.col("value").isNotNull() & F.col("name").isin(*names) & (F.col("n") > 0)).select(key, "name", "value", "n")
    return order.percentiles_of_counts(counts, key, wanted)
