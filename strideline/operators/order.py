"""Order without a global sort: exact ranks, percent ranks and percentiles from counts of values.

Equal values are counted first, with partial sums before the shuffle, so a very common value is one row. The counted
values of a column and group are dealt to ranges; within a range counts are summed up in order, and what lies in the ranges
before it is added. The ranges' edges are the values whose hash is 0 modulo RANGE, so a range holds about RANGE distinct values
however many there are, the same ones on every run, and only a row a range meets in one task. A group of few values is
one range. Values are compared as doubles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Distinct values of a range; edges of a group beyond which only every k-th is taken, as each value looks through them.
RANGE, MOST_EDGES = 1 << 16, 1 << 12
_BY = ["name", "grp"]


def melt(df: DataFrame, columns: Mapping[str, tuple[str, str | None]], *keep: str) -> DataFrame:
    """keep, name, grp and value: one row for each row and entry of columns: name -> (column, group or None)."""
    group = lambda g: F.lit("") if g is None else F.coalesce(F.concat(F.lit("g"), F.col(g).cast("string")), F.lit("none"))
    entries = [F.struct(F.lit(n).alias("name"), group(g).alias("grp"), F.col(c).cast("double").alias("value")) for n, (c, g) in columns.items()]
    return df.select(*keep, F.explode(F.array(*entries)).alias("e")).select(*keep, "e.*")


def running(melted: DataFrame, by: Sequence[str] = _BY) -> DataFrame:
    """by, value, n, up_to (values up to this one) and known (values in all) of every distinct value; NULLs don't count."""
    return running_counts(melted.filter("value IS NOT NULL").groupBy(*by, "value").agg(F.count("*").alias("n")), by)


def running_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """As running, of counted values: by, value and n."""
    by = list(by)
    same = lambda a, b, cols: [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}")) for x in cols]
    edges = counts.filter(F.pmod(F.xxhash64("value"), F.lit(RANGE)) == 0).groupBy(*by).agg(F.sort_array(F.collect_list("value")).alias("edges"))
    step = F.ceil(F.size("edges") / MOST_EDGES)
    edges = edges.withColumn("edges", F.when(step <= 1, F.col("edges")).otherwise(F.filter("edges", lambda _, i: i % step == 0)))
    dealt = counts.alias("c").join(edges.alias("e"), same("c", "e", by), "left")
    dealt = dealt.select("c.*", F.when(F.col("edges").isNull(), 0).otherwise(F.size(F.filter("edges", lambda e: e < F.col("value")))).alias("bucket"))
    sums = dealt.groupBy(*by, "bucket").agg(F.sum("n").alias("of_bucket"))
    w = Window.partitionBy(*by)
    before = sums.select(*by, "bucket", (F.sum("of_bucket").over(w.orderBy("bucket")) - F.col("of_bucket")).alias("before"), F.sum("of_bucket").over(w).alias("known"))
    within = F.sum("n").over(Window.partitionBy(*by, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    summed = dealt.withColumn("within", within)
    return summed.alias("c").join(before.alias("b"), same("c", "b", [*by, "bucket"])).select(*[f"c.{x}" for x in by], "value", "n", (F.col("before") + F.col("within")).alias("up_to"), "known")


def placed(df: DataFrame, columns: Mapping[str, tuple[str, str | None]], key: str = "place_id") -> DataFrame:
    """df, one row for each key, with a struct for each name: above and below (values larger and smaller than the row's
    in its group, NULL for a NULL value), known (values) and rows of the group."""
    long = melt(df, columns, key)
    totals = long.groupBy(*_BY).agg(F.count("value").alias("known"), F.count("*").alias("rows"))
    found = long.join(running(long).drop("known"), [*_BY, "value"], "left").join(totals, _BY)
    # Whole numbers, so that a key's are put together by hash and not by sorting; dealt by key before rather than after they are wide.
    place = {"above": F.col("known") - F.col("up_to"), "below": F.col("up_to") - F.col("n"), "known": F.col("known"), "rows": F.col("rows")}
    narrow = found.select(key, "name", *[x.alias(p) for p, x in place.items()]).repartition(key)
    wide = narrow.groupBy(key).agg(*[F.max(F.when(F.col("name") == n, F.col(p))).alias(f"{n}.{p}") for n in columns for p in place])
    wide = wide.select(key, *[F.struct(*[F.col(f"`{n}.{p}`").alias(p) for p in place]).alias(n) for n in columns])
    return df.join(wide, key, "left")


def rank(place: str) -> Column:
    """Largest first, NULLs last."""
    return (F.coalesce(F.col(f"{place}.above"), F.col(f"{place}.known")) + 1).cast("int")


def percent_rank(place: str) -> Column:
    """Smallest first, NULLs last; 0 for a single row."""
    return F.coalesce(F.try_divide(F.coalesce(F.col(f"{place}.below"), F.col(f"{place}.known")).cast("double"), F.nullif(F.col(f"{place}.rows") - 1, F.lit(0)).cast("double")), F.lit(0.0))


def rank_known(place: str) -> Column:
    """Rank among values; NULL for a NULL value."""
    return (F.col(f"{place}.above") + 1).cast("int")


def _at(c: str, p: float) -> Column:
    """The interpolated percentile of the column c among running values, as an aggregate."""
    own = F.col("name") == c
    place = F.lit(p) * (F.col("known") - 1)
    first = lambda i: F.min(F.when(own & (F.col("up_to") > i), F.col("value")))
    low, high, part = first(F.floor(place)), first(F.ceil(place)), F.max(F.when(own, place - F.floor(place)))
    return low + (high - low) * part


def of_sorted(values: Column, p: float) -> Column:
    """The interpolated percentile of a sorted array of doubles, NULL of an empty one."""
    place = F.lit(p) * (F.size(values) - 1)
    at = lambda i: F.get(values, i.cast("int"))
    low, high = at(F.floor(place)), at(F.ceil(place))
    return low + (high - low) * (place - F.floor(place))


def percentiles(df: DataFrame, wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """One row: name -> exact interpolated percentile of (column, p) over all rows; NULL without values."""
    columns = dict.fromkeys(c for c, _ in wanted.values())
    return running(melt(df, {c: (c, None) for c in columns})).agg(*[_at(c, p).alias(n) for n, (c, p) in wanted.items()])


def group_percentiles(df: DataFrame, key: str, wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """key and exact interpolated percentiles of (column, p) of each group with a value; no group's values meet in one task."""
    columns = dict.fromkeys(c for c, _ in wanted.values())
    entries = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]
    long = df.select(key, F.explode(F.array(*entries)).alias("e")).select(key, "e.*").filter("value IS NOT NULL")
    return percentiles_of_counts(long.groupBy(key, "name", "value").agg(F.count("*").alias("n")), key, wanted)


def percentiles_of_counts(counts: DataFrame, key: str, wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """As group_percentiles, of counted values: key, name, value and n."""
    return running_counts(counts, [key, "name"]).groupBy(key).agg(*[_at(c, p).alias(n) for n, (c, p) in wanted.items()])
