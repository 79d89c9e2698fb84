"""Shares of categories within places, flag unpivots and filter catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import measures as m

NOT_WEATHER = ("sunrise", "sunset", "dawn", "dusk")


def mix(df: DataFrame, key: str, category: Column, count: Column | None = None, tasks: int | None = None) -> DataFrame:
    """key, category, n and percent of the key's total; NULL and '' categories are left out."""
    rows = df.select(key, category.alias("category"), *([] if count is None else [count.alias("__c")])).filter(F.col("category").isNotNull() & (F.col("category").cast("string") != ""))
    n = F.count("*") if count is None else F.count_distinct("__c")
    return _shares(rows.groupBy(key, "category").agg(n.alias("n")), key, tasks)


def _shares(counts: DataFrame, key: str, tasks: int | None) -> DataFrame:
    """percent of the key's total. tasks: how many sort the counts; by default Spark puts small ones together."""
    dealt = counts if tasks is None else counts.repartition(tasks, key)
    return dealt.withColumn("percent", m.ratio(F.lit(100) * F.col("n"), F.sum("n").over(Window.partitionBy(key))))


def mix_of_sessions(rows: DataFrame, sessions: DataFrame, category: Column, distinct: bool = False, key: str = "place_id", session: str = "session_id", tasks: int | None = None) -> DataFrame:
    """mix of the rows of sessions, counted per session and category before they meet the session's place, so that join moves a
    row for each of these. distinct: sessions that have the category are counted instead of rows. Rows that know their place are
    counted by it."""
    of = [key, session] if key in rows.columns and distinct else [key] if key in rows.columns else [session]
    per = rows.select(*of, category.alias("category")).filter(F.col("category").isNotNull() & (F.col("category").cast("string") != ""))
    if distinct and key in of and tasks is not None:
        per = per.repartition(tasks, key)
    per = per.groupBy(*of, "category").agg((F.lit(1).cast("long") if distinct else F.count("*")).alias("n"))
    if of != [key]:
        per = (per if key in of else per.join(sessions.select(session, key), session)).groupBy(key, "category").agg(F.sum("n").alias("n"))
    return _shares(per, key, tasks)


def risk_of_sessions(rows: DataFrame, sessions: DataFrame, bucket: Column, order_by: Column, risky: Column, key: str = "place_id", session: str = "session_id") -> DataFrame:
    """Percent risky in each bucket of the rows of sessions; unknown is not risky. order_by gives the bucket's place. Rows are
    counted per session and bucket before they meet the session's place; those that know it are counted by it."""
    of = key if key in rows.columns else session
    per = rows.select(of, bucket.alias("bucket"), order_by.alias("__o"), risky.alias("__r")).filter("bucket IS NOT NULL")
    per = per.groupBy(of, "bucket").agg(F.count("*").alias("n"), m.count_true(F.col("__r")).alias("__risky"), F.min("__o").alias("bucket_order"))
    total = per if of == key else per.join(sessions.select(session, key), session).groupBy(key, "bucket").agg(F.sum("n").alias("n"), F.sum("__risky").alias("__risky"), F.min("bucket_order").alias("bucket_order"))
    return total.select(key, "bucket", "n", m.ratio(F.lit(100) * F.col("__risky"), F.col("n")).alias("risky_percent"), "bucket_order")


def weather_mix(sessions: DataFrame, key: str = "place_id", weather: str = "weather", tasks: int | None = None) -> DataFrame:
    return mix(sessions.filter(~F.lower(weather).isin(*NOT_WEATHER)), key, F.col(weather), tasks=tasks)


def flag_sums(flags: list[str]) -> dict[str, Column]:
    return {f: m.count_true(F.col(f)) for f in flags}


def flag_mix(counts: DataFrame, key: str, flags: list[str], limit: int = 10) -> DataFrame:
    """Wide counts of flags, one row a key, as rows above 0 with percent of the key's total; the most frequent `limit` of each
    key. A key's flags are put in order within its row: nothing is sorted across keys."""
    there = F.filter(F.array(*[F.struct((-F.col(f)).alias("o"), F.lit(f).alias("category"), F.col(f).alias("n")) for f in flags]), lambda x: x["n"] > 0)
    total = F.aggregate("__f", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    rows = counts.select(key, F.array_sort(there).alias("__f")).select(key, total.alias("__t"), F.posexplode(F.slice("__f", 1, limit)).alias("__p", "__e"))
    return rows.select(key, "__e.category", "__e.n", m.ratio(F.lit(100) * F.col("__e.n"), F.col("__t")).alias("percent"), (F.col("__p") + 1).alias("position"))


def risk_factors(sessions: DataFrame, key: str, factor: str, value: Column, least: int = 2, limit: int = 3, tasks: int | None = None) -> DataFrame:
    """The factors with the highest mean, unmeasured first, of each key, seen at least so often."""
    df = sessions.filter(F.col(factor).isNotNull() & (F.col(factor) != "")).groupBy(key, factor).agg(m.mean(value).alias("mean_value"), F.count("*").alias("n")).filter(F.col("n") >= least)
    w = Window.partitionBy(key).orderBy(F.desc_nulls_first("mean_value"), factor)
    return (df if tasks is None else df.repartition(tasks, key)).withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit).withColumn(factor, F.concat(F.lit("Weather: "), F.col(factor)))


def filter_options(groups: dict[str, tuple[DataFrame, Column]], flags: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """filter_type, filter_value, n. groups: values counted; flags: conditions counted in one pass over each table."""
    out: DataFrame | None = None
    for kind, (df, value) in groups.items():
        rows = df.select(value.cast("string").alias("filter_value")).filter("filter_value IS NOT NULL").groupBy("filter_value").agg(F.count("*").alias("n")).select(F.lit(kind).alias("filter_type"), "filter_value", "n")
        out = rows if out is None else out.unionByName(rows)
    for kind, (df, conditions) in flags.items():
        wide = df.agg(*[m.count_true(c).alias(n) for n, c in conditions.items()])
        rows = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("filter_value"), F.col(n).alias("n")) for n in conditions])).alias("e")).select(F.lit(kind).alias("filter_type"), "e.filter_value", "e.n")
        out = rows if out is None else out.unionByName(rows)
    return out


def average_with_fallback(first: Column, second: Column, buckets: list[tuple[str, float]]) -> Column:
    """first, else second, else the mean of bucket middles weighted by the buckets' counts."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c, _ in buckets[1:]), F.coalesce(F.col(buckets[0][0]), F.lit(0)))
    weight = sum((F.coalesce(F.col(c), F.lit(0)) * mid for c, mid in buckets[1:]), F.coalesce(F.col(buckets[0][0]), F.lit(0)) * buckets[0][1])
    return F.coalesce(first, second, F.try_divide(weight.cast("double"), F.nullif(total, F.lit(0)).cast("double")))


def with_fallback(layers: dict[str, DataFrame], key: str = "place_id", tasks: int | None = None) -> DataFrame:
    """For each key the rows of the first layer that has any, with that layer's name as layer. One plan: a layer loses the keys
    that earlier ones tell by an anti join. Layers have equal columns; rows of a NULL key are left out.
    tasks: how many the layers are dealt to by key; by default Spark puts small ones together."""
    out: DataFrame | None = None
    told: DataFrame | None = None
    for name, df in layers.items():
        df = df.filter(F.col(key).isNotNull())
        df = df if tasks is None else df.repartition(tasks, key)
        rows = (df if told is None else df.join(told, key, "left_anti")).withColumn("layer", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
        keys = df.select(key).distinct()
        told = keys if told is None else told.union(keys)
    return out


#: Middle ages of the buckets of clean.age_detail.
AGE_MIDDLES = {"Under 18": 15.0, "18-30": 24.0, "31-50": 40.5, "50+": 60.0}


def average_of_buckets(buckets: DataFrame, middles: dict[str, float] = AGE_MIDDLES, key: str = "place_id") -> DataFrame:
    """key and avg_age: the mean of the buckets' middles weighted by their counts. buckets: key, bucket and n."""
    middle = F.coalesce(*[F.when(F.col("bucket") == b, F.lit(x)) for b, x in middles.items()])
    return buckets.withColumn("__m", middle).filter("__m IS NOT NULL").groupBy(key).agg(m.ratio(F.sum(F.col("__m") * F.col("n")), F.sum("n")).alias("avg_age"))
