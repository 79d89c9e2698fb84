"""Views as of a date, comparisons with an earlier one, monthly series and import batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def known_at(date: str, collected: str = "collected", imported: str = "imported") -> Column:
    """Rows collected and imported by the date; the import counts from midnight, a missing date never excludes."""
    d = F.lit(date).cast("date")
    return (F.col(collected).isNull() | (F.col(collected) <= d)) & (F.col(imported).isNull() | (F.col(imported) <= d.cast("timestamp")))


def compare(now: DataFrame, then: DataFrame, keys: list[str], counts: list[str], rates: list[str], date: str, today: str) -> DataFrame:
    """Both summaries side by side. The change of a count takes a missing past as 0, that of a rate is NULL then."""
    a, b = now.alias("a"), then.alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    cols = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys]
    for c in counts + rates:
        past = F.coalesce(F.col(f"b.{c}"), F.lit(0)) if c in counts else F.col(f"b.{c}")
        cols += [F.col(f"a.{c}").alias(f"current_{c}"), F.col(f"b.{c}").alias(f"past_{c}"), (F.col(f"a.{c}") - past).alias(f"change_{c}")]
    return joined.select(*cols, F.datediff(F.lit(today).cast("date"), F.lit(date).cast("date")).alias("period_days"))


def batch_stats(sessions: DataFrame, per_session: DataFrame, batch: str = "batch") -> DataFrame:
    """Distinct sessions and places and the observations of each batch. per_session: session_id and n_observations."""
    df = sessions.join(per_session.select("session_id", "n_observations"), "session_id", "left")
    return df.groupBy(batch).agg(F.count_distinct("session_id").alias("sessions"), F.count_distinct("place_id").alias("places"), F.coalesce(F.sum("n_observations"), F.lit(0)).cast("long").alias("observations"))


def monthly_series(values: DataFrame, start: str, end: str, value: str = "value", month: str = "month") -> DataFrame:
    """One row a month from start to end: the month's value, and the last known one carried forward; leading gaps go.

    values: one row a month at most."""
    spark = values.sparkSession
    months = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("month"))
    df = months.join(values.select(F.col(month).alias("month"), F.col(value).alias("value")), "month", "left")
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return df.select("month", F.col("value").alias("raw_value"), F.last_value("value", ignoreNulls=True).over(w).alias("value")).filter(F.col("value").isNotNull())


def series_by_place(values: DataFrame, start: str, end: str) -> DataFrame:
    """The same for every place: place_id, month, value. Months are made per place, gaps are filled within it."""
    places = values.select("place_id").distinct()
    months = places.select("place_id", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("month"))
    df = months.join(values, ["place_id", "month"], "left")
    w = Window.partitionBy("place_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return df.select("place_id", "month", F.last_value("value", ignoreNulls=True).over(w).alias("value")).filter(F.col("value").isNotNull())
