"""Coverage and load reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import measures as m


def flag_coverage(rows: DataFrame, flags: list[str]) -> DataFrame:
    """One row: all rows, those with each flag, those in which every flag is NULL."""
    none = F.lit(True)
    for f in flags:
        none = none & F.col(f).isNull()
    return rows.agg(F.count("*").alias("total"), *[m.count_true(F.col(f)).alias(f"with_{f}") for f in flags], F.count_if(none).alias("all_null"))


def coverage(rows: DataFrame, present: Column, by: str | None = None) -> DataFrame:
    """Rows, rows with the value, and percent; overall or by a column."""
    cols = [F.count("*").alias("total"), F.count_if(present).alias("covered"), m.ratio(F.lit(100) * F.count_if(present), F.count("*")).alias("percent")]
    return rows.groupBy(by).agg(*cols) if by else rows.agg(*cols)


def age_coverage(rows: DataFrame, by: str, age: str = "age") -> DataFrame:
    """by, observations, those with an age above 0, those without one, and percent with one; a row of by NULL and the whole as
    'all' come along, the latter with the number of groups that have any age."""
    known = F.col(age).isNotNull() & (F.col(age) > 0)
    per = rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if(known).alias("with_age"))
    whole = per.agg(F.lit("all").alias(by), F.sum("total").alias("total"), F.sum("with_age").alias("with_age"), F.count_if(F.col("with_age") > 0).alias("groups_with_age"))
    both = per.withColumns({by: F.col(by).cast("string"), "groups_with_age": F.lit(None).cast("long")}).unionByName(whole)
    return both.withColumns({"without_age": F.col("total") - F.col("with_age"), "percent": m.ratio(F.lit(100) * F.col("with_age"), F.col("total"))})


def top_places(per_place: DataFrame, column: str, n: int = 10, key: str = "place_id") -> DataFrame:
    return per_place.orderBy(F.desc_nulls_last(column), key).limit(n)


def load_summary(tables: dict[str, DataFrame], latest: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row: the size of each table and the latest value of each given column."""
    out: DataFrame | None = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(f"n_{name}"))
        out = one if out is None else out.crossJoin(one)
    for name, (df, column) in latest.items():
        out = out.crossJoin(df.agg(F.max(column).alias(name)))
    return out
