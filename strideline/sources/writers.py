"""Sinks: CSV with doubled quotes, snapshots, gazetteer export, and the publish chain."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import clean
from ..operators import insights, merge, places as place_ops


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(header="true", quote='"', escape='"', emptyValue="").csv(path)


def refresh_snapshots(spark: SparkSession, folder: str, builders: dict[str, Callable[[SparkSession], DataFrame]]) -> dict[str, DataFrame]:
    """Each derived table written anew in the given order, and read back for the next ones. A version is written to a
    folder of its own, so readers of the last one aren't disturbed."""
    out = {}
    for name, build in builders.items():
        path = f"{folder}/{name}/version-{uuid.uuid4().hex}"
        build(spark).write.mode("overwrite").parquet(path)
        out[name] = spark.read.parquet(path)
        out[name].createOrReplaceTempView(name)
    return out


def export_gazetteer(places: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical places (real country and continent, coordinates rounded to six digits, homonyms merged) and the aliases
    whose place is among them."""
    good = places.filter(~clean.is_missing_text(F.col("country")) & ~clean.is_missing_text(F.col("continent")) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    kept = place_ops.dedup_homonyms(good).withColumns({"latitude": F.round("latitude", 6), "longitude": F.round("longitude", 6)})
    known = kept.select(clean.normalize_name(F.col("city")).alias("__k")).distinct()
    return kept, aliases.join(known, clean.normalize_name(F.col("name")) == F.col("__k"), "left_semi")


def publish(spark: SparkSession, folder: str, places: DataFrame, sessions: DataFrame, incoming: DataFrame, localizations: DataFrame, fields: list[str], summarize: Callable[[DataFrame, DataFrame], DataFrame], describe: Callable[[DataFrame, DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """Import, coordinates, refresh, insights, refresh: the snapshots sessions, located, summary, insights and published
    below folder, each read back by the next step. A failing step ends it; the versions before it stay.

    incoming and localizations: new rows by link. summarize: places and sessions -> summary. describe: places and sessions
    -> one row an insight."""
    return refresh_snapshots(spark, folder, {
        "sessions": lambda s: merge.merge(sessions, merge.pick(incoming, ["link"], incoming.columns), ["link"], {"session_id": merge.OLD_OR_NEW}),
        "located": lambda s: merge.apply_localizations(s.table("sessions"), localizations, fields),
        "summary": lambda s: summarize(places, s.table("located")),
        "insights": lambda s: describe(places, s.table("located")),
        "published": lambda s: insights.store_insights(s.table("summary"), s.table("insights")),
    })
