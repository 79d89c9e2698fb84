"""Long-form facts from wide statistics, their dimensions, and views over them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.clean import safe_numeric
from ..functions import measures as m
from ..sources import storage
from ..sources.readers import read_category_stats

SLOTS = ("value_numeric", "value_percentage", "correlation_coefficient")
FACTS = "data_source string, fact_type string, metric_name string, dimension_type string, dimension_value string, value_numeric double, value_percentage double, correlation_coefficient double"


@dataclass(frozen=True)
class Melt:
    """How one statistics table melts: its dimension and, for each metric column, (fact_type, metric_name, slot)."""

    dimension_type: str
    dimension: tuple[str, ...]
    metrics: dict[str, tuple[str, str, str]]


_RISKY, _RED = "risky_crossing_rate", "run_red_light_rate"
_PERCENT = {"risky_crossing_rate(%)": ("statistic", _RISKY, SLOTS[1]), "run_red_light_rate(%)": ("statistic", _RED, SLOTS[1])}
_SHARE = {"risky_crossing": ("statistic", _RISKY, SLOTS[0]), "run_red_light": ("statistic", _RED, SLOTS[0])}
#: The statistics tables of the crossing domain.
MELTS = {
    "accident_road_condition_stats": Melt("environment_factor", ("environment_factor",), _PERCENT),
    "age_stats": Melt("age", ("age",), _SHARE),
    "carried_items_stats": Melt("accessory", ("accessory",), _PERCENT),
    "clothing_stats": Melt("clothing_type", ("clothing_type",), _PERCENT),
    "continent_stats": Melt("continent", ("continent",), _PERCENT),
    "crossing_stats": Melt("continent", ("continent",), {"avg_decision_time": ("average", "decision_time", SLOTS[0]), "avg_crossing_speed": ("average", "crossing_speed", SLOTS[0])}),
    "crosswalk_coeff": Melt("continent", ("continent",), {"crosswalk_usage_ratio": ("ratio", "crosswalk_usage", SLOTS[0]), "crosswalk_prob": ("probability", "crosswalk_presence", SLOTS[0]), "crosswalk_coeff": ("coefficient", "crosswalk_coefficient", SLOTS[0])}),
    "gender_stats": Melt("gender", ("gender",), _SHARE),
    "phone_stats": Melt("accessory", ("accessory",), _PERCENT),
    "road_corr": Melt("index", ("index",), {"risky_crossing": ("correlation", "risky_crossing_correlation", SLOTS[2]), "run_red_light": ("correlation", "run_red_light_correlation", SLOTS[2])}),
    "time_stats": Melt("index", ("index",), {"duration_minutes": ("average", "duration_minutes", SLOTS[0]), "analysis_minutes": ("average", "analysis_minutes", SLOTS[0])}),
    "vehicle_stats": Melt("vehicle_type", ("vehicle_type",), _PERCENT),
    "weather_daytime_stats": Melt("weather_daytime", ("weather", "daytime"), {"run_red_light_prob": ("statistic", _RED, SLOTS[1]), "risky_crossing_prob": ("statistic", _RISKY, SLOTS[1])}),
}


def cells(stats: DataFrame, source: str, spec: Melt) -> DataFrame:
    """A row for each metric cell: where it belongs, its text raw, and x, its number, NULL if it has none. Several dimension
    columns are joined by '_', empty ones left out; metric columns that the table lacks are left out."""
    value = F.concat_ws("_", *[F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in spec.dimension])
    have = [c for c in spec.metrics if c in stats.columns]
    text = lambda c: F.col(f"`{c}`").cast("string")
    found = [F.struct(F.lit(c).alias("column"), *[F.lit(x).alias(n) for x, n in zip(spec.metrics[c], ("fact_type", "metric_name", "slot"))], text(c).alias("raw"), safe_numeric(text(c)).alias("x")) for c in have]
    file = F.col("source_file") if "source_file" in stats.columns else F.lit(None).cast("string")
    df = stats.select(value.alias("dimension_value"), file.alias("source_file"), F.explode(F.array(*found)).alias("f"))
    return df.select(F.lit(source).alias("data_source"), "source_file", F.lit(spec.dimension_type).alias("dimension_type"), "dimension_value", "f.*")


def accepted(found: DataFrame) -> DataFrame:
    """The facts among cells: those with a number, in the column of their slot."""
    keep = ["data_source", "fact_type", "metric_name", "dimension_type", "dimension_value"]
    return found.filter("x IS NOT NULL").select(*keep, *[F.when(F.col("slot") == s, F.col("x")).alias(s) for s in SLOTS], *[c for c in ("source_file",) if c in found.columns])


def rejected(found: DataFrame) -> DataFrame:
    """The cells that say something, but no number."""
    return found.filter("x IS NULL AND trim(raw) <> ''").select("data_source", "source_file", "dimension_value", "column", "raw")


def melt(stats: DataFrame, source: str, spec: Melt) -> DataFrame:
    """One fact for each metric value that is a number."""
    return accepted(cells(stats, source, spec)).drop("source_file")


def load_stats(spark: SparkSession, folder: str, names: Iterable[str] = MELTS) -> tuple[DataFrame, DataFrame]:
    """Facts with the file they come from, and rejected cells, of the statistics tables in a folder, by their names; tables that
    aren't there are left out."""
    there = {n.removesuffix(".csv") for n in storage.children(spark, folder) if n.endswith(".csv")}
    tables = [cells(read_category_stats(spark, folder, n), n, MELTS[n]) for n in names if n in there]
    if not tables:
        raise FileNotFoundError(f"no statistics tables in {folder}")
    found = reduce(DataFrame.unionByName, tables)
    return accepted(found), rejected(found)


def dimensions(facts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """dimension_id, type and value of every pair, known ones first kept; ids are hashes, the same on every run."""
    pairs = facts.select("dimension_type", "dimension_value").distinct()
    pairs = pairs.withColumn("dimension_id", F.xxhash64("dimension_type", "dimension_value"))
    if known is None:
        return pairs
    return known.unionByName(pairs.join(known, ["dimension_type", "dimension_value"], "left_anti"), allowMissingColumns=True)


def keyed(facts: DataFrame, known: DataFrame) -> DataFrame:
    """facts with dimension_id in place of type and value; NULL for a pair that known, as dimensions gives it, lacks."""
    pair = ["dimension_type", "dimension_value"]
    ids = known.select(*[F.col(c).alias(f"__{c}") for c in pair], "dimension_id")
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in pair]
    return facts.join(ids, on, "left").select("dimension_id", *[c for c in facts.columns if c not in pair])


def analytics_summary(keyed_facts: DataFrame, known: DataFrame) -> DataFrame:
    """Facts beside their dimensions; one whose id is unknown stays, with neither type nor value."""
    ids = known.select(F.col("dimension_id").alias("__id"), "dimension_type", "dimension_value")
    rest = [c for c in keyed_facts.columns if c not in ("dimension_id", *SLOTS, "data_source", "fact_type", "metric_name")]
    return keyed_facts.join(ids, F.col("dimension_id") == F.col("__id"), "left").select("dimension_id", "fact_type", "metric_name", "dimension_type", "dimension_value", *SLOTS, *rest, "data_source")


def replace_source(facts: DataFrame, path: str) -> None:
    """Write facts, replacing those of the same data_source and no others."""
    facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("data_source").parquet(path)


def ranked_facts(facts: DataFrame) -> DataFrame:
    w = lambda c, o: Window.partitionBy("metric_name").orderBy(o(c))
    cols = {}
    for c, n in (("value_numeric", "numeric"), ("value_percentage", "percentage")):
        cols[f"rank_by_{n}"] = F.rank().over(w(c, F.desc_nulls_last))
        cols[f"percentile_{n}"] = F.percent_rank().over(w(c, F.asc_nulls_last))
    return facts.withColumns(cols)


def _if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df, to be broadcast if it has at most so many rows, which a bounded job finds out."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def facts_by_continent(facts: DataFrame, per_place: DataFrame) -> DataFrame:
    """Fact averages beside each continent's counts. per_place: place_id, continent, sessions, observations, and joined:
    the rows that places, sessions and observations make when joined, at least 1. fact_count counts facts times those."""
    c = per_place.filter("continent IS NOT NULL").groupBy("continent").agg(F.count("*").alias("place_count"), F.sum("sessions").alias("session_count"), F.sum("observations").alias("observation_count"), F.sum("joined").alias("joined"))
    f = facts.groupBy("fact_type", "metric_name", "dimension_type", "dimension_value").agg(*[m.mean(F.col(s)).alias(f"avg_{s}") for s in SLOTS], F.count("*").alias("n"))
    return f.crossJoin(_if_small(c)).select("continent", *f.columns[:-1], (F.col("n") * F.col("joined")).alias("fact_count"), "place_count", "session_count", "observation_count")


def facts_by_place(facts: DataFrame, per_place: DataFrame) -> DataFrame:
    """Every place beside every fact. facts are few (one row a category and metric) and broadcast only while so."""
    return per_place.crossJoin(_if_small(facts))
