"""Effect sizes of categories against a filtered baseline."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clean

#: How far a rate must be from the baseline, in percent points.
THRESHOLDS = {"risky_crossing": 2.0, "run_red_light": 1.0}
PER_CATEGORY, OVERALL = 3, 10
#: Effects alike in so many decimals are ties: the two sides of a category of two differ by rounding only.
DECIMALS = 9


@dataclass(frozen=True)
class Source:
    """A statistics table of categories: label and rate columns by metric; rates are shown times scale, those at most floor don't count for the baseline."""

    category: str
    label: Column
    rates: dict[str, str]
    floor: float = 0.01
    scale: float = 1.0
    group: bool = False


def sources() -> dict[str, Source]:
    """The six kinds of categories of the crossing domain."""
    percent = {"risky_crossing": "risky_crossing_rate(%)", "run_red_light": "run_red_light_rate(%)"}
    share = {"risky_crossing": "risky_crossing", "run_red_light": "run_red_light"}
    named = lambda x: clean.capitalise_first(F.col(x))
    return {
        "weather_daytime_stats": Source("Environmental", F.concat(named("weather"), F.lit(" + "), clean.format_daytime(F.col("daytime"))), {"risky_crossing": "risky_crossing_prob", "run_red_light": "run_red_light_prob"}),
        "gender_stats": Source("Demographics", F.nullif(F.col("gender"), F.lit("")), share, 0.0001, 100.0),
        "age_stats": Source("Age", clean.age_effect_group(F.col("age").cast("int")), share, 0.0001, 100.0, True),
        "clothing_stats": Source("Demographics", named("clothing_type"), percent),
        "phone_stats": Source("Behavior", F.when(F.col("accessory") == "phone_using", "Phone Users").otherwise(named("accessory")), percent),
        "vehicle_stats": Source("Vehicles", named("vehicle_type"), percent),
    }


def relationships(metric: str, tables: Mapping[str, DataFrame], threshold: float | None = None) -> DataFrame:
    """The balanced effects of all sources at hand on a metric. tables: name -> statistics table."""
    return all_relationships(tables, [metric], threshold).drop("metric")


def all_relationships(tables: Mapping[str, DataFrame], metrics: Iterable[str] = THRESHOLDS, threshold: float | None = None) -> DataFrame:
    """The balanced effects on several metrics, each table read once: its rates are melted, and baselines, effects and
    places are taken within metric and source."""
    metrics = list(metrics)
    if unknown := [x for x in metrics if x not in THRESHOLDS]:
        raise ValueError(f"unknown metric: {', '.join(unknown)}")
    parts = []
    for i, (name, s) in enumerate(sources().items()):
        if name in tables:
            entries = F.array(*[F.struct(F.lit(x).alias("metric"), F.col(f"`{s.rates[x]}`").cast("double").alias("rate"), F.lit(THRESHOLDS[x] if threshold is None else threshold).alias("least")) for x in metrics])
            df = tables[name].select(s.label.alias("label"), F.explode(entries).alias("e")).select("label", "e.*").filter("label IS NOT NULL")
            if s.group:
                df = df.groupBy("metric", "least", "label").agg(F.avg("rate").alias("rate"))
            parts.append(df.select("metric", F.lit(i).alias("source"), F.lit(s.category).alias("category"), "label", "rate", "least", F.lit(s.floor).alias("floor"), F.lit(s.scale).alias("scale")))
    if not parts:
        raise ValueError("no statistics tables")
    rows = reduce(DataFrame.unionByName, parts)
    mean = F.avg(F.when(F.col("rate") > F.col("floor"), F.col("rate"))).over(Window.partitionBy("metric", "source"))
    rows = rows.withColumn("baseline", F.coalesce(mean, F.lit(0.0)) * F.col("scale")).filter("rate IS NOT NULL").withColumn("rate", F.col("rate") * F.col("scale"))
    rows = rows.withColumn("effect", F.col("rate") - F.col("baseline")).filter(F.abs("effect") > F.col("least"))
    strength = F.round(F.abs("effect"), DECIMALS)
    order = [F.desc(strength), "category", "label"]
    few = rows.withColumn("__r", F.row_number().over(Window.partitionBy("metric", "category").orderBy(F.desc(strength), "label"))).filter(F.col("__r") <= PER_CATEGORY)
    top = few.withColumn("position", F.row_number().over(Window.partitionBy("metric").orderBy(*order))).filter(F.col("position") <= OVERALL)
    return top.select("metric", "category", "label", "rate", "effect", F.when(F.col("effect") > 0, "up").otherwise("down").alias("direction"), "position")


def filtered_mean(rate: Column, above: float) -> Column:
    """Mean of the rates above a floor; 0 if there are none."""
    return F.coalesce(F.avg(F.when(rate > above, rate)), F.lit(0.0))


def effect_sizes(df: DataFrame, label: Column, rate: Column, category: str, threshold: float, floor: float = 0.01, scale: float = 1.0) -> DataFrame:
    """category, label, rate, effect and direction of every row that differs enough; rates are shown times scale."""
    rows = df.select(label.alias("label"), rate.cast("double").alias("rate"))
    base = rows.agg((filtered_mean(F.col("rate"), floor) * scale).alias("baseline"))
    out = rows.filter("rate IS NOT NULL").crossJoin(F.broadcast(base)).withColumn("rate", F.col("rate") * scale)
    out = out.withColumn("effect", F.col("rate") - F.col("baseline")).filter(F.abs("effect") > threshold)
    return out.select(F.lit(category).alias("category"), "label", "rate", "effect", F.when(F.col("effect") > 0, "up").otherwise("down").alias("direction"))


def balanced(effects: DataFrame, per_category: int = PER_CATEGORY, overall: int = OVERALL) -> DataFrame:
    """The strongest of each category, then the strongest of those; ties (to DECIMALS) by category and label."""
    strength = F.round(F.abs("effect"), DECIMALS)
    w = Window.partitionBy("category").orderBy(F.desc(strength), "label")
    few = effects.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_category).drop("__r")
    top = few.orderBy(F.desc(strength), "category", "label").limit(overall)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc(strength), "category", "label")))


def grouped_mean(df: DataFrame, group: Column, rate: Column) -> DataFrame:
    """Mean rate of each group, for categories that are bucketed first."""
    return df.select(group.alias("label"), rate.cast("double").alias("rate")).filter("label IS NOT NULL").groupBy("label").agg(F.avg("rate").alias("rate"))
