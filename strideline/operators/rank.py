"""Evidence-gated rankings, scales and extremes over one row a place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import measures as m
from . import order


@dataclass(frozen=True)
class Metric:
    """A ranked value. sample and least: the evidence column and how much of it a rank needs (None: ungated)."""

    column: str
    unit: str = ""
    sample: str | None = None
    least: int = 0
    higher_is_better: bool | None = None
    baseline: str | None = None
    rank: str | None = None


#: The metrics of the crossing domain, with their gates.
REGISTRY = {
    "risky_crossing": Metric("avg_risky_crossing_ratio", "%", "pedestrian_count", 30, False, "global_avg_risky_crossing_ratio", "risky_rank"),
    "run_red_light": Metric("avg_run_red_light_ratio", "%", "pedestrian_count", 30, False, "global_avg_run_red_light_ratio", "red_light_rank"),
    "crosswalk_usage": Metric("avg_crosswalk_usage_ratio", "%", "pedestrian_count", 30, True, "global_avg_crosswalk_usage_ratio", "crosswalk_usage_rank"),
    "phone_usage": Metric("phone_usage_ratio", "%", "pedestrian_count", 30, False, "global_phone_usage_rate"),
    "crossing_speed": Metric("avg_crossing_speed", "m/s", None, 0, True, "global_avg_crossing_speed", "speed_rank"),
    "measured_walking_speed": Metric("avg_measured_walking_speed", "m/s", "measured_walking_ped_sample", 30, True, "global_avg_measured_walking_speed", "measured_walking_speed_rank"),
    "measured_crossing_speed": Metric("avg_measured_crossing_speed", "m/s", "measured_crossing_sample", 10, True),
    "look_before_cross": Metric("avg_look_before_cross", "%", "look_before_cross_sample", 30, True),
    "severe_conflicts": Metric("severe_conflicts_per_100_ped", "per 100 ped", "pet_exposure_pedestrians", 30, False),
    "hesitation_rate": Metric("avg_hesitation_rate_dense", "%", "hesitation_dense_pedestrians", 30, False),
    "vehicle_speed": Metric("avg_vehicle_speed", "m/s", "vehicle_speed_sample", 30, False),
    "social_groups": Metric("grouped_pedestrian_share_dense", "%", "social_dense_pedestrians", 30, None),
    "crossing_time": Metric("avg_crossing_time", "s", None, 0, False),
    "avg_age": Metric("avg_age", "years", "age_sample", 30, None, "global_avg_pedestrian_age"),
    "road_width": Metric("avg_road_width", "m", None, 0, None, "global_avg_road_width"),
    "pedestrian_density": Metric("pedestrian_count", "", None, 0, None),
}
#: The map's metrics: density there is people a session, and mortality is the country's.
MAP_REGISTRY = REGISTRY | {
    "pedestrian_density": Metric("avg_pedestrians_per_video", "people a session"),
    "traffic_mortality": Metric("traffic_mortality", "per 100k", None, 0, False),
}
SMALLEST_SHARE, BOARD, SCALED_FROM = 0.0001, 100, 5


def passes(metric: Metric) -> Column:
    """The value is there, a share isn't nothing, and the sample, if gated, suffices: a NULL sample doesn't."""
    ok = F.col(metric.column).isNotNull()
    if metric.unit == "%":
        ok = ok & (F.col(metric.column) > SMALLEST_SHARE)
    if metric.sample:
        ok = ok & F.coalesce(F.col(metric.sample) >= metric.least, F.lit(False))
    return ok


def leaderboard(base: DataFrame, metric: Metric, baseline: DataFrame | None = None, key: str = "place_id", limit: int = BOARD) -> DataFrame:
    """position, key, value and delta_percent of the best places that pass the gate; ties by key.

    baseline: one row with metric.baseline."""
    order = F.desc(metric.column) if metric.higher_is_better else F.asc(metric.column)
    top = base.filter(passes(metric)).orderBy(order, key).limit(limit)
    if baseline is not None and metric.baseline:
        top = top.crossJoin(F.broadcast(baseline.select(F.col(metric.baseline).alias("__base"))))
    else:
        top = top.withColumn("__base", F.lit(None).cast("double"))
    scale = 100 if metric.unit == "%" else 1
    extra = [F.col(metric.rank).alias("stored_rank")] if metric.rank and metric.rank in base.columns else []
    return top.select(
        F.row_number().over(Window.orderBy(order, key)).alias("position"), key, (F.col(metric.column) * scale).alias("value"),
        m.delta_percent(F.col(metric.column), F.col("__base")).alias("delta_percent"), *extra,
    )


def leaderboards(base: DataFrame, metrics: dict[str, Metric], baseline: DataFrame | None = None, key: str = "place_id", limit: int = BOARD) -> DataFrame:
    """The leaderboard of every metric, with its name, in one pass over base; a metric without a rank or baseline has NULLs there."""
    rows = base if baseline is None else base.crossJoin(F.broadcast(baseline.select(*{m_.baseline for m_ in metrics.values() if m_.baseline})))  # one row
    there = lambda c, kind: F.col(c).cast(kind) if c and c in rows.columns else F.lit(None).cast(kind)

    def entry(name: str, metric: Metric) -> Column:
        value = F.col(metric.column).cast("double")
        made = F.struct(
            F.lit(name).alias("metric"), (-value if metric.higher_is_better else value).alias("o"), (value * (100 if metric.unit == "%" else 1)).alias("value"),
            m.delta_percent(value, there(metric.baseline, "double")).alias("delta_percent"), there(metric.rank, "int").alias("stored_rank"),
        )
        return F.when(passes(metric), made)

    found = rows.select(key, F.explode(F.filter(F.array(*[entry(n, x) for n, x in metrics.items()]), lambda e: e.isNotNull())).alias("e")).select(key, "e.*")
    found = found.withColumn("position", F.row_number().over(Window.partitionBy("metric").orderBy("o", key))).filter(F.col("position") <= limit)
    return found.select("metric", "position", key, "value", "delta_percent", "stored_rank")


def top_by_rank(ranked: DataFrame, rank: str, n: int = 10, allowed: tuple[str, ...] = ()) -> DataFrame:
    """The first n by a stored rank."""
    if allowed and rank not in allowed:
        raise ValueError(f"unknown metric: {rank}")
    return ranked.filter(F.col(rank) <= n).orderBy(rank)


def extremes(base: DataFrame, columns: list[str], name: str = "city") -> DataFrame:
    """For each column the place with the largest and the one with the smallest value above 0, one pass; ties by name."""
    rows = base.select(name, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("e")).select(name, "e.*").filter("value > 0")
    top = F.min_by(name, F.struct(-F.col("value"), F.col(name)))
    low = F.min_by(name, F.struct("value", name))
    return rows.groupBy("metric").agg(top.alias("top_name"), F.max("value").alias("top_value"), low.alias("bottom_name"), F.min("value").alias("bottom_value"))


def rank_scale(base: DataFrame, metric: Metric) -> DataFrame:
    """One row: number of ranked places, and the range they span, NULL unless enough of them pass a gate."""
    least = SCALED_FROM if metric.sample else 1
    df = base.filter(passes(metric)).agg(F.count("*").alias("n_ranked"), F.min(metric.column).alias("low"), F.max(metric.column).alias("high"))
    return df.select("n_ranked", *[F.when(F.col("n_ranked") >= least, F.col(c)).alias(c) for c in ("low", "high")])


def evidence_status(metric: Metric, scaled: Column) -> Column:
    if not metric.sample:
        return F.lit("ungated")
    n = F.col(metric.sample)
    return F.when(n.isNull(), "unknown").when(n < metric.least, "below_bar").when(scaled, "ranked").otherwise("no_scale")


def layer_rows(base: DataFrame, metric: Metric, key: str = "place_id") -> DataFrame:
    """Every place with a value: whether it is ranked, its place in the scale, and its evidence."""
    df = base.filter(F.col(metric.column).isNotNull()).crossJoin(F.broadcast(rank_scale(base, metric)))
    scaled = F.col("low").isNotNull()
    on = passes(metric) & scaled
    sample = F.col(metric.sample) if metric.sample else F.lit(None)
    return df.select(key, F.col(metric.column).alias("value"), on.alias("is_ranked"), F.when(on, m.safe_normalize(F.col(metric.column), F.col("low"), F.col("high"))).alias("t"), evidence_status(metric, scaled).alias("evidence"), sample.cast("long").alias("sample"))


def map_layers(base: DataFrame, metrics: dict[str, Metric], key: str = "place_id") -> DataFrame:
    """The rows of every metric's layer, with its name: base is read twice, once for the scales, a row a metric, and once for the
    rows, however many metrics there are."""

    def entry(name: str, metric: Metric) -> Column:
        sample = F.col(metric.sample).cast("long") if metric.sample else F.lit(None).cast("long")
        return F.struct(
            F.lit(name).alias("metric"), F.col(metric.column).cast("double").alias("value"), sample.alias("sample"), passes(metric).alias("passes"),
            F.lit(bool(metric.sample)).alias("gated"), F.lit(metric.least).alias("least"), F.lit(SCALED_FROM if metric.sample else 1).alias("scaled_from"),
        )

    long = base.select(key, F.explode(F.array(*[entry(n, x) for n, x in metrics.items()])).alias("e")).select(key, "e.*").filter("value IS NOT NULL")
    ranked = F.when(F.col("passes"), F.col("value"))
    scales = long.groupBy("metric", "scaled_from").agg(F.count(ranked).alias("n"), F.min(ranked).alias("low"), F.max(ranked).alias("high")).filter("n >= scaled_from").select("metric", "low", "high")
    df = long.join(F.broadcast(scales), "metric", "left")  # one row a metric
    scaled = F.col("low").isNotNull()
    on = F.col("passes") & scaled
    evidence = F.when(~F.col("gated"), "ungated").when(F.col("sample").isNull(), "unknown").when(F.col("sample") < F.col("least"), "below_bar").when(scaled, "ranked").otherwise("no_scale")
    return df.select("metric", key, "value", on.alias("is_ranked"), F.when(on, m.safe_normalize(F.col("value"), F.col("low"), F.col("high"))).alias("t"), evidence.alias("evidence"), "sample")


def rank_by_average(df: DataFrame, columns: list[str], key: str = "place_id") -> DataFrame:
    """Rank as one more than the places with a larger average; a place without the average has 1."""
    found = order.placed(df.select(key, *columns), {f"__{c}": (c, None) for c in columns}, key)
    return found.select(key, *[F.coalesce(order.rank_known(f"__{c}"), F.lit(1)).alias(f"{c}_rank") for c in columns])
