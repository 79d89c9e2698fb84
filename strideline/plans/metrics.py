"""Registered queries over every metric of the registry, with their SQL.

The tables at hand have no column for some measures, so others stand in for them: what is shown is the mechanism over all
sixteen boards and seventeen layers, gates, units and baselines included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import measures as m
from ..operators import rank, rollup
from .adapters import Data
from .driver import c, parts

RANKS = {"risky_rank": "avg_risky_crossing_ratio", "red_light_rank": "avg_run_red_light_ratio", "crosswalk_usage_rank": "avg_crosswalk_usage_ratio", "speed_rank": "avg_crossing_speed"}
#: Means over sessions: name -> (column, divided by).
MEANS = {
    "avg_risky_crossing_ratio": ("risky_ratio", 100), "avg_run_red_light_ratio": ("red_ratio", 100), "avg_crosswalk_usage_ratio": ("crosswalk_ratio", 100), "avg_crossing_speed": ("speed", 1), "avg_look_before_cross": ("hazard", 100),
    "avg_vehicle_speed": ("n_vehicles", 1), "avg_crossing_time": ("crossing_time", 1), "avg_road_width": ("hazard", 1), "avg_pedestrians_per_video": ("n_people", 1),
}
#: Means weighted by a sample, where measured: name -> (value, weight, name of the sample).
WEIGHTED = {"avg_measured_walking_speed": ("measured_speed", "measured_n", "measured_walking_ped_sample"), "avg_measured_crossing_speed": ("crosswalk_ratio", "n_groups", "measured_crossing_sample"), "avg_hesitation_rate_dense": ("severe_conflicts", "n_people", "hesitation_dense_pedestrians")}
#: Global figures: name -> mean over sessions.
GLOBAL = {"global_avg_risky_crossing_ratio": "avg_risky_crossing_ratio", "global_avg_run_red_light_ratio": "avg_run_red_light_ratio", "global_avg_crosswalk_usage_ratio": "avg_crosswalk_usage_ratio", "global_avg_crossing_speed": "avg_crossing_speed", "global_avg_road_width": "avg_road_width"}


def _means() -> dict:
    return {n: m.mean(c(x)) / float(by) for n, (x, by) in MEANS.items()}


def metric_base(d: Data) -> DataFrame:
    """Every place with the columns that the registry names."""
    spec = _means() | {k: v for n, (x, w, sample) in WEIGHTED.items() for k, v in ((n, m.weighted_mean(c(x), c(w))), (sample, m.sum_where(c(w), c(x).isNotNull())))}
    spec |= {
        "look_before_cross_sample": F.sum("n_people"), "vehicle_speed_sample": F.sum("n_vehicles"), "severe_conflicts_per_100_ped": m.exposure_rate(c("severe_conflicts"), c("n_people")), "pet_exposure_pedestrians": m.sum_where(c("n_people"), c("severe_conflicts").isNotNull()),
        "grouped_pedestrian_share_dense": m.ratio(m.sum_where(c("grouped_people"), c("n_groups").isNotNull()), m.sum_where(c("n_people"), c("n_groups").isNotNull())), "social_dense_pedestrians": m.sum_where(c("n_people"), c("n_groups").isNotNull()),
    }
    seen = {"pedestrian_count": c("n"), "phone_usage_ratio": m.ratio(c("s_phone"), c("n")), "avg_age": m.ratio(c("s_age"), c("n_age")), "age_sample": c("n_age")}
    df = d.places.select("place_id", c("city_med_age").alias("traffic_mortality")).join(rollup.session_rollup(d.sessions, spec), "place_id", "left")
    return rollup.with_default(df.join(rollup.observation_rollup(d.observations, d.sessions, parts(), seen), "place_id", "left"), ["pedestrian_count"])


def metric_boards(d: Data) -> DataFrame:
    base = rollup.ranked(metric_base(d), RANKS, known_only={"measured_walking_speed_rank": "avg_measured_walking_speed"})
    means = _means()
    whole = d.sessions.agg(*[means[x].alias(n) for n, x in GLOBAL.items()], m.mean(c("measured_speed")).alias("global_avg_measured_walking_speed"))
    whole = whole.crossJoin(d.observations.agg(m.mean(c("age")).alias("global_avg_pedestrian_age"), m.pooled_rate(c("phone"), c("track")).alias("global_phone_usage_rate")))  # one row each
    return rank.leaderboards(base, rank.REGISTRY, whole).withColumn("stored_rank", c("stored_rank").cast("double"))


def map_layers(d: Data) -> DataFrame:
    return rank.map_layers(metric_base(d), rank.MAP_REGISTRY).withColumn("sample", c("sample").cast("double"))


QUERIES = [metric_boards, map_layers]


def sql() -> dict[str, str]:
    from .oracle import BY_PLACE, count_if, mean, ratio

    means = ", ".join(f"({mean(x)}) / {float(by)}::double AS {n}" for n, (x, by) in MEANS.items())
    weighted = ", ".join(f"{ratio(f'sum({x} * {w})', f'sum({w}) FILTER ({x} IS NOT NULL)')} AS {n}, CAST(sum({w}) FILTER ({x} IS NOT NULL) AS bigint) AS {sample}" for n, (x, w, sample) in WEIGHTED.items())
    grouped, exposed = "n_groups IS NOT NULL", "severe_conflicts IS NOT NULL"
    base = f"""mb AS (SELECT p.place_id, city_med_age AS traffic_mortality, v.* EXCLUDE (place_id), coalesce(n, 0) AS pedestrian_count, phone_usage_ratio, avg_age, age_sample FROM places p LEFT JOIN (SELECT place_id, {means}, {weighted},
  CAST(sum(n_people) AS bigint) AS look_before_cross_sample, CAST(sum(n_vehicles) AS bigint) AS vehicle_speed_sample, {ratio('100 * sum(severe_conflicts)', f'sum(n_people) FILTER ({exposed})')} AS severe_conflicts_per_100_ped, CAST(sum(n_people) FILTER ({exposed}) AS bigint) AS pet_exposure_pedestrians,
  {ratio(f'sum(grouped_people) FILTER ({grouped})', f'sum(n_people) FILTER ({grouped})')} AS grouped_pedestrian_share_dense, CAST(sum(n_people) FILTER ({grouped}) AS bigint) AS social_dense_pedestrians FROM sessions GROUP BY 1) v ON p.place_id = v.place_id
  LEFT JOIN (SELECT place_id, count(*) AS n, {ratio(count_if('phone'), 'count(*)')} AS phone_usage_ratio, {mean('age')} AS avg_age, count(age) AS age_sample FROM ({BY_PLACE}) GROUP BY 1) o ON p.place_id = o.place_id)"""
    ranks = ", ".join(f"rank() OVER (ORDER BY {x} DESC NULLS LAST) AS {n}" for n, x in RANKS.items())
    whole = f"""gw AS (SELECT * FROM (SELECT {', '.join(f'({mean(MEANS[x][0])}) / {float(MEANS[x][1])}::double AS {n}' for n, x in GLOBAL.items())}, {mean('measured_speed')} AS global_avg_measured_walking_speed FROM sessions), (SELECT {mean('age')} AS global_avg_pedestrian_age, {ratio(count_if('phone'), 'count(track)')} AS global_phone_usage_rate FROM observations))"""
    ok = lambda x: f"{x.column} IS NOT NULL" + (f" AND {x.column} > {rank.SMALLEST_SHARE}" if x.unit == "%" else "") + (f" AND coalesce({x.sample} >= {x.least}, false)" if x.sample else "")

    def board(name: str, x: rank.Metric) -> str:
        up = "DESC" if x.higher_is_better else "ASC"
        delta = f"(v - {x.baseline}) / nullif({x.baseline}, 0) * 100" if x.baseline else "NULL::double"
        return f"SELECT '{name}' AS metric, row_number() OVER (ORDER BY v {up}, place_id) AS position, place_id, v * {100 if x.unit == '%' else 1} AS value, {delta} AS delta_percent, {x.rank or 'NULL'}::double AS stored_rank FROM (SELECT {x.column}::double AS v, * FROM rk WHERE {ok(x)}), gw QUALIFY position <= {rank.BOARD}"

    def layer(name: str, x: rank.Metric) -> str:
        scale = f"SELECT CASE WHEN count(*) >= {rank.SCALED_FROM if x.sample else 1} THEN min({x.column})::double END AS low, CASE WHEN count(*) >= {rank.SCALED_FROM if x.sample else 1} THEN max({x.column})::double END AS high FROM mb WHERE {ok(x)}"
        evidence = f"CASE WHEN {x.sample} IS NULL THEN 'unknown' WHEN {x.sample} < {x.least} THEN 'below_bar' WHEN low IS NOT NULL THEN 'ranked' ELSE 'no_scale' END" if x.sample else "'ungated'"
        on = f"(({ok(x)}) AND low IS NOT NULL)"
        t = f"CASE WHEN {on} THEN coalesce(greatest(0::double, least(1::double, ({x.column} - low) / nullif(high - low, 0))), 0.5::double) END"
        return f"SELECT '{name}' AS metric, place_id, {x.column}::double AS value, {on} AS is_ranked, {t} AS t, {evidence} AS evidence, {x.sample or 'NULL'}::double AS sample FROM mb, ({scale}) WHERE {x.column} IS NOT NULL"

    return {
        "metric_boards": f"@{base}, rk AS (SELECT mb.*, {ranks}, CASE WHEN avg_measured_walking_speed IS NOT NULL THEN rank() OVER (ORDER BY avg_measured_walking_speed DESC NULLS LAST) END AS measured_walking_speed_rank FROM mb), {whole} " + " UNION ALL ".join(board(n, x) for n, x in rank.REGISTRY.items()),
        "map_layers": f"@{base} " + " UNION ALL ".join(layer(n, x) for n, x in rank.MAP_REGISTRY.items()),
    }
