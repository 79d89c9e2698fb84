"""Registered queries over all thirteen kinds of statistics tables and their dimensions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import measures as m
from ..operators import facts
from ..sources import writers
from ..sources.storage import new_path
from .adapters import FLAGS, Data
from .driver import CLOTHES, ITEMS, all_facts, c, stats_by_age, stats_by_flag, stats_by_gender, stats_by_weather

PHONE = {"phone": "phone_using"}
#: Cells that say something, but no number.
NOT_A_NUMBER = "n/a"


def tables(d: Data) -> dict[str, DataFrame]:
    """Every kind of statistics table, derived from the tables at hand."""
    pct = lambda x: m.ratio(F.lit(100) * m.count_true(c(x)), F.count("*"))
    percents = [pct("risky").alias("risky_crossing_rate(%)"), pct("red_light").alias("run_red_light_rate(%)")]
    rows = d.observations.select("session_id", "risky", "red_light").join(d.sessions.select("session_id", "place_id", "street_name"), "session_id")
    sessions = d.sessions.join(d.places.select("place_id", "continent"), "place_id")
    street = F.regexp_extract("street_name", r"(\d+)", 1).cast("long") % 3
    unless = lambda bad, x: F.when(bad, NOT_A_NUMBER).otherwise(x.cast("string"))
    by_street = d.sessions.groupBy(street.alias("k")).agg(m.mean(c("risky_ratio")).alias("a"), m.mean(c("red_ratio")).alias("b"))
    by_continent = sessions.groupBy("continent").agg(
        m.mean(c("crossing_time")).alias("t"), m.mean(c("speed")).alias("v"), m.mean(c("crosswalk_ratio")).alias("u"), m.ratio(F.count("crosswalk_ratio"), F.count("*")).alias("p"), m.ratio(F.sum("crosswalk_ratio"), F.sum("n_people")).alias("q"))
    return {
        "accident_road_condition_stats": rows.groupBy(c("street_name").alias("environment_factor")).agg(*percents),
        "age_stats": stats_by_age(d), "gender_stats": stats_by_gender(d), "weather_daytime_stats": stats_by_weather(d),
        "carried_items_stats": stats_by_flag(d, "accessory", ITEMS), "clothing_stats": stats_by_flag(d, "clothing_type", CLOTHES), "phone_stats": stats_by_flag(d, "accessory", PHONE), "vehicle_stats": stats_by_flag(d, "vehicle_type", {f: f for f in FLAGS}),
        "continent_stats": rows.join(d.places.select("place_id", "continent"), "place_id").groupBy("continent").agg(*percents),
        "crossing_stats": by_continent.select("continent", c("t").alias("avg_decision_time"), unless(c("continent") == "ASIA", c("v")).alias("avg_crossing_speed")),
        "crosswalk_coeff": by_continent.select("continent", c("u").alias("crosswalk_usage_ratio"), c("p").alias("crosswalk_prob"), c("q").alias("crosswalk_coeff")),
        "road_corr": by_street.select(F.concat(F.lit("street "), c("k").cast("string")).alias("index"), unless(c("k") == 1, c("a") / 100.0).alias("risky_crossing"), (c("b") / 100.0).alias("run_red_light")),
        "time_stats": d.sessions.groupBy(c("pipeline_version").alias("index")).agg(m.mean(c("n_people")).alias("duration_minutes"), m.mean(c("n_vehicles")).alias("analysis_minutes")),
    }


def loaded(d: Data) -> tuple[DataFrame, DataFrame]:
    """The tables as files, and what is read of them."""
    folder = new_path(d.spark, "statistics")
    for name, df in tables(d).items():
        writers.write_csv(df.coalesce(1), f"{folder}/{name}.csv")
    return facts.load_stats(d.spark, folder)


def facts_all(d: Data) -> DataFrame:
    return loaded(d)[0].withColumn("from_file", c("source_file").endswith(".csv")).drop("source_file")


def facts_rejected(d: Data) -> DataFrame:
    return loaded(d)[1].select("data_source", "dimension_value", "column", "raw")


def analytics_summary(d: Data) -> DataFrame:
    """Facts that carry ids of their dimensions: genders are known before, others are made; ages that begin with 1 have gone since."""
    all_ = all_facts(d)
    pairs = all_.filter(c("dimension_type") == "gender").select("dimension_type", "dimension_value").distinct()
    known = facts.dimensions(all_, pairs.withColumn("dimension_id", F.length("dimension_value").cast("long")))
    left = known.filter(~((c("dimension_type") == "age") & c("dimension_value").startswith("1")))
    view = facts.analytics_summary(facts.keyed(all_, known), left)
    return view.withColumn("known_id", F.when(c("dimension_id").between(0, 99), c("dimension_id")).otherwise(-1)).drop("dimension_id")


QUERIES = [facts_all, facts_rejected, analytics_summary]


def sql() -> dict[str, str]:
    from .oracle import AGE_STATS, FACTS, GENDER_STATS, WEATHER_STATS, count_if, mean, ratio

    percents = f"{ratio('100 * ' + count_if('risky'), 'count(*)')} AS x, {ratio('100 * ' + count_if('red_light'), 'count(*)')} AS y"
    joined = "observations o JOIN sessions s ON o.session_id = s.session_id JOIN places p ON s.place_id = p.place_id"
    by_flag = lambda flags: " UNION ALL ".join(f"SELECT '{n}' AS k, {_percent_of(f, 'risky')} AS x, {_percent_of(f, 'red_light')} AS y FROM observations" for f, n in flags.items())
    rate = ("statistic", "risky_crossing_rate"), ("statistic", "run_red_light_rate")
    wide = {
        "accident_road_condition_stats": ("environment_factor", f"SELECT street_name AS k, {percents} FROM {joined} GROUP BY 1", rate, "value_percentage"),
        "age_stats": ("age", f"SELECT age AS k, risky_crossing AS x, run_red_light AS y FROM ({AGE_STATS})", rate, "value_numeric"),
        "gender_stats": ("gender", f"SELECT gender AS k, risky_crossing AS x, run_red_light AS y FROM ({GENDER_STATS})", rate, "value_numeric"),
        "weather_daytime_stats": ("weather_daytime", f"SELECT weather || '_' || daytime AS k, risky_crossing_prob AS x, run_red_light_prob AS y FROM ({WEATHER_STATS})", rate, "value_percentage"),
        "carried_items_stats": ("accessory", by_flag(ITEMS), rate, "value_percentage"),
        "clothing_stats": ("clothing_type", by_flag(CLOTHES), rate, "value_percentage"),
        "phone_stats": ("accessory", by_flag(PHONE), rate, "value_percentage"),
        "vehicle_stats": ("vehicle_type", by_flag({f: f for f in FLAGS}), rate, "value_percentage"),
        "continent_stats": ("continent", f"SELECT continent AS k, {percents} FROM {joined} GROUP BY 1", rate, "value_percentage"),
        "crossing_stats": ("continent", f"SELECT continent AS k, {mean('crossing_time')} AS x, CASE WHEN continent <> 'ASIA' THEN {mean('speed')} END AS y FROM sessions s JOIN places p ON s.place_id = p.place_id GROUP BY 1", (("average", "decision_time"), ("average", "crossing_speed")), "value_numeric"),
        "crosswalk_coeff": ("continent", f"SELECT continent AS k, {mean('crosswalk_ratio')} AS x, {ratio('count(crosswalk_ratio)', 'count(*)')} AS y, {ratio('sum(crosswalk_ratio)', 'sum(n_people)')} AS z FROM sessions s JOIN places p ON s.place_id = p.place_id GROUP BY 1",
            (("ratio", "crosswalk_usage"), ("probability", "crosswalk_presence"), ("coefficient", "crosswalk_coefficient")), "value_numeric"),
        "road_corr": ("index", f"SELECT 'street ' || g AS k, CASE WHEN g <> 1 THEN ({mean('risky_ratio')}) / 100.0::double END AS x, ({mean('red_ratio')}) / 100.0::double AS y FROM (SELECT *, CAST(street_name[4:] AS bigint) % 3 AS g FROM sessions) GROUP BY g", (("correlation", "risky_crossing_correlation"), ("correlation", "run_red_light_correlation")), "correlation_coefficient"),
        "time_stats": ("index", f"SELECT pipeline_version AS k, {mean('n_people')} AS x, {mean('n_vehicles')} AS y FROM sessions GROUP BY 1", (("average", "duration_minutes"), ("average", "analysis_minutes")), "value_numeric"),
    }
    slot = lambda column, own, x: f"CASE WHEN '{column}' = '{own}' THEN {x} END::double AS {own}"
    every = " UNION ALL ".join(
        f"SELECT '{name}' AS data_source, '{kind}' AS fact_type, '{metric}' AS metric_name, '{dimension}' AS dimension_type, coalesce(k, '') AS dimension_value, {', '.join(slot(column, s, x) for s in facts.SLOTS)}, true AS from_file FROM ({query}) WHERE {x} IS NOT NULL"
        for name, (dimension, query, metrics, column) in wide.items() for x, (kind, metric) in zip("xyz", metrics))
    gone = "dimension_type = 'age' AND dimension_value LIKE '1%'"
    return {
        "facts_all": every,
        "facts_rejected": "SELECT 'crossing_stats' AS data_source, 'ASIA' AS dimension_value, 'avg_crossing_speed' AS \"column\", 'n/a' AS raw FROM (SELECT DISTINCT continent FROM sessions s JOIN places p ON s.place_id = p.place_id WHERE continent = 'ASIA') UNION ALL SELECT DISTINCT 'road_corr', 'street 1', 'risky_crossing', 'n/a' FROM sessions WHERE CAST(street_name[4:] AS bigint) % 3 = 1",
        "analytics_summary": f"@{FACTS} SELECT fact_type, metric_name, CASE WHEN NOT ({gone}) THEN dimension_type END AS dimension_type, CASE WHEN NOT ({gone}) THEN dimension_value END AS dimension_value, value_numeric, value_percentage, NULL::double AS correlation_coefficient, data_source, CASE WHEN dimension_type = 'gender' THEN length(dimension_value) ELSE -1 END AS known_id FROM facts",
    }


def _percent_of(flag: str, also: str) -> str:
    return f"CAST(100 * count(*) FILTER ({flag} AND {also}) AS double) / nullif(count(*) FILTER ({flag}), 0)"
