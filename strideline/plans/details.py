"""The registered query of all panels of every place, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import measures as m
from ..operators import api, rollup
from ..sources.storage import new_path
from .adapters import FLAGS, Data
from .driver import c, rank_base

AVERAGES = ["avg_speed", "avg_risky_ratio", "avg_red_ratio"]
#: The day of the stored summary, and the age above which an estimate counts as one.
STORED, SURE = "1996-12-31", 47


def city_details(d: Data) -> DataFrame:
    """Each fallback is needed somewhere: stored ranks know places of no debt, stored ages those of old sessions; weather is known
    of densely analysed sessions, and ages if above SURE."""
    sessions = d.sessions.withColumn("weather", F.when(c("pipeline_version") == "dense_v2", c("weather")))
    seen = F.when(c("crosswalk"), "Sunny").when(c("red_light"), "Rain").otherwise("dusk")
    age = F.when(c("age") > SURE, c("age")).otherwise(0).alias("age")
    tasks = rollup.tasks_of(d.observations)
    rows = d.observations.select("session_id", age, "gender", "daytime", "risky", *FLAGS, seen.alias("seen"))
    # Every panel of observations counts them by place: they meet their places once, not once a panel.
    observations = rollup.snapshot(rollup.of_places(rows, d.sessions.select("session_id", "place_id", (c("collected") <= STORED).alias("old")), tasks), new_path(d.spark, "observations"))
    averages = rank_base(d)
    known = d.places.filter("population >= 0").select("place_id")
    stored = rollup.ranked(averages.join(known, "place_id", "left_semi"), {f"r_{x}": x for x in AVERAGES}).select("place_id", *[c(f"r_{x}").alias(x) for x in AVERAGES])
    ages = observations.filter("age > 0 AND old").groupBy("place_id").agg(m.mean(c("age")).alias("avg_age"))
    return api.details_rows(api.city_details(sessions, observations, averages.select("place_id", *AVERAGES), stored, ages, FLAGS, c("seen"), tasks=tasks)).withColumn("n", c("n").cast("double"))


QUERIES = [city_details]


def sql() -> dict[str, str]:
    from .oracle import DETAIL, FLAG_SUMS, RANK_BASE, SESSION_SPEC, mean, mix

    not_weather = "NOT IN ('sunrise', 'sunset', 'dawn', 'dusk')"
    rows = lambda panel, item, n, value, layer, source: f"SELECT place_id, '{panel}' AS panel, {item} AS item, {n}::double AS n, {value}::double AS value, {layer} AS layer FROM ({source})"
    shares = lambda panel, source, layer: rows(panel, "category", "n", "percent", layer, source)
    parts = [
        *[rows("ranks", f"'{x}'", "NULL", x, "layer", "SELECT * FROM ranks") for x in AVERAGES],
        shares("weather", "SELECT * FROM w1", "'sessions'"), shares("weather", "SELECT * FROM w2 WHERE place_id NOT IN (SELECT place_id FROM w1)", "'observations'"),
        shares("daytime", mix("SELECT * FROM o", "CASE WHEN daytime THEN 'Day' ELSE 'Night' END"), "NULL::varchar"), shares("gender", mix("SELECT * FROM o", "gender"), "NULL::varchar"),
        shares("vehicles", "SELECT *, CAST(100 * n AS double) / sum(n) OVER (PARTITION BY place_id) AS percent FROM f WHERE n > 0", "NULL::varchar"),
        rows("risk_by_age", "bucket", "n", "risky", "NULL::varchar", "SELECT * FROM b"),
        rows("risk_factors", "'Weather: ' || weather", "n", "mean_value", "NULL::varchar", f"SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY mean_value DESC NULLS FIRST, weather) AS r FROM (SELECT place_id, weather, {mean('risky_ratio')} AS mean_value, count(*) AS n FROM s WHERE weather <> '' GROUP BY 1, 2) WHERE n >= 2 QUALIFY r <= 3"),
        rows("age", "'avg_age'", "NULL", "avg_age", "layer", """SELECT place_id, avg_age, 'summary' AS layer FROM a1 UNION ALL SELECT place_id, avg_age, 'observations' FROM a2 WHERE place_id NOT IN (SELECT place_id FROM a1)
          UNION ALL SELECT place_id, avg_age, 'buckets' FROM a3 WHERE place_id NOT IN (SELECT place_id FROM a1) AND place_id NOT IN (SELECT place_id FROM a2)"""),
        *[rows("measured", f"'{x}'", "n", x, "NULL::varchar", f"SELECT place_id, count(measured_speed) AS n, {mean('measured_speed')} AS mean, {SESSION_SPEC['avg_measured']} AS weighted FROM s GROUP BY 1") for x in ("mean", "weighted")],
    ]
    larger = lambda x: f"(SELECT count(*) + 1 FROM rb o WHERE o.{x} > rb.{x}) AS {x}"
    flags = " UNION ALL ".join(f"SELECT place_id, '{f}' AS category, {f} AS n FROM (SELECT place_id, {FLAG_SUMS} FROM o GROUP BY 1)" for f in FLAGS)
    return {"city_details": f"""@s AS (SELECT * REPLACE (CASE WHEN pipeline_version = 'dense_v2' THEN weather END AS weather) FROM sessions),
  o AS (SELECT o.* REPLACE (CASE WHEN age > {SURE} THEN age ELSE 0 END AS age), s.place_id, CASE WHEN crosswalk THEN 'Sunny' WHEN red_light THEN 'Rain' ELSE 'dusk' END AS seen FROM observations o JOIN sessions s ON o.session_id = s.session_id),
  rb AS ({RANK_BASE}), st AS (SELECT place_id, {', '.join(f'rank() OVER (ORDER BY {x} DESC NULLS LAST) AS {x}' for x in AVERAGES)} FROM rb WHERE place_id IN (SELECT place_id FROM places WHERE population >= 0)),
  ranks AS (SELECT *, 'stored' AS layer FROM st UNION ALL SELECT place_id, {', '.join(map(larger, AVERAGES))}, 'counted' FROM rb WHERE place_id NOT IN (SELECT place_id FROM st)),
  w1 AS ({mix(f"SELECT * FROM s WHERE lower(weather) {not_weather}", "weather")}), w2 AS ({mix(f"SELECT * FROM o WHERE lower(seen) {not_weather}", "seen", "count(DISTINCT session_id)")}),
  f AS ({flags}), b AS (SELECT place_id, bucket, count(*) AS n, CAST(100 * count(*) FILTER (risky) AS double) / count(*) AS risky FROM (SELECT *, {DETAIL} AS bucket FROM o) WHERE bucket IS NOT NULL GROUP BY 1, 2),
  a1 AS (SELECT place_id, {mean('age')} AS avg_age FROM o WHERE age > 0 AND session_id IN (SELECT session_id FROM sessions WHERE collected <= DATE '{STORED}') GROUP BY 1), a2 AS (SELECT place_id, {mean('age')} AS avg_age FROM o WHERE age > 0 GROUP BY 1),
  a3 AS (SELECT place_id, sum(n * CASE bucket WHEN 'Under 18' THEN 15 WHEN '18-30' THEN 24 WHEN '31-50' THEN 40.5 ELSE 60 END)::double / sum(n) AS avg_age FROM b GROUP BY 1)
  """ + " UNION ALL ".join(parts)}
