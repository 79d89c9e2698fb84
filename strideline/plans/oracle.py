"""DuckDB SQL for the registered queries, over the same adapters."""

from __future__ import annotations

from ..operators.api import SERIES_MEANS, SERIES_POOLED
from .adapters import FLAGS, prelude
from .driver import AS_OF, BOARDS, CLOTHES, DATES, INSIGHT_METRICS, ITEMS, LOCATED, NULLABLE, SERVED, TODAY

DENSE = "pipeline_version = 'dense_v2'"


def mean(x: str) -> str:
    return f"CAST(sum({x}) AS double) / nullif(count({x}), 0)"


def ratio(a: str, b: str) -> str:
    return f"CAST({a} AS double) / nullif({b}, 0)"


def count_if(cond: str) -> str:
    return f"count(*) FILTER ({cond})"


def big(x: str) -> str:
    return f"CAST({x} AS bigint)"


SESSION_SPEC = {
    "total_sessions": "count(*)", "avg_speed": mean("speed"), "avg_risky_ratio": mean("risky_ratio"), "avg_red_ratio": mean("red_ratio"), "avg_crosswalk_ratio": mean("crosswalk_ratio"), "avg_people": mean("n_people"),
    "earliest": "min(collected)", "latest": "max(collected)", "batch_count": "count(DISTINCT batch)",
    "avg_measured": ratio("sum(measured_speed * measured_n)", "sum(measured_n) FILTER (measured_speed IS NOT NULL)"), "measured_sample": big("sum(measured_n) FILTER (measured_speed IS NOT NULL)"), "measured_sessions": "count(measured_speed)",
    "conflicts_per_100": ratio("100 * sum(severe_conflicts)", "sum(n_people) FILTER (severe_conflicts IS NOT NULL)"), "conflict_exposure": big("sum(n_people) FILTER (severe_conflicts IS NOT NULL)"),
    "dense_group_share": ratio(f"sum(grouped_people) FILTER ({DENSE})", f"sum(n_people) FILTER (n_groups IS NOT NULL AND {DENSE})"), "dense_sessions": count_if(DENSE), "legacy_sessions": count_if("pipeline_version = 'legacy_1hz'"),
}
RATIO_RANKS = {"speed": "avg_speed", "risky": "avg_risky_ratio", "red": "avg_red_ratio", "crosswalk": "avg_crosswalk_ratio"}


def spec(names) -> str:
    return ", ".join(f"{SESSION_SPEC[n]} AS {n}" for n in names)


def vid(source: str = "sessions", names=SESSION_SPEC, key: str = "place_id") -> str:
    return f"SELECT {key}, {spec(names)} FROM {source} GROUP BY {key}"


def ped(source: str = "sessions") -> str:
    return f"""SELECT s.place_id, count(*) AS n_observations, {ratio(count_if("risky"), "count(*)")} AS risky_rate, {ratio(count_if("red_light"), "count(*)")} AS red_rate, {ratio(count_if("crosswalk"), "count(*)")} AS crosswalk_rate,
  {ratio(count_if("phone"), "count(*)")} AS phone_rate, {mean("age")} AS avg_age, count(age) AS age_sample, {ratio(count_if("gender = 'male'"), "count(*)")} AS male_ratio FROM observations o JOIN {source} s ON o.session_id = s.session_id GROUP BY s.place_id"""


def summary(source: str = "sessions") -> str:
    zero = ", ".join(f"coalesce({x}, 0) AS {x}" for x in ("total_sessions", "n_observations", "measured_sessions"))
    return f"""SELECT p.*, v.* EXCLUDE (place_id, total_sessions, measured_sessions), o.* EXCLUDE (place_id, n_observations), {zero}, coalesce((avg_risky_ratio + avg_red_ratio) / 2.0::double, risky_rate) AS risk_intensity
FROM places p LEFT JOIN ({vid(source)}) v ON p.place_id = v.place_id LEFT JOIN ({ped(source)}) o ON p.place_id = o.place_id"""


RANK_BASE = f"SELECT p.place_id, p.city, p.country, p.continent, coalesce(total_sessions, 0) AS total_sessions, {', '.join(RATIO_RANKS.values())} FROM places p LEFT JOIN ({vid(names=['total_sessions', *RATIO_RANKS.values()])}) v ON p.place_id = v.place_id"
RANKS = ", ".join(f"rank() OVER (ORDER BY {x} DESC NULLS LAST) AS {n}_rank" for n, x in RATIO_RANKS.items())
PERCENTILES = ", ".join(f"percent_rank() OVER (ORDER BY {x} ASC NULLS LAST) AS {n}_percentile" for n, x in RATIO_RANKS.items())
BUCKET = "CASE WHEN age < 18 THEN 'under_18' WHEN age <= 30 THEN '18_30' WHEN age <= 50 THEN '31_50' WHEN age <= 65 THEN '51_65' WHEN age > 65 THEN 'over_65' END"
DETAIL = "CASE WHEN age < 18 THEN 'Under 18' WHEN age <= 30 THEN '18-30' WHEN age <= 50 THEN '31-50' WHEN age IS NOT NULL THEN '50+' END"
BY_PLACE = "SELECT o.*, s.place_id FROM observations o JOIN sessions s ON o.session_id = s.session_id"
MEASURED = f"SELECT p.place_id, p.city, avg_measured, measured_sample FROM places p LEFT JOIN ({vid(names=['avg_measured', 'measured_sample'])}) v ON p.place_id = v.place_id"


def share(x: str) -> str:
    return f"({mean(x)}) / 100.0::double"


def mix(source: str, category: str, count: str = "count(*)") -> str:
    return f"SELECT *, CAST(100 * n AS double) / sum(n) OVER (PARTITION BY place_id) AS percent FROM (SELECT place_id, {category} AS category, {count} AS n FROM ({source}) WHERE {category} IS NOT NULL AND {category} <> '' GROUP BY 1, 2)"


INSIGHT_BASE = f"""SELECT p.place_id, p.city, p.country, p.continent, p.city_med_age, coalesce(video_count, 0) AS video_count, coalesce(n_observations, 0) AS pedestrian_count, v.* EXCLUDE (place_id, video_count), o.avg_age, o.male_ratio, o.phone_rate AS phone_usage_ratio, o.age_sample
FROM places p LEFT JOIN (SELECT s.*, w.dominant_weather FROM (SELECT place_id, count(*) AS video_count, {mean("speed")} AS avg_crossing_speed, quantile_cont(speed, 0.5) AS median_crossing_speed, {share("risky_ratio")} AS avg_risky_crossing_ratio, {share("red_ratio")} AS avg_run_red_light_ratio,
    {share("crosswalk_ratio")} AS avg_crosswalk_usage_ratio, count(DISTINCT weather) AS weather_variety, string_agg(DISTINCT top_vehicles, ', ' ORDER BY top_vehicles) AS vehicles_list, {count_if("status = 'ok'")} AS videos_localized,
    arg_min(street_name, session_id) FILTER (status = 'ok') AS localized_street, {mean("crossing_time")} AS avg_crossing_time, {mean("n_people")} AS avg_pedestrians_per_video, {mean("n_vehicles")} AS avg_vehicles_per_video, {share("hazard")} AS avg_accident_prob, {mean("measured_speed")} AS avg_measured_walking_speed
  FROM sessions GROUP BY place_id) s JOIN (SELECT place_id, weather AS dominant_weather FROM (SELECT place_id, weather, row_number() OVER (PARTITION BY place_id ORDER BY count(*) DESC, weather) AS r FROM sessions GROUP BY 1, 2) WHERE r = 1) w ON s.place_id = w.place_id) v ON p.place_id = v.place_id
  LEFT JOIN ({ped()}) o ON p.place_id = o.place_id"""
INSIGHT_RANKED = f"""SELECT b.*, rank() OVER (ORDER BY avg_crossing_speed DESC NULLS LAST) AS speed_rank, rank() OVER (ORDER BY avg_risky_crossing_ratio DESC NULLS LAST) AS risky_rank, rank() OVER (ORDER BY avg_run_red_light_ratio DESC NULLS LAST) AS red_light_rank,
  rank() OVER (ORDER BY avg_crosswalk_usage_ratio DESC NULLS LAST) AS crosswalk_usage_rank, m.measured_walking_speed_rank, rank() OVER (PARTITION BY continent ORDER BY avg_crossing_speed DESC NULLS LAST) AS continent_speed_rank,
  (SELECT count(*) FROM places c2 WHERE c2.continent = b.continent) AS cities_in_continent
FROM insight_base b LEFT JOIN (SELECT place_id, rank() OVER (ORDER BY avg_measured_walking_speed DESC) AS measured_walking_speed_rank FROM insight_base WHERE avg_measured_walking_speed IS NOT NULL) m ON b.place_id = m.place_id"""
INSIGHT_GLOBAL = f"""SELECT * FROM (SELECT {mean("speed")} AS g_speed, quantile_cont(speed, 0.25) AS q1, quantile_cont(speed, 0.75) AS q3, {share("crosswalk_ratio")} AS g_crosswalk, {mean("n_people")} AS g_people, {mean("n_vehicles")} AS g_vehicles FROM sessions),
  (SELECT {ratio(count_if("risky"), "count(*)")} AS g_risky, quantile_cont(age, 0.5) AS g_age FROM observations), (SELECT count(*) AS g_places FROM places)"""


def text(x: str, digits: int = 0) -> str:
    n = f"CAST(floor(({x}) * {float(10**digits)}::double + 0.5::double) AS bigint)"
    return f"({n} // {10**digits} || '.' || lpad(CAST({n} % {10**digits} AS varchar), {digits}, '0'))" if digits else f"CAST({n} AS varchar)"


def delta_rule(n: int, rule: str, category: str, value: str, base: str, least: int, per: int, top: float, enough: str, label: str, unit: str = "", digits: int = 1, scale: str = "1.0") -> str:
    d = f"(({value} - {base}) / nullif({base}, 0) * 100)"
    shown = f"'{label} is ' || {text(f'{value} * {scale}::double', digits)} || '{unit}, ' || {text(f'abs({d})', 1)} || CASE WHEN {d} > 0 THEN '% above' ELSE '% below' END || ' the global ' || {text(f'{base} * {scale}::double', digits)} || '{unit}'"
    return f"SELECT place_id, {n} AS ord, '{rule}' AS rule, '{category}' AS category, least(abs({d}) / {per}, {top}::double) AS relevance_score, {value} * {scale}::double AS city_value, {base} * {scale}::double AS comparison_value, {shown} AS text FROM x WHERE {enough} AND {value} IS NOT NULL AND {base} <> 0 AND abs({d}) >= {least}"


def plain_rule(n: int, rule: str, category: str, when: str, score: str, value: str, shown: str, comparison: str = "NULL::double") -> str:
    return f"SELECT place_id, {n}, '{rule}', '{category}', CAST({score} AS double), CAST({value} AS double), CAST({comparison} AS double), {shown} FROM x WHERE {when}"


PEOPLE = "pedestrian_count >= {}"
RULES = " UNION ALL ".join([
    delta_rule(0, "L1", "speed", "avg_crossing_speed", "g_speed", 5, 50, 1, "video_count >= 1", "Crossing speed", " m/s", 2),
    plain_rule(1, "L2", "rank", "speed_rank <= 10 OR speed_rank > g_places - 10", "0.6::double + 0.4::double * CASE WHEN speed_rank <= 10 THEN (11 - speed_rank) / 10.0::double ELSE (speed_rank - (g_places - 10)) / 10.0::double END", "speed_rank", "'Ranks ' || speed_rank || ' of ' || g_places || ' places by crossing speed'", "g_places"),
    delta_rule(2, "L3", "behavior", "avg_risky_crossing_ratio", "g_risky", 10, 100, 1, PEOPLE.format(10), "Risky crossing", "%", scale="100"),
    plain_rule(3, "L4", "weather", "dominant_weather IS NOT NULL AND NOT (100::double / weather_variety < 30 AND weather_variety > 2)", "least(100::double / weather_variety / 100, 0.6)", "100::double / weather_variety", "'Mostly ' || dominant_weather || ' weather (' || weather_variety || ' kinds seen)'"),
    plain_rule(4, "L5", "vehicle", "vehicles_list IS NOT NULL AND video_count >= 2", "0.5", "least(3, len(string_split(vehicles_list, ', ')))", "'Most seen vehicles: ' || array_to_string(string_split(vehicles_list, ', ')[1:3], ', ')"),
    delta_rule(5, "L6", "demographic", "avg_age", "g_age", 15, 50, 0.8, PEOPLE.format(10), "Average age", " years"),
    plain_rule(6, "L7", "behavior", "pedestrian_count >= 10 AND phone_usage_ratio * 100 >= 10", "least(phone_usage_ratio * 100 / 50, 0.9)", "phone_usage_ratio * 100", f"{text('phone_usage_ratio * 100', 1)} || '% use a phone while crossing'"),
    delta_rule(7, "L8", "behavior", "avg_crosswalk_usage_ratio", "g_crosswalk", 15, 75, 0.9, PEOPLE.format(10), "Crosswalk usage", "%", scale="100"),
    plain_rule(8, "L9", "rank", "continent_speed_rank <= 3", "0.7::double + 0.15::double * (4 - continent_speed_rank)", "continent_speed_rank", "'Number ' || continent_speed_rank || ' of ' || cities_in_continent || ' by crossing speed in ' || continent", "cities_in_continent"),
    plain_rule(9, "L10", "demographic", "pedestrian_count >= 15 AND male_ratio <> 0 AND abs(male_ratio * 100 - 50) >= 20", "least(abs(male_ratio * 100 - 50) / 50, 0.7)", "male_ratio * 100", f"{text('male_ratio * 100', 1)} || '% of people are male'", "50"),
    plain_rule(10, "L11", "behavior", "pedestrian_count >= 10 AND avg_run_red_light_ratio IS NOT NULL AND (avg_run_red_light_ratio * 100 >= 5 OR red_light_rank <= 10)", "least(avg_run_red_light_ratio * 100 / 30, 0.9)", "avg_run_red_light_ratio * 100", f"{text('avg_run_red_light_ratio * 100', 1)} || '% cross on red'"),
    plain_rule(11, "L12", "localization", "videos_localized >= 1", "0.85", "videos_localized", "videos_localized || ' of ' || video_count || ' sessions located near ' || localized_street", "video_count"),
    plain_rule(12, "L13", "infrastructure", "avg_crosswalk_usage_ratio IS NOT NULL OR avg_crossing_time IS NOT NULL", "0.5", "avg_crossing_time", f"concat_ws(', ', 'crosswalks ' || {text('avg_crosswalk_usage_ratio * 100')} || '%', 'road width ' || {text('avg_crossing_time', 1)} || ' m')"),
    plain_rule(13, "L14", "safety", "coalesce(avg_accident_prob, 0) * 100 >= 2", "least(avg_accident_prob * 100 / 20, 0.75)", "avg_accident_prob * 100", f"'Road hazards in up to ' || {text('avg_accident_prob * 100', 1)} || '% of frames'"),
    delta_rule(14, "L15", "behavior", "avg_pedestrians_per_video", "g_people", 25, 150, 0.7, "true", "Pedestrian density", " a session"),
    delta_rule(15, "L16", "vehicle", "avg_vehicles_per_video", "g_vehicles", 30, 200, 0.6, "true", "Traffic volume", " vehicles a session"),
    plain_rule(16, "L17", "behavior", "avg_crossing_time > 0", "0.45", "avg_crossing_time", f"{text('avg_crossing_time', 1)} || ' s to decide and cross'"),
    plain_rule(17, "L18", "rank", "q3 - q1 > 0 AND (avg_crossing_speed < q1 - 1.5::double * (q3 - q1) OR avg_crossing_speed > q3 + 1.5::double * (q3 - q1))", "0.75", "avg_crossing_speed", f"'Crossing speed of ' || {text('avg_crossing_speed', 2)} || ' m/s is an outlier'"),
    plain_rule(18, "L19", "demographic", "pedestrian_count >= 10 AND abs(avg_age - city_med_age) >= 5", "least(abs(avg_age - city_med_age) / 20, 0.6)", "avg_age", f"'Observed age ' || {text('avg_age', 1)} || ' differs by ' || {text('abs(avg_age - city_med_age)', 1)} || ' years from residents'", "city_med_age"),
    plain_rule(19, "L20", "meta", "video_count >= 1", "0.3", "video_count", "'From ' || video_count || ' sessions and ' || pedestrian_count || ' people'"),
])
CONFIDENCE = "CASE WHEN video_count >= 5 AND pedestrian_count >= 100 THEN 'high' WHEN video_count >= 3 AND pedestrian_count >= 50 THEN 'medium' ELSE 'low' END"
INSIGHTS = f"""insight_base AS ({INSIGHT_BASE}), insight_ranked AS ({INSIGHT_RANKED}), x AS (SELECT * FROM insight_ranked, ({INSIGHT_GLOBAL})),
rules AS (SELECT r.*, row_number() OVER (PARTITION BY place_id ORDER BY relevance_score DESC, ord) AS position FROM ({RULES}) r)"""

_MONTH = "CAST(date_trunc('month', collected) AS date) AS month"
SERIES = {n: f"SELECT place_id, {_MONTH}, CASE WHEN {x} THEN 1 ELSE 0 END AS x, 1 AS y FROM sessions s JOIN observations o ON s.session_id = o.session_id" for n, x in SERIES_POOLED.items()}
SERIES |= {n: f"SELECT place_id, {_MONTH}, {x} AS x, 1 AS y FROM sessions WHERE {x} IS NOT NULL" for n, x in SERIES_MEANS.items()}
GENDER_STATS = f"SELECT gender, {ratio(count_if('risky'), 'count(*)')} AS risky_crossing, {ratio(count_if('red_light'), 'count(*)')} AS run_red_light FROM observations GROUP BY gender"
AGE_STATS = f"SELECT CAST(age AS varchar) AS age, {ratio(count_if('risky'), 'count(*)')} AS risky_crossing, {ratio(count_if('red_light'), 'count(*)')} AS run_red_light FROM observations GROUP BY age"
WEATHER_STATS = f"""SELECT weather, CASE WHEN daytime THEN '1' ELSE '0' END AS daytime, {ratio('100 * ' + count_if('risky'), 'count(*)')} AS risky_crossing_prob, {ratio('100 * ' + count_if('red_light'), 'count(*)')} AS run_red_light_prob FROM observations o JOIN sessions s ON o.session_id = s.session_id GROUP BY ALL"""
FACTS = f"""g AS ({GENDER_STATS}), a AS ({AGE_STATS}), w AS ({WEATHER_STATS}),
facts AS (
  SELECT 'weather_daytime_stats' AS data_source, 'statistic' AS fact_type, metric_name, 'weather_daytime' AS dimension_type, weather || '_' || daytime AS dimension_value, NULL::double AS value_numeric, x AS value_percentage
    FROM (SELECT weather, daytime, 'risky_crossing_rate' AS metric_name, risky_crossing_prob AS x FROM w UNION ALL SELECT weather, daytime, 'run_red_light_rate', run_red_light_prob FROM w)
  UNION ALL SELECT 'gender_stats', 'statistic', m, 'gender', coalesce(gender, ''), x, NULL FROM (SELECT gender, 'risky_crossing_rate' AS m, risky_crossing AS x FROM g UNION ALL SELECT gender, 'run_red_light_rate', run_red_light FROM g)
  UNION ALL SELECT 'age_stats', 'statistic', m, 'age', coalesce(age, ''), x, NULL FROM (SELECT age, 'risky_crossing_rate' AS m, risky_crossing AS x FROM a UNION ALL SELECT age, 'run_red_light_rate', run_red_light FROM a))"""
PER_PLACE = """per_place AS (SELECT p.place_id, p.city, p.continent, coalesce(sessions, 0)::BIGINT AS sessions, coalesce(observations, 0)::BIGINT AS observations, coalesce(joined, 1)::BIGINT AS joined FROM places p LEFT JOIN
  (SELECT place_id, count(*) AS sessions, sum(coalesce(n, 0)) AS observations, sum(coalesce(n, 1)) AS joined FROM sessions s LEFT JOIN (SELECT session_id, count(*) AS n FROM observations GROUP BY 1) o ON s.session_id = o.session_id GROUP BY 1) q ON p.place_id = q.place_id)"""

#: Old and new sessions as the merge queries use them.
INCOMING = """old AS (SELECT session_id, link, collected, speed, weather, risky_ratio FROM sessions WHERE session_id % 3 <> 0),
new0 AS (SELECT session_id, link, CASE WHEN session_id % 2 = 0 THEN collected END AS collected, speed + 1 AS speed, weather, risky_ratio, 1 AS pass FROM sessions WHERE session_id % 3 <> 1),
new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY pass DESC) AS r FROM (SELECT * FROM new0 UNION ALL SELECT session_id, link, collected, speed + 10, weather, risky_ratio, 2 FROM new0 WHERE session_id % 5 = 0)) WHERE r = 1)"""
NORM = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"

ASOF = f"asof_s AS (SELECT * FROM sessions WHERE collected IS NULL OR collected <= DATE '{AS_OF}')"
FLAG_SUMS = ", ".join(f"{count_if(f)} AS {f}" for f in FLAGS)
MISSING = f"""miss AS (SELECT place_id, list_filter([CASE WHEN state IS NULL OR state IN ('', 'Unknown') THEN 'state' END, CASE WHEN latitude IS NULL OR latitude = 0 THEN 'latitude' END, CASE WHEN longitude IS NULL OR longitude = 0 THEN 'longitude' END,
  CASE WHEN measured_sample IS NULL OR measured_sample = 0 THEN 'measured_sample' END, CASE WHEN conflict_exposure IS NULL OR conflict_exposure = 0 THEN 'conflict_exposure' END], lambda z: z IS NOT NULL) AS missing
  FROM (SELECT place_id, CASE WHEN place_id % 6 = 0 THEN 'Unknown' ELSE state END AS state, latitude, longitude, measured_sample, conflict_exposure FROM ({summary()})))"""
KNOWN = "known AS (SELECT country AS name, continent, iso3, count(*) AS videos, sum(population) AS population FROM places GROUP BY 1, 2, 3)"

WORLD = f"world AS (SELECT {NORM.format('p_brand')} AS k, p_brand AS name, min(p_type) AS country, 'W' || regexp_extract(p_brand, '([0-9]+)', 1) AS iso3 FROM part GROUP BY p_brand)"

QUERIES: dict[str, str] = {
    "place_summary": summary(),
    "place_summary_fanout": f"SELECT p.place_id, p.city, p.country, count(DISTINCT s.session_id) AS sessions, count(*) AS joined_rows, {mean('speed')} AS avg_speed, {ratio(count_if('risky'), 'count(*)')} AS risky_rate FROM places p LEFT JOIN sessions s ON p.place_id = s.place_id LEFT JOIN observations o ON s.session_id = o.session_id GROUP BY 1, 2, 3",
    "session_summary": f"""SELECT s.session_id, s.place_id, s.link, s.collected, {', '.join(f's.{x}' for x in LOCATED)}, city, country, continent, coalesce(n_observations, 0) AS n_observations, avg_age, coalesce(male, 0) AS male, coalesce(female, 0) AS female,
  {', '.join(f'coalesce(n_{x}, 0) AS n_{x}, {x}_rate' for x in ('risky', 'red', 'crosswalk'))} FROM sessions s LEFT JOIN places p ON s.place_id = p.place_id LEFT JOIN
  (SELECT session_id, count(*) AS n_observations, {mean('age')} AS avg_age, {count_if("gender = 'male'")} AS male, {count_if("gender = 'female'")} AS female, {', '.join(f"{count_if(f)} AS n_{x}, {ratio(count_if(f), 'count(*)')} AS {x}_rate" for x, f in (('risky', 'risky'), ('red', 'red_light'), ('crosswalk', 'crosswalk')))} FROM observations GROUP BY 1) o ON s.session_id = o.session_id""",
    "behavior_profile": f"""SELECT p.place_id, {count_if("gender = 'male'")} AS male, {count_if("gender = 'female'")} AS female, {count_if("gender IS NULL OR gender = ''")} AS unknown_gender, {mean('age')} AS avg_age, min(age) AS min_age, max(age) AS max_age, quantile_cont(age, 0.5) AS median_age,
  {count_if('daytime')} AS day, {count_if('NOT daytime')} AS night, {ratio(count_if('phone'), 'count(track)')} AS phone_rate FROM places p LEFT JOIN sessions s ON p.place_id = s.place_id LEFT JOIN observations o ON s.session_id = o.session_id GROUP BY 1""",
    "rank_table": f"SELECT *, {RANKS}, {PERCENTILES} FROM ({RANK_BASE})",
    "global_baseline": f"""SELECT * FROM (SELECT {mean('speed')} AS global_avg_speed, {mean('risky_ratio')} AS global_avg_risky_ratio, {mean('red_ratio')} AS global_avg_red_ratio, quantile_cont(speed, 0.5) AS global_median_speed, quantile_cont(speed, 0.25) AS global_q1_speed, quantile_cont(speed, 0.75) AS global_q3_speed, count(*) AS total_sessions,
  {count_if("status = 'ok'")} AS localized, {mean('n_people')} AS global_avg_people, {mean('n_vehicles')} AS global_avg_vehicles, {mean('measured_speed')} AS global_avg_measured, count(measured_speed) AS measured_sessions FROM sessions),
  (SELECT {mean('age')} AS global_avg_age, quantile_cont(age, 0.5) AS global_median_age, count(*) AS total_observations, {ratio(count_if('risky'), 'count(*)')} AS global_risky_rate, {ratio(count_if('red_light'), 'count(*)')} AS global_red_rate, {ratio(count_if('phone'), 'count(*)')} AS global_phone_rate FROM observations), (SELECT count(*) AS total_places FROM places)""",
    "insight_base": f"@insight_base AS ({INSIGHT_BASE}) {INSIGHT_RANKED}",
    "insight_rules": f"@{INSIGHTS} SELECT r.place_id, position, rule, category, relevance_score, {CONFIDENCE} AS data_confidence, text, city_value, comparison_value FROM rules r JOIN insight_base b ON r.place_id = b.place_id WHERE position <= 10",
    "top_insights": f"@{INSIGHTS} SELECT place_id, city, rule, relevance_score FROM (SELECT r.*, b.city, row_number() OVER (PARTITION BY r.place_id ORDER BY relevance_score DESC, r.place_id || '_' || rule) AS k FROM rules r JOIN insight_base b ON r.place_id = b.place_id WHERE position <= 10 AND category <> 'meta') WHERE k = 1 ORDER BY relevance_score DESC, city LIMIT 50",
    "weighted_measures": vid(names=["avg_measured", "measured_sample", "conflicts_per_100", "conflict_exposure", "dense_group_share"], key="weather"),
    "plausible_median": f"SELECT place_id, quantile_cont(CASE WHEN walking BETWEEN 30 AND 300 THEN walking END, 0.5) AS median_walking, {count_if('walking NOT BETWEEN 30 AND 300')} AS implausible, quantile_cont(CASE WHEN delay >= 0 THEN delay END, 0.5) AS median_delay FROM ({BY_PLACE}) GROUP BY 1",
    "filter_options": " UNION ALL ".join([f"SELECT '{k}' AS filter_type, {v} AS filter_value, count(*) AS n FROM {t} WHERE {v} IS NOT NULL GROUP BY 2" for k, v, t in (("continent", "continent", "places"), ("country", "country", "places"), ("weather", "weather", "sessions"), ("gender", "gender", "observations"), ("age_range", BUCKET, "observations"))]
        + [f"SELECT '{k}', '{n}', {count_if(v)} FROM observations" for k, n, v in [("vehicle", f, f) for f in FLAGS] + [("behavior", f, f) for f in ("risky", "red_light", "crosswalk", "phone")] + [("time_of_day", "daytime", "daytime"), ("time_of_day", "nighttime", "NOT daytime")]]),
    "top_by_metric": f"@t AS (SELECT *, {RANKS} FROM ({RANK_BASE})) " + " UNION ALL ".join(f"SELECT '{n}_rank' AS metric, {n}_rank AS rank, place_id, {x} AS value FROM t WHERE {n}_rank <= 10" for n, x in RATIO_RANKS.items()),
    "place_card": f"SELECT s.place_id, s.city, s.total_sessions, s.n_observations, s.risk_intensity, {', '.join(f'{n}_rank' for n in RATIO_RANKS)} FROM ({summary()}) s LEFT JOIN (SELECT place_id, {RANKS} FROM ({RANK_BASE})) r ON s.place_id = r.place_id",
    "summary_asof": f"@{ASOF} SELECT city, country, total_sessions, n_observations, avg_speed, risky_rate, DATE '{AS_OF}' AS data_as_of_date FROM ({summary('asof_s')})",
    "compare_asof": f"""@{ASOF}, a AS ({summary()}), b AS ({summary('asof_s')}) SELECT coalesce(a.city, b.city) AS city, coalesce(a.country, b.country) AS country, """
        + ", ".join(f"a.{x} AS current_{x}, b.{x} AS past_{x}, a.{x} - {f'coalesce(b.{x}, 0)' if x in ('total_sessions', 'n_observations') else f'b.{x}'} AS change_{x}" for x in ("total_sessions", "n_observations", "avg_speed", "risky_rate"))
        + f", DATE '{TODAY}' - DATE '{AS_OF}' AS period_days FROM a FULL JOIN b ON a.city = b.city AND a.country = b.country",
    "batch_stats": "SELECT batch, count(DISTINCT s.session_id) AS sessions, count(DISTINCT place_id) AS places, coalesce(sum(n), 0)::BIGINT AS observations FROM sessions s LEFT JOIN (SELECT session_id, count(*) AS n FROM observations GROUP BY 1) o ON s.session_id = o.session_id GROUP BY 1",
    "place_list": "SELECT place_id, city, country, continent, population FROM places WHERE city ILIKE '%00000001%' AND country ILIKE '%nation_1%' AND continent IN ('ASIA', 'EUROPE', 'AMERICA')",
    "newest_sessions": "SELECT s.place_id, position, session_id, collected, coalesce(s.latitude, p.latitude) AS latitude, coalesce(s.longitude, p.longitude) AS longitude FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY collected DESC NULLS LAST, session_id DESC) AS position FROM sessions) s JOIN places p ON s.place_id = p.place_id WHERE position <= 5",
    "monthly_series": f"""@v AS (SELECT place_id, CAST(date_trunc('month', collected) AS date) AS month, {mean('risky_ratio')} AS value FROM sessions WHERE risky_ratio IS NOT NULL GROUP BY 1, 2),
  m AS (SELECT place_id, CAST(month AS date) AS month FROM (SELECT DISTINCT place_id FROM v), (SELECT unnest(generate_series(DATE '1992-01-01', DATE '1998-12-01', INTERVAL 1 MONTH)) AS month))
  SELECT *, strftime(month, '%b %Y') AS label FROM (SELECT m.place_id, m.month, last_value(value IGNORE NULLS) OVER (PARTITION BY m.place_id ORDER BY m.month ROWS UNBOUNDED PRECEDING) AS value FROM m LEFT JOIN v ON m.place_id = v.place_id AND m.month = v.month) WHERE value IS NOT NULL""",
    "monthly_events": "SELECT event_type, CAST(ts AS date) AS day, count(*) AS n, sum(CAST(round(value * 100) AS bigint))::BIGINT AS cents, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS bigint) >= 50) AS high, max(CAST(json_extract_string(props, '$.k') AS bigint)) AS max_k FROM events GROUP BY 1, 2",
    "map_filtered": f"""SELECT place_id, city, total_sessions, n_observations, risky_rate, avg_speed FROM ({summary()}) WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND n_observations > 0 AND population BETWEEN 0 AND 800000 AND risky_rate > 0 AND place_id IN (
  SELECT place_id FROM ({BY_PLACE}) o JOIN (SELECT session_id FROM sessions WHERE lower(weather) IN ('1-urgent', '5-low', '3-medium')) w ON o.session_id = w.session_id WHERE (car OR bus) AND crosswalk AND (gender = 'female' OR gender IS NULL OR gender = '') GROUP BY 1 HAVING {count_if('car')} BETWEEN 1 AND 40 AND {count_if('truck')} <= 12)""",
    "leaderboard_gated": f"SELECT row_number() OVER (ORDER BY avg_measured DESC, place_id) AS position, place_id, avg_measured * 1 AS value, (avg_measured - g) / nullif(g, 0) * 100 AS delta_percent FROM (SELECT * FROM ({MEASURED}) WHERE avg_measured IS NOT NULL AND measured_sample >= 30 ORDER BY avg_measured DESC, place_id LIMIT 100), (SELECT {mean('measured_speed')} AS g FROM sessions)",
    "extremes": " UNION ALL ".join(f"SELECT '{x}' AS metric, (SELECT city FROM ({RANK_BASE}) WHERE {x} > 0 ORDER BY {x} DESC, city LIMIT 1) AS top_name, max({x}) AS top_value, (SELECT city FROM ({RANK_BASE}) WHERE {x} > 0 ORDER BY {x}, city LIMIT 1) AS bottom_name, min({x}) AS bottom_value FROM ({RANK_BASE}) WHERE {x} > 0" for x in RATIO_RANKS.values()),
    "mix_weather": mix("SELECT * FROM sessions WHERE lower(weather) NOT IN ('sunrise', 'sunset', 'dawn', 'dusk')", "weather"),
    "mix_daynight": mix(BY_PLACE, "CASE WHEN daytime THEN 'Day' ELSE 'Night' END"),
    "mix_gender": mix(BY_PLACE, "gender"),
    "mix_sessions_by_gender": mix(BY_PLACE, "gender", "count(DISTINCT session_id)"),
    "risk_by_bucket": f"SELECT place_id, bucket, count(*) AS n, CAST(100 * {count_if('risky')} AS double) / count(*) AS risky_percent, min(age) AS bucket_order FROM (SELECT *, {DETAIL} AS bucket FROM ({BY_PLACE})) WHERE bucket IS NOT NULL GROUP BY 1, 2",
    "flag_mix": f"@c AS (SELECT place_id, {FLAG_SUMS} FROM ({BY_PLACE}) GROUP BY 1), l AS (" + " UNION ALL ".join(f"SELECT place_id, '{f}' AS category, {f} AS n FROM c" for f in FLAGS) + ") SELECT * FROM (SELECT *, CAST(100 * n AS double) / sum(n) OVER (PARTITION BY place_id) AS percent, row_number() OVER (PARTITION BY place_id ORDER BY n DESC, category) AS position FROM l WHERE n > 0) WHERE position <= 10",
    "risk_factors": f"SELECT place_id, 'Weather: ' || weather AS weather, mean_value, n, position FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY mean_value DESC NULLS FIRST, weather) AS position FROM (SELECT place_id, weather, {mean('risky_ratio')} AS mean_value, count(*) AS n FROM sessions WHERE weather <> '' GROUP BY 1, 2) WHERE n >= 2) WHERE position <= 3",
    "rank_by_counting": f"@b AS ({RANK_BASE}) SELECT place_id, (SELECT count(*) + 1 FROM b o WHERE o.avg_speed > b.avg_speed) AS avg_speed_rank, (SELECT count(*) + 1 FROM b o WHERE o.avg_risky_ratio > b.avg_risky_ratio) AS avg_risky_ratio_rank FROM b",
    "measured_groups": f"SELECT place_id, n_measured, CASE WHEN n_measured > 0 THEN m END AS mean, CASE WHEN n_measured > 0 THEN w END AS weighted, CASE WHEN n_measured > 0 THEN c END AS dense_conflicts FROM (SELECT place_id, count(measured_speed) AS n_measured, {mean('measured_speed')} AS m, {SESSION_SPEC['avg_measured']} AS w, CAST(sum(severe_conflicts) FILTER ({DENSE}) AS double) / nullif(count(severe_conflicts) FILTER ({DENSE}), 0) AS c FROM sessions GROUP BY 1)",
    "avg_with_fallback": f"""SELECT place_id, coalesce(CASE WHEN b4 > 3 THEN f END, CASE WHEN b2 > 3 THEN s END, CAST(b1 * 15.0::double + b2 * 24.0::double + b3 * 40.5::double + b4 * 58.0::double AS double) / nullif(b1 + b2 + b3 + b4, 0)) AS avg_age FROM (SELECT p.place_id, CAST(sum(age) FILTER (age > 45) AS double) / nullif(count(*) FILTER (age > 45), 0) AS f, CAST(sum(age) FILTER (age > 20) AS double) / nullif(count(*) FILTER (age > 20), 0) AS s,
  count(*) FILTER (age < 18) AS b1, count(*) FILTER (age BETWEEN 18 AND 30) AS b2, count(*) FILTER (age BETWEEN 31 AND 50) AS b3, count(*) FILTER (age > 50) AS b4 FROM places p LEFT JOIN ({BY_PLACE}) o ON p.place_id = o.place_id GROUP BY 1)""",
    "facts_melt": f"@{FACTS} SELECT * FROM facts",
    "facts_ranked": f"@{FACTS} SELECT *, rank() OVER (PARTITION BY metric_name ORDER BY value_numeric DESC NULLS LAST) AS rank_by_numeric, rank() OVER (PARTITION BY metric_name ORDER BY value_percentage DESC NULLS LAST) AS rank_by_percentage, percent_rank() OVER (PARTITION BY metric_name ORDER BY value_numeric NULLS LAST) AS percentile_numeric, percent_rank() OVER (PARTITION BY metric_name ORDER BY value_percentage NULLS LAST) AS percentile_percentage FROM facts",
    "facts_by_continent": f"@{FACTS}, {PER_PLACE} SELECT continent, metric_name, dimension_value, (n * joined)::BIGINT AS fact_count, place_count, session_count, observation_count FROM (SELECT metric_name, dimension_value, count(*) AS n FROM facts WHERE data_source = 'gender_stats' GROUP BY 1, 2), (SELECT continent, count(*) AS place_count, sum(sessions)::BIGINT AS session_count, sum(observations)::BIGINT AS observation_count, sum(joined) AS joined FROM per_place WHERE continent IS NOT NULL GROUP BY 1)",
    "facts_by_place": f"@{FACTS}, {PER_PLACE} SELECT place_id, city, continent, sessions, observations, metric_name, dimension_value, value_numeric FROM per_place, (SELECT metric_name, dimension_value, value_numeric FROM facts WHERE data_source = 'gender_stats')",
    "effects_balanced": f"""@g AS ({GENDER_STATS}), a AS ({AGE_STATS}), w AS ({WEATHER_STATS}),
  e AS (SELECT 'Environmental' AS category, upper(weather[1]) || weather[2:] || ' + ' || CASE daytime WHEN '1' THEN 'Day' ELSE 'Night' END AS label, risky_crossing_prob AS rate, 0.01 AS low, 1.0 AS scale, 0.2 AS least FROM w
    UNION ALL SELECT 'Demographics', gender, risky_crossing, 0.0001, 100, 0.02 FROM g WHERE gender <> ''
    UNION ALL SELECT 'Age', label, avg(risky_crossing), 0.0001, 100, 0.02 FROM (SELECT CASE WHEN CAST(age AS int) BETWEEN 18 AND 30 THEN '18-30' WHEN CAST(age AS int) BETWEEN 31 AND 50 THEN '31-50' WHEN CAST(age AS int) >= 51 THEN '51+' END AS label, risky_crossing FROM a) WHERE label IS NOT NULL GROUP BY label),
  f AS (SELECT *, rate * scale AS shown, rate * scale - coalesce(avg(CASE WHEN rate > low THEN rate END) OVER (PARTITION BY category), 0) * scale AS effect FROM e WHERE rate IS NOT NULL),
  k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY round(abs(effect), 9) DESC, label) AS r FROM f WHERE abs(effect) > least)
  SELECT row_number() OVER (ORDER BY round(abs(effect), 9) DESC, category, label) AS position, category, label, round(shown, 6) AS rate, round(effect, 6) AS effect, CASE WHEN effect > 0 THEN 'up' ELSE 'down' END AS direction FROM k WHERE r <= 3 ORDER BY round(abs(effect), 9) DESC, category, label LIMIT 10""",
    "merge_sessions": f"@{INCOMING} SELECT coalesce(o.session_id, n.session_id) AS session_id, coalesce(o.link, n.link) AS link, coalesce(n.collected, o.collected) AS collected, CASE WHEN n.link IS NOT NULL THEN n.speed ELSE o.speed END AS speed, CASE WHEN n.link IS NOT NULL THEN n.weather ELSE o.weather END AS weather, CASE WHEN n.link IS NOT NULL THEN n.risky_ratio ELSE o.risky_ratio END AS risky_ratio FROM old o FULL JOIN new n ON o.link = n.link",
    "merge_partial": """@o AS (SELECT * FROM (SELECT session_id, track, risky, age, walking, delay, row_number() OVER (PARTITION BY session_id, track ORDER BY walking NULLS FIRST, delay NULLS FIRST, risky NULLS FIRST, age NULLS FIRST) AS r FROM observations) WHERE r = 1),
  n AS (SELECT * FROM (SELECT session_id, track, risky, age + 1 AS age, walking + 1000 AS walking, delay, row_number() OVER (PARTITION BY session_id, track ORDER BY walking DESC NULLS LAST, delay DESC NULLS LAST, risky DESC NULLS LAST, age DESC NULLS LAST) AS r FROM observations WHERE session_id % 2 = 0) WHERE r = 1)
  SELECT o.session_id, o.track, coalesce(n.risky, o.risky) AS risky, o.age, coalesce(n.walking, o.walking) AS walking, o.delay FROM o LEFT JOIN n ON o.session_id = n.session_id AND o.track = n.track""",
    "append_dedup": "SELECT session_id, track, gender FROM observations n WHERE NOT EXISTS (SELECT 1 FROM observations t WHERE t.session_id % 4 = 0 AND t.session_id = n.session_id AND t.track = n.track AND coalesce(t.gender, '') = coalesce(n.gender, ''))",
    "history_rows": f"@{INCOMING} SELECT link, n.speed, n.risky_ratio, o.speed AS old_speed, o.weather AS old_weather FROM old o JOIN new n USING (link)",
    "lookup_fallback": "@t AS (SELECT link, n_people AS duration, speed AS seconds, session_id AS o FROM sessions WHERE session_id % 10 = 0), b AS (SELECT duration, arg_max(seconds, o) AS seconds FROM t GROUP BY 1) SELECT s.session_id, s.link, s.n_people AS duration, coalesce(t.seconds, b.seconds) AS seconds FROM sessions s LEFT JOIN t ON s.link = t.link LEFT JOIN b ON s.n_people = b.duration",
    "rejects": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)",
    "lines_without_part": "SELECT l_partkey, count(*) AS n_lines, count(DISTINCT l_orderkey) AS n_orders FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY 1",
    "localization_apply": """@n AS (SELECT CASE WHEN session_id % 100 = 0 THEN '' ELSE link END AS link, CASE WHEN session_id % 8 = 0 THEN 'ok' ELSE 'failed' END AS status, CAST(n_vehicles * 6 AS double) AS latitude, CAST(n_people AS double) AS longitude FROM sessions WHERE session_id % 4 = 0),
  u AS (SELECT * FROM n WHERE link <> '' AND (status <> 'ok' OR (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)))
  SELECT s.link, coalesce(u.status, s.status) AS status, CASE WHEN u.status = 'ok' THEN u.latitude ELSE CAST(s.n_people AS double) END AS latitude, CASE WHEN u.status = 'ok' THEN u.longitude END AS longitude, CASE WHEN u.status = 'ok' THEN 'found' ELSE s.street_name END AS street_name FROM sessions s LEFT JOIN u ON s.link = u.link""",
    "resolve_names": f"""@i AS (SELECT s_suppkey AS input_id, CASE WHEN s_suppkey % 10 = 7 THEN 'brand #' || (s_suppkey % 5 + 1) || (s_suppkey // 5 % 5 + 1) ELSE CASE s_suppkey % 5 WHEN 0 THEN lower(n_name) || '!' WHEN 1 THEN replace(n_name, 'NATION', 'NATIO') WHEN 2 THEN 'Land ' || s_nationkey ELSE n_name END END AS name, CASE s_suppkey % 3 WHEN 0 THEN 'N' || n_nationkey WHEN 1 THEN 'N99' END AS iso3 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  {KNOWN}, {WORLD}, p AS (SELECT {NORM.format('name')} AS k, name, iso3 FROM known), al AS (SELECT 'land' || n_nationkey AS k, {NORM.format('n_name')} AS t FROM nation),
  j AS (SELECT i.*, CASE WHEN p.k IS NULL AND w.k IS NULL THEN coalesce(al.t, {NORM.format('i.name')}) ELSE {NORM.format('i.name')} END AS k FROM i LEFT JOIN p ON {NORM.format('i.name')} = p.k LEFT JOIN world w ON {NORM.format('i.name')} = w.k LEFT JOIN al ON {NORM.format('i.name')} = al.k),
  near AS (SELECT input_id, min(p.k) AS k FROM (SELECT j.input_id, p.k, levenshtein(j.k, p.k) AS d, min(levenshtein(j.k, p.k)) OVER (PARTITION BY j.input_id) AS best FROM j, p WHERE length(j.k) >= 7 AND j.k NOT IN (SELECT k FROM p) AND j.k NOT IN (SELECT k FROM world)) p WHERE d <= 1 AND d = best GROUP BY 1 HAVING count(*) = 1)
  SELECT j.input_id, j.name, coalesce(p.name, w.name, q.name) AS found, CASE WHEN p.k IS NOT NULL THEN 'project' WHEN w.k IS NOT NULL THEN 'world' WHEN q.k IS NOT NULL THEN 'fuzzy' END AS layer, CASE WHEN p.k IS NOT NULL THEN j.iso3 IS NULL OR lower(j.iso3) = lower(p.iso3) WHEN w.k IS NOT NULL THEN j.iso3 IS NULL OR lower(j.iso3) = lower(w.iso3) ELSE false END AS confident FROM j LEFT JOIN p ON j.k = p.k LEFT JOIN world w ON j.k = w.k LEFT JOIN near ON j.input_id = near.input_id LEFT JOIN p q ON near.k = q.k""",
    "disambiguate": f"""@i AS (SELECT s_suppkey AS input_id, CASE WHEN s_suppkey % 2 = 0 THEN 'building' ELSE 'automobile' END AS k, CASE WHEN s_suppkey % 4 < 3 THEN 'N' || s_nationkey END AS hint FROM supplier),
  c AS (SELECT {NORM.format('state')} AS k, country, iso3, place_id, population FROM places),
  j AS (SELECT i.input_id, i.hint, c.*, coalesce(lower(i.hint) = lower(c.iso3), false) AS hit, count(*) OVER (PARTITION BY i.input_id) AS n FROM i JOIN c ON i.k = c.k)
  SELECT input_id, best, iso3, CASE WHEN hint IS NULL THEN n = 1 ELSE hit END AS confident FROM (SELECT input_id, place_id AS best, iso3, hint, hit, n, row_number() OVER (PARTITION BY input_id ORDER BY hit DESC, place_id DESC, population DESC, country, iso3) AS r FROM j) WHERE r = 1""",
    "fuzzy_unique": f"""@p AS (SELECT DISTINCT {NORM.format('n_name')} AS k FROM nation), i AS (SELECT n_nationkey AS input_id, CASE WHEN n_nationkey % 2 = 0 THEN 'x' || {NORM.format('n_name')} ELSE substring(lower(replace(n_name, '_', '')), 2, 100) END AS name_key FROM nation),
  d AS (SELECT input_id, name_key, p.k, levenshtein(name_key, p.k) AS distance, min(levenshtein(name_key, p.k)) OVER (PARTITION BY input_id) AS best FROM i, p WHERE length(name_key) >= 7) SELECT input_id, name_key, min(k) AS match FROM d WHERE distance <= 1 AND distance = best GROUP BY 1, 2 HAVING count(*) = 1""",
    "enrich": f"""@{KNOWN}, {WORLD}, r AS (SELECT place_id AS input_id, CASE place_id % 5 WHEN 0 THEN 'Land ' || substring(iso3, 2, 9) WHEN 1 THEN 'Brand-' || (place_id % 4 + 1) || (place_id // 7 % 5 + 1) ELSE country END AS name, CASE place_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN '' ELSE 'X' END AS country, CASE WHEN place_id % 2 = 0 THEN iso3 END AS iso3, CASE WHEN place_id % 4 = 0 THEN 'kept' END AS continent FROM places),
  al AS (SELECT 'land' || n_nationkey AS k, n_name AS t FROM nation), hit AS (SELECT r.input_id, k.name, k.continent AS country, k.iso3, k.continent FROM r LEFT JOIN al ON {NORM.format('r.name')} = al.k JOIN known k ON coalesce(al.t, r.name) = k.name
    UNION ALL SELECT r.input_id, w.name, w.country, w.iso3, 'WORLD' FROM r JOIN world w ON {NORM.format('r.name')} = w.k WHERE r.iso3 IS NULL)
  SELECT r.input_id, coalesce(h.name, r.name) AS name, coalesce(h.country, nullif(r.country, ''), 'Unknown') AS country, coalesce(r.iso3, h.iso3) AS iso3, coalesce(r.continent, h.continent) AS continent FROM r LEFT JOIN hit h ON r.input_id = h.input_id""",
    "candidate_score": """@c AS (SELECT p_partkey AS place_id, p_name AS name, unnest([upper(p_name), string_split(p_name, ' ')[1], p_brand]) AS candidate, unnest(['ADM', CASE p_partkey % 3 WHEN 0 THEN 'PPLC' WHEN 1 THEN 'ADM' ELSE 'PPLX' END, 'PPLA']) AS code FROM part),
  s AS (SELECT *, CASE WHEN lower(name) = lower(candidate) THEN 100.0::double WHEN contains(lower(name), lower(candidate)) OR contains(lower(candidate), lower(name)) THEN 50.0::double ELSE 30.0::double * ((greatest(length(name), length(candidate)) - levenshtein(lower(name), lower(candidate)))::double / greatest(length(name), length(candidate))) END
    + CASE WHEN code = 'PPLC' THEN 20 WHEN code = 'PPLA' THEN 15 WHEN code LIKE 'PPL%' THEN 10 ELSE 0 END AS score FROM c)
  SELECT place_id, candidate, code, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY code LIKE 'PPL%' DESC, score DESC, candidate) AS r FROM s) WHERE r = 1 AND score > 30""",
    "missing_report": f"@{MISSING} SELECT 'field' AS kind, what, count(*) AS n FROM (SELECT unnest(missing) AS what FROM miss) GROUP BY 2 UNION ALL SELECT 'pattern', array_to_string(list_sort(missing), ','), count(*) FROM miss WHERE len(missing) > 0 GROUP BY 2",
    "work_list": f"@{MISSING} SELECT place_id, array_to_string(missing, ',') AS missing FROM miss WHERE len(list_filter(missing, lambda z: z NOT IN ('measured_sample', 'conflict_exposure'))) > 0",
    "merge_duplicates": """@p AS (SELECT place_id, 'C' || (place_id // 2) AS city, CASE WHEN place_id % 8 = 1 THEN 'Unknown' WHEN place_id % 4 = 3 THEN 'I' || (place_id // 2) ELSE country END AS country, 'I' || (place_id // 2) AS iso3 FROM places UNION ALL SELECT -place_id, 'C' || (place_id // 2), 'Unknown', 'I' || (place_id // 2) FROM places WHERE place_id % 3 = 0),
  mv AS (SELECT d.place_id AS f, min(k.place_id) AS t FROM p d JOIN p k ON d.city = k.city AND d.country = k.iso3 AND d.country <> k.country GROUP BY 1),
  m AS (SELECT session_id, coalesce(t, place_id) AS place_id FROM sessions LEFT JOIN mv ON place_id = f), kept AS (SELECT * FROM p WHERE place_id NOT IN (SELECT f FROM mv)),
  fin AS (SELECT * FROM kept WHERE NOT (country = 'Unknown' AND city IN (SELECT city FROM p GROUP BY 1 HAVING count(*) > 1) AND place_id NOT IN (SELECT place_id FROM m)))
  SELECT fin.place_id, city, country, coalesce(n, 0) AS n_sessions FROM fin LEFT JOIN (SELECT place_id, count(*) AS n FROM m GROUP BY 1) q ON fin.place_id = q.place_id""",
    "homonym_dedup": "@p AS (SELECT place_id, 'São ' || state AS city, country, CASE WHEN place_id % 2 = 0 THEN iso3 ELSE '' END AS iso3, population % 1000 AS videos FROM places) SELECT place_id, city, country, iso3, videos FROM (SELECT *, row_number() OVER (PARTITION BY city, coalesce(nullif(iso3, ''), country) ORDER BY videos DESC NULLS LAST, place_id) AS r FROM p) WHERE r = 1",
    "repair_names": f"""@g AS (SELECT DISTINCT p_name AS repaired, p_brand AS b, {NORM.format('p_name')} AS k FROM part), a AS (SELECT p_partkey AS place_id, p_brand AS b, {NORM.format("p_name || CASE WHEN p_partkey % 2 = 0 THEN '?' ELSE '®s' END")} AS k FROM part),
  s AS (SELECT place_id, repaired, CASE WHEN a.k = g.k THEN 200.0::double WHEN contains(a.k, g.k) OR contains(g.k, a.k) THEN 100.0::double * least(length(a.k), length(g.k)) / greatest(length(a.k), length(g.k)) ELSE 0 END AS score FROM a JOIN g ON a.b = g.b)
  SELECT place_id, repaired, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY score DESC, repaired) AS r FROM s WHERE score > 50) WHERE r = 1""",
    "rank_scale": f"SELECT n_ranked, CASE WHEN n_ranked >= 5 THEN low END AS low, CASE WHEN n_ranked >= 5 THEN high END AS high FROM (SELECT count(*) AS n_ranked, min(avg_measured) AS low, max(avg_measured) AS high FROM ({MEASURED}) WHERE avg_measured IS NOT NULL AND measured_sample >= 30)",
    "layer_rows": f"""@b AS ({MEASURED}), k AS (SELECT count(*) >= 5 AS ok, min(avg_measured) AS low, max(avg_measured) AS high FROM b WHERE avg_measured IS NOT NULL AND measured_sample >= 30)
  SELECT place_id, avg_measured AS value, coalesce(measured_sample >= 30, false) AND ok AS is_ranked, CASE WHEN measured_sample >= 30 AND ok THEN CASE WHEN high = low THEN 0.5 ELSE greatest(0.0::double, least(1.0::double, (avg_measured - low) / (high - low))) END END AS t, CASE WHEN measured_sample IS NULL THEN 'unknown' WHEN measured_sample < 30 THEN 'below_bar' WHEN ok THEN 'ranked' ELSE 'no_scale' END AS evidence, measured_sample AS sample FROM b, k WHERE avg_measured IS NOT NULL""",
    "coverage": "SELECT continent, count(*) AS total, count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL) AS covered, CAST(100 * count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL) AS double) / count(*) AS percent FROM places GROUP BY 1",
    "flag_coverage": f"SELECT count(*) AS total, {', '.join(f'{count_if(f)} AS with_{f}' for f in FLAGS)}, {count_if(' AND '.join(f'{f} IS NULL' for f in FLAGS))} AS all_null FROM observations",
    "top_vehicle_places": "SELECT place_id, sum(n_vehicles)::BIGINT AS n_vehicles FROM sessions GROUP BY 1 ORDER BY n_vehicles DESC NULLS LAST, place_id LIMIT 10",
    "safe_casts": r"""@e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id || '.5abc' WHEN 1 THEN 'Age(' || (event_id % 40) || ')-(' || (event_id % 40 + 9) || ')' WHEN 2 THEN '' WHEN 3 THEN 'True' ELSE '-' || (event_id % 100) END AS raw FROM events),
  f AS (SELECT *, TRY_CAST(nullif(regexp_extract(raw, '^\s*([-+]?(?:\d+\.?\d*|\.\d+))', 1), '') AS double) AS numeric, TRY_CAST(nullif(regexp_extract(raw, '^\s*([-+]?\d+)', 1), '') AS int) AS int_value FROM e)
  SELECT event_id, numeric, TRY_CAST(nullif(raw, '') AS double) AS strict, int_value, CASE WHEN event_id % 5 = 1 THEN CAST(floor((event_id % 40 + event_id % 40 + 9) / 2.0 + 0.5) AS int) WHEN int_value > 0 THEN int_value END AS age,
    CASE WHEN raw = '' THEN NULL ELSE raw IN ('1', 'true', 'yes') END AS strict_case, CASE WHEN lower(raw) IN ('1', 'true', 'yes') THEN true WHEN lower(raw) IN ('0', 'false', 'no') THEN false END AS tri, nullif(trim(raw), '') AS cleaned, CASE WHEN numeric BETWEEN -90 AND 90 THEN numeric END AS coord FROM f""",
    "delta_vs_global": f"SELECT place_id, (avg_speed - g) / nullif(g, 0) * 100 AS delta, coalesce(avg_speed > g, false) AS above FROM ({RANK_BASE}), (SELECT {mean('speed')} AS g FROM sessions)",
    "known_places": f"SELECT DISTINCT city FROM ({summary()}) WHERE total_sessions > 0 AND n_observations > 0",
    "metric_insights": f"@ms AS ({summary()}) " + " UNION ALL ".join(f"""SELECT '{x}' AS metric, *, '{label} is highest in ' || top_name || ' and lowest in ' || bottom_name AS sentence FROM (SELECT (SELECT city FROM ms WHERE {x} > 0 ORDER BY {x} DESC, city LIMIT 1) AS top_name, (SELECT max({x}) FROM ms) AS top_value,
  (SELECT city FROM ms WHERE {x} > 0 ORDER BY {x}, city LIMIT 1) AS bottom_name, (SELECT min({x}) FROM ms WHERE {x} > 0) AS bottom_value, '{label}' AS label, (SELECT {ratio(count_if('phone'), 'count(track)') + ' FROM observations' if x == 'phone_rate' else mean(x[4:]) + ' FROM sessions'}) AS global_mean)""" for x, label in INSIGHT_METRICS.items()),
    "metric_series": "@" + ", ".join(f"""w{i} AS ({rows}), a{i} AS (SELECT place_id, CAST(sum(x) AS double) / nullif(sum(y), 0) AS value FROM w{i} GROUP BY 1), v{i} AS (SELECT place_id, month, CAST(sum(x) AS double) / nullif(sum(y), 0) AS value FROM w{i} WHERE month BETWEEN DATE '1998-02-01' AND DATE '1998-07-01' GROUP BY 1, 2),
  s{i} AS (SELECT * FROM (SELECT p.place_id, g.month, last_value(value IGNORE NULLS) OVER (PARTITION BY p.place_id ORDER BY g.month ROWS UNBOUNDED PRECEDING) AS value FROM (SELECT DISTINCT place_id FROM v{i}) p CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '1998-02-01', DATE '1998-07-01', INTERVAL 1 MONTH)) AS date) AS month) g LEFT JOIN v{i} v ON v.place_id = p.place_id AND v.month = g.month) WHERE value IS NOT NULL)""" for i, rows in enumerate(SERIES.values())) + " SELECT *, strftime(month, '%b %Y') AS label FROM (" + " UNION ALL ".join(f"SELECT '{metric}' AS metric, place_id, month, value FROM s{i} UNION ALL SELECT '{metric}', place_id, DATE '1998-07-01', value FROM a{i} WHERE place_id NOT IN (SELECT place_id FROM v{i})" for i, metric in enumerate(SERIES)) + ")",
    "leaderboards": f"@lb AS (SELECT s.*, {', '.join(f'r.{n}_rank' for n in RATIO_RANKS)} FROM ({summary()}) s JOIN (SELECT place_id, {RANKS} FROM ({RANK_BASE})) r ON s.place_id = r.place_id), gs AS (SELECT {mean('speed')} AS global_avg_speed, {mean('risky_ratio')} AS global_avg_risky_ratio, {mean('red_ratio')} AS global_avg_red_ratio, {mean('measured_speed')} AS global_avg_measured FROM sessions), go AS (SELECT {mean('age')} AS global_avg_age, {ratio(count_if('phone'), 'count(*)')} AS global_phone_rate FROM observations) "
        + " UNION ALL ".join(f"SELECT '{name}' AS metric, row_number() OVER (ORDER BY v {up}, place_id) AS position, place_id, CAST(v * {100 if b.unit == '%' else 1} AS double) AS value, {f'(v - {b.baseline}) / nullif({b.baseline}, 0) * 100' if b.baseline else 'NULL::double'} AS delta_percent, {b.rank or 'NULL'} AS stored_rank FROM (SELECT {b.column} AS v, * FROM lb WHERE {b.column} IS NOT NULL{f' AND {b.column} > 0.0001' if b.unit == '%' else ''}{f' AND {b.sample} >= {b.least}' if b.sample else ''} ORDER BY v {up}, place_id LIMIT 100), gs, go"
            for name, b in BOARDS.items() for up in ["DESC" if b.higher_is_better else "ASC"]),
    "global_insights": f"SELECT * FROM (SELECT {mean('speed')} AS crossing_speed, {mean('measured_speed')} AS walking_speed, count(*) AS sessions FROM sessions), (SELECT {mean('age')} AS avg_age, count(*) AS people, {ratio(count_if('risky'), 'count(*)')} * 100 AS risky_rate, {ratio(count_if('red_light'), 'count(*)')} * 100 AS red_rate, {ratio(count_if('phone'), 'count(*)')} * 100 AS phone_rate FROM observations), (SELECT count(*) AS places FROM places)",
    "deltas_vs_global": f"@s AS ({summary()}), gs AS (SELECT {mean('speed')} AS avg_speed, {mean('measured_speed')} AS avg_measured FROM sessions), go AS (SELECT {mean('age')} AS avg_age, {ratio(count_if('risky'), 'count(*)')} AS risky_rate, {ratio(count_if('red_light'), 'count(*)')} AS red_rate, {ratio(count_if('phone'), 'count(*)')} AS phone_rate FROM observations) "
        + " UNION ALL ".join(f"SELECT place_id, '{x}' AS metric, s.{x} AS value, (CASE WHEN s.{x} > 0 AND s.{x} < 1 THEN s.{x} * 100 ELSE s.{x} END - CASE WHEN {t}.{x} > 0 AND {t}.{x} < 1 THEN {t}.{x} * 100 ELSE {t}.{x} END) / nullif(CASE WHEN {t}.{x} > 0 AND {t}.{x} < 1 THEN {t}.{x} * 100 ELSE {t}.{x} END, 0) * 100 AS delta, s.{x} > {t}.{x} AS above FROM s, {t} WHERE s.{x} IS NOT NULL" for x, t in (("avg_speed", "gs"), ("avg_measured", "gs"), ("risky_rate", "go"), ("red_rate", "go"), ("phone_rate", "go"), ("avg_age", "go"))),
    "relationships": f"@g AS ({GENDER_STATS}), a AS ({AGE_STATS}), w AS ({WEATHER_STATS}), e AS (" + " UNION ALL ".join(f"""SELECT '{x}' AS metric, 0 AS src, 'Environmental' AS category, upper(weather[1]) || weather[2:] || ' + ' || CASE daytime WHEN '1' THEN 'Day' ELSE 'Night' END AS label, {y} AS rate, 0.01 AS low, 1.0 AS scale FROM w
  UNION ALL SELECT '{x}', 1, 'Demographics', gender, {x}, 0.0001, 100 FROM g WHERE gender <> ''
  UNION ALL SELECT '{x}', 2, 'Age', label, avg({x}), 0.0001, 100 FROM (SELECT CASE WHEN CAST(age AS int) BETWEEN 18 AND 30 THEN '18-30' WHEN CAST(age AS int) BETWEEN 31 AND 50 THEN '31-50' WHEN CAST(age AS int) >= 51 THEN '51+' END AS label, {x} FROM a) WHERE label IS NOT NULL GROUP BY label"""
        + "".join(f" UNION ALL SELECT '{x}', {i}, '{k}', '{n}', CAST(100 * {count_if(f'{f} AND {z}')} AS double) / nullif({count_if(f)}, 0), 0.01, 1.0 FROM observations" for i, k, named in ((3, "Demographics", {f: n[:1].upper() + n[1:] for f, n in CLOTHES.items()}), (4, "Behavior", {f: "Phone Users" if n == "phone_using" else n[:1].upper() + n[1:] for f, n in ITEMS.items()}), (5, "Vehicles", {f: f[:1].upper() + f[1:] for f in FLAGS})) for f, n in named.items())
        for x, y, z in (("risky_crossing", "risky_crossing_prob", "risky"), ("run_red_light", "run_red_light_prob", "red_light")))
        + """), f AS (SELECT *, rate * scale AS shown, rate * scale - coalesce(avg(CASE WHEN rate > low THEN rate END) OVER (PARTITION BY metric, src), 0) * scale AS effect FROM e WHERE rate IS NOT NULL),
  k AS (SELECT *, row_number() OVER (PARTITION BY metric, category ORDER BY round(abs(effect), 9) DESC, label) AS r FROM f WHERE abs(effect) > 0.02)
  SELECT * FROM (SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY round(abs(effect), 9) DESC, category, label) AS position, category, label, round(shown, 6) AS rate, round(effect, 6) AS effect, CASE WHEN effect > 0 THEN 'up' ELSE 'down' END AS direction FROM k WHERE r <= 3) WHERE position <= 10""",
    "served_rows": f"SELECT place_id, {', '.join(f'floor({x} * {float(10 ** n)}::double + 0.5::double) / {float(10 ** n)}::double AS {x}' for x, n in SERVED.items())} FROM ({summary()})",
    "country_codes": """@h AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' c' || c_nationkey WHEN 1 THEN 'n' || c_nationkey WHEN 2 THEN 'Nation_' || c_nationkey WHEN 3 THEN 'nowhere' END AS hint FROM customer)
  SELECT c_custkey, hint, 'C' || n_nationkey AS iso2, 'N' || n_nationkey AS iso3, coalesce(r_name, 'Unknown') AS continent FROM h LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON lower(trim(hint)) IN ('c' || n_nationkey, 'n' || n_nationkey, lower(n_name))""",
    "fill_from_match": """SELECT place_id, CASE WHEN place_id % 3 <> 0 AND place_id % 5 = 0 THEN 'found' WHEN place_id % 2 = 0 THEN state END AS state, CASE WHEN place_id % 3 <> 0 AND place_id % 7 = 0 THEN 'land' ELSE country END AS country, CASE WHEN place_id % 3 <> 0 OR place_id % 4 = 0 THEN iso3 END AS iso3,
  CASE WHEN place_id % 3 <> 0 AND place_id % 2 = 1 THEN population + 1 ELSE population END AS population, CASE WHEN place_id % 3 <> 0 THEN lower(continent) ELSE continent END AS continent, CASE WHEN place_id % 3 <> 0 THEN CAST(population % 90 AS double) ELSE latitude END AS latitude, CASE WHEN place_id % 3 <> 0 THEN CAST(population % 180 AS double) ELSE longitude END AS longitude FROM places""",
    "stored_insights": f"@{INSIGHTS} SELECT p.place_id, p.city, count(rule) AS n, coalesce(string_agg(rule, ',' ORDER BY position), '') AS rules FROM places p LEFT JOIN (SELECT * FROM rules WHERE position <= 10) r ON p.place_id = r.place_id GROUP BY 1, 2",
    "load_summary": "SELECT (SELECT count(*) FROM places) AS n_places, (SELECT count(*) FROM sessions) AS n_sessions, (SELECT count(*) FROM observations) AS n_observations, (SELECT max(collected) FROM sessions) AS latest",
}



def whole(name: str, sql: str) -> str:
    """With the adapters before it - a text that begins with @ goes on with their list - and columns shown as in Spark."""
    sql = prelude() + (", " + sql[1:] if sql.startswith("@") else " " + sql)
    shown = [f"CAST({x} AS double) AS {x}" for x in NULLABLE.get(name, [])] + [f"CAST({x} AS varchar) AS {x}" for x in DATES.get(name, [])]
    return f"SELECT * REPLACE ({', '.join(shown)}) FROM ({sql})" if shown else sql


QUERIES["resolve_from_files"] = QUERIES["resolve_names"]
ORACLE = {name: whole(name, sql) for name, sql in QUERIES.items()}
