"""Registered queries whose rows go through files, snapshots or texts and come back, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import clean
from ..operators import api, facts
from ..sources import readers, writers
from ..sources.storage import new_path
from .adapters import FLAGS, Data
from .driver import CLOTHES, FACT_COLUMNS, all_facts, c, stats_by_age, stats_by_flag, stats_by_gender, stats_by_weather, summary

K = "session_id"


def csv_files(d: Data) -> DataFrame:
    """Sessions as two exports of unlike encodings and column orders, with quotes, commas, line breaks and accents in a text."""
    folder, k = new_path(d.spark, "csv"), c(K)
    note = F.concat(F.lit("é, \""), c("weather"), F.lit("\"\n"), c("street_name"))
    s = d.sessions.select(k, "link", note.alias("note"), c("collected").cast("string").alias("collected"), "batch")
    writers.write_csv(s.filter("batch <= 1997").drop("batch"), f"{folder}/old")
    new = s.filter("batch > 1997").select("note", "link", K)
    new.write.options(header="true", quote='"', escape='"', emptyValue="", encoding="ISO-8859-1").csv(f"{folder}/new")
    return readers.read_csv(d.spark, folder).drop("source_file")


def localization_file(d: Data) -> DataFrame:
    """What the localization reader makes of an export of all sessions, with bad coordinates, candidates and routes among them."""
    path, k = new_path(d.spark, "localizations"), c(K)
    point = lambda a, b: F.concat(F.lit("["), a.cast("string"), F.lit(","), b.cast("string"), F.lit("]"))
    candidate = F.concat(F.lit('[{"rank":'), (k % 5).cast("string"), F.lit(',"latitude":1.5,"street_names":["a","b"]}]'))
    route = F.concat(F.lit("["), point(k % 80, k % 170), F.lit(","), point(k % 100, k % 7), F.lit("]"))
    rows = d.sessions.select(
        "link", "status", F.lit("run").alias("source"), F.when(k % 7 == 0, "999").otherwise((k % 91).cast("string")).alias("lat"), (k % 181).cast("string").alias("lon"), c("confidence").alias("confidence_level"), c("spread_m").cast("string").alias("confidence_spread_m"),
        c("street_name").alias("street_names"), F.when(k % 2 == 0, candidate).otherwise("{}").alias("candidates"), F.when(k % 3 == 0, route).otherwise("[]").alias("route_latlon"), F.concat((k % 50).cast("string"), F.lit(" m")).alias("route_length_m"),
    )
    writers.write_csv(rows, path)
    got = readers.read_localizations(d.spark, path)
    rank = F.coalesce(F.element_at("candidates", 1)["rank"], F.lit(-1)).cast("long")
    return got.select("link", "status", "source", "latitude", "longitude", "confidence_level", "confidence_spread_m", "street_name", rank.alias("first_rank"), F.when(c("route").isNull(), -1).otherwise(F.size("route")).cast("long").alias("n_route"), "route_length_m")


def world_file(d: Data) -> DataFrame:
    """Places of the world from CSV: one row a name and country, the most peopled."""
    path = new_path(d.spark, "world")
    text = lambda x: c(x).cast("string").alias(x)
    writers.write_csv(d.places.select(c("state").alias("name"), "country", "iso3", "continent", text("population"), text("latitude"), text("longitude")), path)
    return readers.read_world_places(d.spark, path)


def replaced_source(d: Data) -> DataFrame:
    """Facts of three sources, one of them replaced: the others stay as they are."""
    path, every = new_path(d.spark, "facts"), all_facts(d)
    facts.replace_source(every, path)
    facts.replace_source(every.filter("data_source = 'gender_stats'").withColumn("value_numeric", c("value_numeric") * 2), path)
    return d.spark.read.parquet(path).select(*FACT_COLUMNS)


def refreshed_snapshots(d: Data) -> DataFrame:
    """A summary, and countries from the summary's snapshot."""
    countries = lambda s: s.table("place_snapshot").groupBy("country").agg(F.count("*").alias("places"), F.sum("total_sessions").alias("sessions"), F.sum("n_observations").alias("observations"))
    return writers.refresh_snapshots(d.spark, new_path(d.spark, "refresh"), {"place_snapshot": lambda s: summary(d), "country_snapshot": countries})["country_snapshot"]


def exported_gazetteer(d: Data) -> DataFrame:
    """Canonical places and how many aliases lead to each name."""
    k = c("place_id")
    p = d.places.select(k, F.concat(F.lit("São "), c("state")).alias("city"), F.when(k % 5 == 0, "Unknown").otherwise(c("country")).alias("country"), "continent", "iso3", "latitude", "longitude", (c("population") % 1000).alias("videos"))
    names = d.places.filter(k % 2 == 0).select(F.concat(F.lit("alias "), k.cast("string")).alias("alias"), F.when(k % 4 == 0, F.concat(F.lit("sao "), c("state"))).otherwise("elsewhere").alias("name"))
    kept, named = writers.export_gazetteer(p, names)
    n = named.groupBy(clean.normalize_name(c("name")).alias("key")).agg(F.count("*").alias("n_aliases"))
    return kept.join(n, clean.normalize_name(c("city")) == c("key"), "left").select("place_id", "city", "country", "latitude", "longitude", "n_aliases")


def published(d: Data) -> DataFrame:
    """The chain of five snapshots: import, coordinates, summary, insights, and the summary with its insights."""
    columns = ["session_id", "link", "place_id", "speed", "status", "latitude", "longitude"]
    old = d.sessions.filter("batch <= 1997").select(*columns)
    new = d.sessions.filter("batch >= 1997").withColumn("speed", c("speed") + 5).select(*columns)
    found = d.sessions.filter(c(K) % 4 == 0).select("link", F.lit("ok").alias("status"), c("n_people").cast("double").alias("latitude"), c("n_vehicles").cast("double").alias("longitude"))

    def summarize(places: DataFrame, sessions: DataFrame) -> DataFrame:
        per = sessions.groupBy("place_id").agg(F.sum("speed").alias("speed"), F.count_if(c("status") == "ok").alias("located"), F.max("latitude").alias("north"))
        return places.select("place_id", "city").join(per, "place_id", "left")

    def describe(places: DataFrame, sessions: DataFrame) -> DataFrame:
        fast = sessions.groupBy("place_id").agg(F.max("speed").alias("top")).filter("top > 200000")
        return fast.select("place_id", F.lit(1).alias("position"), F.lit("speed").alias("category"), F.concat(F.lit("up to "), c("top").cast("string")).alias("text"))

    out = writers.publish(d.spark, new_path(d.spark, "published"), d.places, old, new, found, ["latitude", "longitude"], summarize, describe)["published"]
    return out.select("place_id", "city", c("speed").cast("double").alias("speed"), c("located").cast("double").alias("located"), "north", F.array_join(F.transform("insights", lambda i: i["text"]), ",").alias("insights"))


def routed_files(d: Data) -> DataFrame:
    """Raw tables, a folder each, dealt to statistics tables: by hand, by their headers, or as weather by daytime; and their rows."""
    folder = new_path(d.spark, "routes")
    known = {"gender_stats": stats_by_gender(d), "age_stats": stats_by_age(d), "vehicle_stats": stats_by_flag(d, "vehicle_type", {f: f for f in FLAGS})}
    raw = known | {"odd_weather": stats_by_weather(d).withColumns({"more": F.lit(1), "yet": F.lit(2)}), "by_hand": stats_by_flag(d, "clothing_type", CLOTHES), "unlike": d.region.select("r_name")}
    for name, df in known.items():
        writers.write_csv(df.limit(0).coalesce(1), f"{folder}/known/{name}")
    for name, df in raw.items():
        writers.write_csv(df.coalesce(1), f"{folder}/raw/{name}")
    heads = readers.list_headers(d.spark, f"{folder}/raw")
    above = lambda x: F.element_at(F.split(x, "/"), -2)
    manual = heads.filter(above(c("path")) == "by_hand").select("path", F.lit("clothing_stats").alias("target"))
    matched = readers.match_headers(heads, readers.list_headers(d.spark, f"{folder}/known")).withColumn("b", above(c("b")))
    routed = readers.route_files(heads, manual, matched).select(above(c("path")).alias("place"), "target")
    lines = readers.scan_place_folders(d.spark, f"{folder}/raw").groupBy("place").agg((F.count("*") - 1).alias("n_rows"))
    return lines.join(routed, "place")


def cleaned_texts(d: Data) -> DataFrame:
    """Texts as exports have them: loose booleans, dates, broken letters, arrays in JSON, letters with marks of their own."""
    k = c("event_id")
    e = d.events.select(k, F.when(k % 4 == 0, "TRUE").when(k % 4 == 1, "1").when(k % 4 == 2, "yes").alias("flag"), F.concat(F.lit(" 199"), (k % 10).cast("string"), F.lit("-"), (k % 15 + 10).cast("string"), F.lit("-01T00:00")).alias("day"),
        F.when(k % 3 == 0, "S?o").when(k % 3 == 1, "M®nchen ¨").otherwise("Oslo").alias("name"), F.when(k % 3 == 0, F.concat(F.lit("[1,"), k.cast("string"), F.lit("]"))).when(k % 3 == 1, "[]").otherwise('{"a":1}').alias("json"), F.concat(F.lit("e\u0301"), k.cast("string")).alias("marked"))
    numbers = clean.parse_json_array(c("json"), "bigint")
    return e.select(
        k, clean.loose_true(c("flag")).alias("loose"), clean.parse_date(c("day")).cast("string").alias("day"), clean.fix_mojibake(c("name"), {"S?o": "São"}, {"®": "ü", " ¨": ""}).alias("fixed"), clean.is_corrupted(c("name")).alias("corrupted"),
        F.coalesce(F.element_at(numbers, 2), F.lit(-1)).cast("long").alias("second"), clean.nfc(c("marked")).alias("composed"))


def appended_categories(d: Data) -> DataFrame:
    """Flags of the raw table as categories that a statistics table lacks."""
    known = d.spark.createDataFrame([(f, "1") for f in FLAGS[:2]], "vehicle string, n string")
    raw = d.observations.select(*[c(f).cast("string").alias(f) for f in FLAGS])
    return api.append_categories(known, raw, FLAGS).select("vehicle", "n")


def route_points(d: Data) -> DataFrame:
    point = lambda a, b: F.array(c(a).cast("double"), c(b).cast("double"))
    routes = d.sessions.select("link", F.when(c(K) % 3 != 0, F.array(point("n_people", "n_vehicles"), point("crossing_time", "hazard"))).alias("route"))
    return api.route_points(routes).withColumn("position", c("position").cast("long"))


QUERIES = [csv_files, localization_file, world_file, replaced_source, refreshed_snapshots, exported_gazetteer, published, routed_files, cleaned_texts, appended_categories, route_points]


def sql() -> dict[str, str]:
    from .oracle import AGE_STATS, FACTS, GENDER_STATS, WEATHER_STATS, summary as summary_sql

    fast = "CASE WHEN batch >= 1997 THEN speed + 5 ELSE speed END"
    flags = " UNION ALL ".join(f"SELECT '{f}' AS vehicle, '' AS n FROM observations GROUP BY ALL HAVING bool_or({f})" for f in FLAGS[2:])
    return {
        "csv_files": "SELECT CAST(session_id AS varchar) AS session_id, link, 'é, \"' || weather || '\"' || chr(10) || street_name AS note, CASE WHEN batch <= 1997 THEN CAST(collected AS varchar) END AS collected FROM sessions",
        "localization_file": """SELECT link, status, 'run' AS source, CASE WHEN session_id % 7 <> 0 AND session_id % 91 <= 90 THEN (session_id % 91)::double END AS latitude, CASE WHEN session_id % 181 <= 180 THEN (session_id % 181)::double END AS longitude, confidence AS confidence_level, spread_m AS confidence_spread_m, street_name,
  CASE WHEN session_id % 2 = 0 THEN session_id % 5 ELSE -1 END AS first_rank, CASE WHEN session_id % 3 = 0 AND session_id % 100 <= 90 THEN 2 ELSE -1 END::BIGINT AS n_route, (session_id % 50)::double AS route_length_m FROM sessions""",
        "world_file": "SELECT state AS name, country, iso3, continent, population, latitude, longitude, 0::BIGINT AS videos FROM places WHERE latitude IS NOT NULL AND longitude IS NOT NULL QUALIFY row_number() OVER (PARTITION BY state, country ORDER BY population DESC, latitude DESC, longitude DESC) = 1",
        "replaced_source": f"@{FACTS} SELECT * REPLACE (CASE WHEN data_source = 'gender_stats' THEN value_numeric * 2 ELSE value_numeric END AS value_numeric) FROM facts",
        "refreshed_snapshots": f"SELECT country, count(*) AS places, sum(total_sessions)::BIGINT AS sessions, sum(n_observations)::BIGINT AS observations FROM ({summary_sql()}) GROUP BY 1",
        "exported_gazetteer": """@g AS (SELECT place_id, 'São ' || state AS city, country, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, state FROM places WHERE place_id % 5 <> 0 AND latitude IS NOT NULL AND longitude IS NOT NULL QUALIFY row_number() OVER (PARTITION BY state, iso3 ORDER BY population % 1000 DESC, place_id) = 1)
  SELECT g.* EXCLUDE (state), n AS n_aliases FROM g LEFT JOIN (SELECT state, count(*) AS n FROM places WHERE place_id % 4 = 0 GROUP BY 1) a ON a.state = g.state""",
        "published": f"""@t AS (SELECT place_id, {fast} AS speed, CASE WHEN session_id % 4 = 0 THEN 'ok' ELSE status END AS status, CASE WHEN session_id % 4 = 0 THEN n_people::double ELSE latitude END AS latitude FROM sessions)
  SELECT p.place_id, p.city, speed, located, north, CASE WHEN top > 200000 THEN 'up to ' || top ELSE '' END AS insights FROM places p LEFT JOIN (SELECT place_id, sum(speed)::double AS speed, (count(*) FILTER (status = 'ok'))::double AS located, max(latitude) AS north, max(speed) AS top FROM t GROUP BY 1) s ON p.place_id = s.place_id""",
        "routed_files": f"SELECT 'gender_stats' AS place, 'gender_stats' AS target, count(*) AS n_rows FROM ({GENDER_STATS}) UNION ALL SELECT 'age_stats', 'age_stats', count(*) FROM ({AGE_STATS}) UNION ALL SELECT 'odd_weather', 'weather_daytime_stats', count(*) FROM ({WEATHER_STATS}) UNION ALL SELECT 'unlike', NULL, count(*) FROM region UNION ALL SELECT 'vehicle_stats', 'vehicle_stats', {len(FLAGS)} UNION ALL SELECT 'by_hand', 'clothing_stats', {len(CLOTHES)}",
        "cleaned_texts": """SELECT event_id, event_id % 4 IN (0, 1) AS loose, CASE WHEN event_id % 15 + 10 <= 12 THEN '199' || event_id % 10 || '-' || (event_id % 15 + 10) || '-01' END AS day, CASE event_id % 3 WHEN 0 THEN 'São' WHEN 1 THEN 'München' ELSE 'Oslo' END AS fixed, event_id % 3 < 2 AS corrupted,
  CASE WHEN event_id % 3 = 0 THEN event_id ELSE -1 END AS second, chr(233) || event_id AS composed FROM events""",
        "appended_categories": flags,
        "route_points": "SELECT link, 0::BIGINT AS position, n_people::double AS latitude, n_vehicles::double AS longitude FROM sessions WHERE session_id % 3 <> 0 UNION ALL SELECT link, 1, crossing_time, hazard FROM sessions WHERE session_id % 3 <> 0",
    }
