"""Registered queries that keep snapshots, summaries and provenance up to date, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import clean, measures as m
from ..operators import api, incremental, insights, merge, reports, rollup
from ..sources.storage import new_path
from ..streaming import ingest
from .adapters import Data
from .driver import by_place, c, generated, summary

SESSION = ["session_id", "place_id", "collected", "speed", "weather", "status", "batch"]
#: Corrections of located sessions, as SQL over the adapters.
CORRECTED = "SELECT session_id, place_id, collected, speed + CASE WHEN status = 'ok' THEN 1000 ELSE 0 END AS speed, weather, status, batch FROM sessions"


def session_batches(d: Data) -> list[DataFrame]:
    """All sessions as they come: older ones, newer ones, and corrections of the located ones, half of them without weather."""
    s = d.sessions.select(*SESSION)
    fixed = s.filter(c("status") == "ok").withColumns({"speed": c("speed") + 1000, "weather": F.when(c("session_id") % 2 == 0, c("weather"))})
    return [s.filter(c("batch") <= 1997), s.filter(c("batch") > 1997), fixed]


def incremental_snapshot(d: Data) -> DataFrame:
    """Three imports into a snapshot by partition; a correction without weather keeps the one there is."""
    folder, batches = new_path(d.spark, "sessions"), session_batches(d)
    schema = batches[0].schema
    for number, rows in enumerate(batches):
        ingest.merge_batch(rows, number, folder, schema, ["session_id"], lambda old, new: merge.merge(old, new, ["session_id"], {"weather": merge.NEW_OR_OLD}))
    return ingest.snapshot(d.spark, folder, schema).withColumn("collected", c("collected").cast("string"))


def incremental_summary(d: Data) -> DataFrame:
    """Place figures from the parts that three increments left, the third replacing sessions."""
    folder, (old, new, fixed) = new_path(d.spark, "summary"), session_batches(d)
    seen = rollup.observation_sums(d.observations, {"n": F.count("*"), "n_risky": m.count_true(c("risky"))})
    none = {"n": F.lit(0).cast("long"), "n_risky": F.lit(0).cast("long")}
    before = d.sessions.select(*SESSION).filter(c("status") == "ok")
    # Sessions meet what they saw once, not once an increment.
    told = rollup.snapshot(d.sessions.select(*SESSION).join(seen, "session_id", "left"), new_path(d.spark, "told"))
    increments = [(incremental.signed(told.filter(of)), rows) for of, rows in ((c("batch") <= 1997, old), (c("batch") > 1997, new))]
    increments.append((incremental.signed(fixed.withColumns(none), before.withColumns(none)), before))
    tasks = rollup.tasks_of(d.sessions)
    sums = {"sessions": F.lit(1), "speed": c("speed"), "speeds": F.when(c("speed").isNotNull(), 1), "observations": c("n"), "risky": c("n_risky")}
    values = {"speed": c("speed"), "day": F.unix_date("collected"), "batch": c("batch")}
    for number, (rows, touching) in enumerate(increments):
        incremental.refresh(incremental.parts(rows, "place_id", sums, values, tasks), number, folder, "place_id", touching=touching)
    state = incremental.current(d.spark, folder, "place_id", "long")
    out = d.places.select("place_id")
    for part in (incremental.totals(state, "place_id", list(sums)), incremental.extremes(state, "place_id", ["day", "batch"]), incremental.percentiles(state, "place_id", {"median_speed": ("speed", 0.5)})):
        out = out.join(part, "place_id", "left")
    day = lambda x: F.date_from_unix_date(c(x).cast("int")).cast("string")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return out.select(
        "place_id", zero("sessions").alias("total_sessions"), m.ratio(c("speed"), c("speeds")).alias("avg_speed"), zero("observations").alias("n_observations"), m.ratio(c("risky"), c("observations")).alias("risky_rate"),
        "median_speed", day("min_day").alias("earliest"), day("max_day").alias("latest"), zero("distinct_batch").alias("batch_count"),
    )


def upsert_places(d: Data) -> DataFrame:
    """Customers as a second import of places: some known, with more people, some under a new country."""
    old = d.places.select("place_id", "city", "country", "population")
    k = c("place_id")
    new = old.select((k + 1_000_000).alias("place_id"), "city", F.when(k % 4 == 0, "ELSEWHERE").otherwise(c("country")).alias("country"), (c("population") + 7).alias("population"), F.lit(1).alias("row"))
    return merge.upsert_places(old, new.unionByName(new.withColumns({"population": c("population") + 1, "row": F.lit(2)})), ["row"])


def import_batches(d: Data) -> DataFrame:
    """Every year's import with how many sessions carry it and how many files it names."""
    s = d.sessions.select(c("batch").cast("string").alias("batch"))
    files = F.create_map(F.lit("files"), F.concat(F.lit("a.csv, b.csv,"), c("batch"), F.lit(".csv, a.csv")))
    started = s.distinct().unionByName(s.limit(1).select(F.lit("none yet").alias("batch"))).select("batch", F.lit("2002-01-01").cast("timestamp").alias("started"), files.alias("metadata"))
    return merge.finalize_batches(started, s).select("batch", "record_count", c("file_count").cast("long").alias("file_count"))


def backfilled(d: Data) -> DataFrame:
    """Sessions of which some lack batch, dates or both, and the month that each belongs to."""
    k = c("session_id")
    created = F.to_timestamp(F.lit("1996-05-06 07:08:09"))
    s = d.sessions.select(k, F.when(k % 3 != 0, c("batch").cast("string")).alias("batch"), F.when(k % 2 == 0, c("collected")).alias("collected"), F.when(k % 5 != 0, F.to_timestamp(F.lit("1999-01-02 00:00:00"))).alias("first_imported"), created.alias("created"))
    out = merge.backfill_provenance(s, "backfill").withColumn("month", clean.effective_date(c("collected"), c("first_imported"), c("created")))
    return out.select("session_id", "batch", *[c(x).cast("string").alias(x) for x in ("collected", "month")], F.date_format("first_imported", "yyyy-MM-dd HH:mm:ss").alias("first_imported"))


def city_list(d: Data) -> DataFrame:
    return api.city_list(summary(d), "er#0000", "nation_1", 40).select("place_id", "city", "country", "total_sessions", "n_observations", "risky_rate")


def stored_top_insights(d: Data) -> DataFrame:
    """The best insights read back from JSON texts."""
    stored = insights.store_arrays(d.places.select("place_id", "city"), generated(d)).withColumn("insights", F.to_json("insights"))
    return api.top_stored_insights(stored, 50).select("place_id", "city", F.substring_index("id", "_", -1).alias("rule"), "relevance_score")


def age_coverage(d: Data) -> DataFrame:
    """Ages of 5 and less count as unknown, as a failed estimate gives 0."""
    rows = by_place(d, "age").withColumn("age", F.when(c("age") > 5, c("age")).otherwise(F.when(c("age").isNotNull(), 0)))
    named = rows.join(d.places.select("place_id", "city"), "place_id", "left")
    return reports.age_coverage(named, "city").withColumn("groups_with_age", c("groups_with_age").cast("double"))


QUERIES = [incremental_snapshot, incremental_summary, upsert_places, import_batches, backfilled, city_list, stored_top_insights, age_coverage]


def sql() -> dict[str, str]:
    from .oracle import BY_PLACE, QUERIES as KNOWN, count_if, mean, ratio, summary as summary_sql

    known = "age > 5"
    return {
        "incremental_snapshot": f"SELECT * REPLACE (CAST(collected AS varchar) AS collected) FROM ({CORRECTED})",
        "incremental_summary": f"""@fixed AS ({CORRECTED}) SELECT p.place_id, coalesce(total_sessions, 0) AS total_sessions, avg_speed, coalesce(n, 0)::BIGINT AS n_observations, risky_rate, median_speed, earliest, latest, coalesce(batch_count, 0) AS batch_count
  FROM places p LEFT JOIN (SELECT place_id, count(*) AS total_sessions, {mean('speed')} AS avg_speed, quantile_cont(speed, 0.5) AS median_speed, CAST(min(collected) AS varchar) AS earliest, CAST(max(collected) AS varchar) AS latest, count(DISTINCT batch) AS batch_count FROM fixed GROUP BY 1) v ON p.place_id = v.place_id
  LEFT JOIN (SELECT place_id, count(*) AS n, {ratio(count_if('risky'), 'count(*)')} AS risky_rate FROM ({BY_PLACE}) GROUP BY 1) o ON p.place_id = o.place_id""",
        "upsert_places": "SELECT place_id, city, country, population + CASE WHEN place_id % 4 = 0 THEN 0 ELSE 7 END AS population FROM places UNION ALL SELECT place_id + 1000000, city, 'ELSEWHERE', population + 7 FROM places WHERE place_id % 4 = 0",
        "import_batches": "SELECT CAST(batch AS varchar) AS batch, count(*) AS record_count, 3::BIGINT AS file_count FROM sessions GROUP BY 1 UNION ALL SELECT 'none yet', 0, 3",
        "backfilled": """SELECT session_id, coalesce(b, 'backfill') AS batch, CAST(CASE WHEN b IS NULL THEN coalesce(d, DATE '1996-05-06') ELSE d END AS varchar) AS collected, CASE WHEN b IS NULL THEN coalesce(f, '1996-05-06 07:08:09') ELSE f END AS first_imported,
  CAST(CAST(date_trunc('month', coalesce(CASE WHEN b IS NULL THEN coalesce(d, DATE '1996-05-06') ELSE d END, CAST(f AS date), DATE '1996-05-06')) AS date) AS varchar) AS month
  FROM (SELECT session_id, CASE WHEN session_id % 3 <> 0 THEN CAST(batch AS varchar) END AS b, CASE WHEN session_id % 2 = 0 THEN collected END AS d, CASE WHEN session_id % 5 <> 0 THEN '1999-01-02 00:00:00' END AS f FROM sessions)""",
        "city_list": f"SELECT place_id, city, country, total_sessions, n_observations, risky_rate FROM ({summary_sql()}) WHERE city ILIKE '%er#0000%' AND country ILIKE '%nation_1%' ORDER BY city, place_id LIMIT 40",
        "stored_top_insights": KNOWN["top_insights"],
        "age_coverage": f"""@a AS (SELECT city, count(*) AS total, {count_if(known)} AS with_age FROM ({BY_PLACE}) o JOIN places p ON o.place_id = p.place_id GROUP BY 1), b AS (SELECT *, NULL::double AS groups_with_age FROM a UNION ALL SELECT 'all', sum(total)::BIGINT, sum(with_age)::BIGINT, {count_if('with_age > 0')}::double FROM a)
  SELECT *, total - with_age AS without_age, CAST(100 * with_age AS double) / nullif(total, 0) AS percent FROM b""",
    }
