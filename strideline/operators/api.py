"""The parameterised queries a client asks, composed of the operators; each returns a DataFrame and starts no job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clean, measures as m
from ..sources.readers import flags_to_categories, realign, single_valued
from . import asof, filters, insights, merge, mixes, rank, rollup


def city_list(summary: DataFrame, city: str | None = None, country: str | None = None, limit: int | None = None, insight_table: DataFrame | None = None) -> DataFrame:
    """Places by name, at most limit (1 to 10000, 1000 by default); insights only with a city. summary: now or as of a date."""
    df = summary.filter(filters.contains_ci("city", city) & filters.contains_ci("country", country))
    if city and insight_table is not None:
        df = df.join(insight_table.select("place_id", "insights"), "place_id", "left")
    return df.orderBy("city", "place_id").limit(filters.clamp(limit, 1, 10000, 1000))


def city_compare(now: DataFrame, then: DataFrame, date: str, today: str, counts: list[str], rates: list[str], city: str | None = None) -> DataFrame:
    """Current figures beside those of a date, for all places or those whose name contains a text."""
    one = lambda df: df.filter(filters.contains_ci("city", city))
    return asof.compare(one(now), one(then), ["city", "country"], counts, rates, filters.real_date(date), today)


#: Metrics of the monthly series; pooled ones are shares of observations, others means over sessions.
SERIES_POOLED = {"risky_crossing_rate": "risky", "run_red_light_rate": "red_light", "crosswalk_usage_rate": "crosswalk"}
SERIES_MEANS = {"avg_crossing_speed": "speed", "avg_crossing_time": "crossing_time", "avg_measured_walking_speed": "measured_speed"}


def monthly_values(sessions: DataFrame, observations: DataFrame, metric: str) -> tuple[DataFrame, DataFrame]:
    """place_id, month and value of a metric, and place_id and value over all time. Observations are counted per session first."""
    month = F.trunc("collected", "month").alias("month")
    if metric in SERIES_POOLED:
        counts = rollup.observation_sums(observations, {"hits": m.count_true(F.col(SERIES_POOLED[metric])), "n": F.count("*")})
        rows = sessions.select("session_id", "place_id", month).join(counts, "session_id")
        value = m.ratio(F.sum("hits"), F.sum("n"))
    elif metric in SERIES_MEANS:
        rows = sessions.select("place_id", month, F.col(SERIES_MEANS[metric]).alias("v")).filter("v IS NOT NULL")
        value = m.mean(F.col("v"))
    else:
        raise ValueError(f"unknown metric: {metric}")
    return rows.filter("month IS NOT NULL").groupBy("place_id", "month").agg(value.alias("value")), rows.groupBy("place_id").agg(value.alias("value"))


def all_series(sessions: DataFrame, observations: DataFrame, metric: str, start: str, end: str) -> DataFrame:
    """place_id, month, value and label for every place: gaps filled; a place with nothing in the window has its value over
    all time at the window's end."""
    monthly, whole = monthly_values(sessions, observations, metric)
    inside = monthly.filter(F.col("month").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    series = asof.series_by_place(inside, start, end)
    single = whole.filter("value IS NOT NULL").join(inside.select("place_id").distinct(), "place_id", "left_anti").select("place_id", F.lit(end).cast("date").alias("month"), "value")
    return series.select("place_id", "month", "value").unionByName(single).withColumn("label", clean.month_label(F.col("month")))


def metric_series(sessions: DataFrame, observations: DataFrame, place: int, metric: str, end_month: str, months: int | None = None) -> DataFrame:
    """month, value and label of one place over the last 1 to 60 months (6 by default); no rows for an unknown place."""
    n = filters.clamp(months, 1, 60, 6)
    end = f"{end_month[:4]}-{end_month[5:7]}-01"
    year, month = int(end[:4]), int(end[5:7]) - (n - 1)
    start = f"{year + (month - 1) // 12:04d}-{(month - 1) % 12 + 1:02d}-01"
    one = sessions.filter(F.col("place_id") == place)
    own = observations.join(one.select("session_id"), "session_id", "left_semi")
    return all_series(one, own, metric, start, end).select("month", "value", "label")


def global_insights(baseline: DataFrame, numbers: dict[str, str], rates: dict[str, str]) -> DataFrame:
    """The global row as a client gets it: names of numbers, and of rates, which are times 100."""
    return baseline.select(*[F.col(c).alias(n) for n, c in numbers.items()], *[(F.col(c) * 100).alias(n) for n, c in rates.items()])


def deltas_vs_global(base: DataFrame, baseline: DataFrame, metrics: dict[str, str], key: str = "place_id") -> DataFrame:
    """key, metric, value, delta and above: each metric beside the global figure; rates between 0 and 1 count as percentages.

    metrics: column of base -> column of baseline, which has one row."""
    value = lambda c, g: F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), m.delta_percent_panel(F.col(c), F.col(g)).alias("delta"), F.coalesce(F.col(c) > F.col(g), F.lit(False)).alias("above"))
    rows = base.crossJoin(F.broadcast(baseline.select(*metrics.values())))
    return rows.select(key, F.explode(F.array(*[value(c, g) for c, g in metrics.items()])).alias("d")).select(key, "d.*").filter("value IS NOT NULL")


def known_places(summary: DataFrame, sessions: str = "total_sessions", people: str = "n_observations") -> DataFrame:
    """Names of places with sessions and people, sorted."""
    return summary.filter((F.col(sessions) > 0) & (F.col(people) > 0)).select("city").distinct().orderBy("city")


def metric_insights(base: DataFrame, baseline: DataFrame, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """For each metric its extremes, the global mean, and a sentence; metrics without a value above 0 are left out.

    metrics: column of base -> (label, column of baseline)."""
    found = rank.extremes(base, list(metrics))
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.lit(label).alias("label"), F.col(g).cast("double").alias("global_mean")) for c, (label, g) in metrics.items()])
    means = baseline.select(F.explode(pairs).alias("p")).select("p.*")
    text = F.concat_ws(" ", "label", F.lit("is highest in"), "top_name", F.lit("and lowest in"), "bottom_name")
    return found.join(F.broadcast(means), "metric").withColumn("sentence", text)


#: Panels of a place and, in each, the columns that name an item and that are its count and value.
PANELS = {
    "weather": ("category", "n", "percent"), "daytime": ("category", "n", "percent"), "gender": ("category", "n", "percent"), "vehicles": ("category", "n", "percent"),
    "risk_by_age": ("bucket", "n", "risky_percent"), "risk_factors": ("weather", "n", "mean_value"),
}


def city_details(sessions: DataFrame, observations: DataFrame, averages: DataFrame, stored_ranks: DataFrame, stored_ages: DataFrame, flags: list[str], observed_weather: Column | None = None, place: int | None = None, tasks: int | None = None) -> dict[str, DataFrame]:
    """The panels of one place, or of all: ranks, mixes of weather, daytime, gender and vehicles, risk by age and by weather,
    average age, and measured behaviour. A filter on the place reaches the scans.

    Ranks, weather and age fall back where a place has none, and say by layer which source told: ranks from stored_ranks
    (place_id and a rank for each column of averages), else counted among averages of all places; weather from sessions, else
    sessions counted by the weather that observations name; age from stored_ages (place_id, avg_age), else the mean of
    observed ages above 0, else the middles of age buckets.

    observations may know their place (place_id, as of rollup.of_places); then none of them meets its session again. tasks: how
    many sort a panel's counts, for tables so large that Spark's own number would hold too many of them in one."""
    only = lambda df: df if place is None else df.filter(F.col("place_id") == place)
    s = only(sessions)
    o = only(observations) if "place_id" in observations.columns else observations if place is None else observations.join(s.select("session_id"), "session_id", "left_semi")
    columns = [x for x in averages.columns if x != "place_id"]
    counted = rank.rank_by_average(averages, columns).select("place_id", *[F.col(f"{x}_rank").alias(x) for x in columns])
    stored = stored_ranks.select("place_id", *columns).filter(F.coalesce(*[F.col(x) for x in columns]).isNotNull())
    weather = {"sessions": mixes.weather_mix(s, tasks=tasks)}
    if observed_weather is not None:
        seen = o.withColumn("__weather", observed_weather)
        weather["observations"] = mixes.mix_of_sessions(seen.filter(~F.lower("__weather").isin(*mixes.NOT_WEATHER)), s, F.col("__weather"), distinct=True, tasks=tasks)
    by_age = mixes.risk_of_sessions(o, s, clean.age_detail(F.col("age")), F.col("age"), F.col("risky"))
    ages = {
        "summary": only(stored_ages).select("place_id", "avg_age").filter("avg_age <> 0"),
        "observations": rollup.observation_rollup(o.filter("age > 0"), s, {"a": F.sum("age"), "k": F.count("age")}, {"avg_age": m.ratio(F.col("a"), F.col("k"))}),
        "buckets": mixes.average_of_buckets(by_age),
    }
    n = F.count("measured_speed")
    measured = s.groupBy("place_id").agg(n.alias("n"), m.mean(F.col("measured_speed")).alias("mean"), m.weighted_mean(F.col("measured_speed"), F.col("measured_n")).alias("weighted"))
    return {
        "ranks": mixes.with_fallback({"stored": only(stored), "counted": only(counted)}, tasks=tasks),
        "weather": mixes.with_fallback(weather, tasks=tasks),
        "daytime": mixes.mix_of_sessions(o, s, F.when(F.col("daytime"), "Day").otherwise("Night"), tasks=tasks),
        "gender": mixes.mix_of_sessions(o, s, F.col("gender"), tasks=tasks),
        "vehicles": mixes.flag_mix(rollup.observation_rollup(o, s, mixes.flag_sums(flags), {f: F.col(f) for f in flags}), "place_id", flags),
        "risk_by_age": by_age,
        "risk_factors": mixes.risk_factors(s, "place_id", "weather", F.col("risky_ratio"), tasks=tasks),
        "age": mixes.with_fallback(ages, tasks=tasks),
        "measured": measured.select("place_id", "n", *[F.when(F.col("n") > 0, F.col(x)).alias(x) for x in ("mean", "weighted")]),
    }


def details_rows(panels: dict[str, DataFrame]) -> DataFrame:
    """The panels in one form: place_id, panel, item, n, value and layer."""
    out: DataFrame | None = None
    for panel, df in panels.items():
        layer = F.col("layer") if "layer" in df.columns else F.lit(None).cast("string")
        if panel in PANELS:
            item, n, value = PANELS[panel]
            entries = [F.struct(F.col(item).cast("string").alias("item"), F.col(n).cast("long").alias("n"), F.col(value).cast("double").alias("value"))]
        else:
            count = F.col("n").cast("long") if "n" in df.columns else F.lit(None).cast("long")
            entries = [F.struct(F.lit(x).alias("item"), count.alias("n"), F.col(x).cast("double").alias("value")) for x in df.columns if x not in ("place_id", "layer", "n")]
        rows = df.select("place_id", F.lit(panel).alias("panel"), layer.alias("layer"), F.explode(F.array(*entries)).alias("e")).select("place_id", "panel", "e.*", "layer")
        out = rows if out is None else out.unionByName(rows)
    return out


def top_stored_insights(stored: DataFrame, limit: int | None = None, text: str = "insights") -> DataFrame:
    """The best insights of places whose insights are stored as JSON text; scores that aren't numbers are dropped."""
    number = lambda i: i.withField("relevance_score", clean.strict_numeric(i["relevance_score"]))
    rows = stored.select("place_id", "city", F.transform(insights.from_json_insights(F.col(text)), number).alias("insights"))
    return insights.top_of_arrays(rows, filters.clamp(limit, 1, 50, 5))


def route_points(places: DataFrame, key: str = "link") -> DataFrame:
    """The points of each route in order. places: key and route, as the localization reader gives it."""
    rows = places.select(key, F.posexplode("route").alias("position", "p"))
    return rows.select(key, "position", F.col("p")[0].alias("latitude"), F.col("p")[1].alias("longitude"))


def uncertainty_radius(spread_m: Column) -> Column:
    """Metres to draw around a place, at most 50 km."""
    return F.least(spread_m, F.lit(50_000.0))


def append_categories(target: DataFrame, incoming: DataFrame, flags: list[str] | None = None, renames: dict[str, str] | None = None) -> DataFrame:
    """The rows a raw file adds to a statistics table: flag columns become categories, other columns are aligned with
    the table's; only rows whose first column is new are added."""
    key = target.columns[0]
    rows = flags_to_categories(incoming, flags, key) if flags else single_valued(realign(incoming, target.columns, renames), key).filter(F.col(key) != "")
    return merge.append_dedup(target, realign(rows, target.columns), [key])
