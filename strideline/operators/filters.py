"""Parameterised filters of the map query and of lists."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import measures as m


def clamp(n: int | None, low: int, high: int, default: int) -> int:
    return default if n is None else max(low, min(high, n))


def real_date(text: str) -> str:
    """A calendar date as yyyy-mm-dd; anything else is an error."""
    if Date.fromisoformat(text).isoformat() != text:
        raise ValueError(f"not a date: {text}")
    return text


def contains_ci(column: str, text: str | None) -> Column:
    """Case-insensitive containment; % and _ in text are wildcards, as in the list endpoints."""
    return F.lit(True) if not text else F.col(column).ilike(f"%{text}%")


def in_list(column: str, values: list[str] | None) -> Column:
    return F.col(column).isin(*values) if values else F.lit(True)


def in_range(column: str, low: float | None = None, high: float | None = None) -> Column:
    """Inclusive bounds; a NULL value passes only if there is no bound."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(column) >= low)
    if high is not None:
        out = out & (F.col(column) <= high)
    return out


def any_flag(flags: list[str]) -> Column:
    out = F.lit(not flags)
    for f in flags:
        out = out | F.coalesce(F.col(f), F.lit(False))
    return out


def all_flags(flags: list[str]) -> Column:
    out = F.lit(True)
    for f in flags:
        out = out & F.coalesce(F.col(f), F.lit(False))
    return out


def gender_is(values: list[str], column: str = "gender") -> Column:
    """Any of values; 'unknown' stands for NULL and ''."""
    if not values:
        return F.lit(True)
    out = F.coalesce(F.col(column).isin(*[v for v in values if v != "unknown"]), F.lit(False)) if set(values) - {"unknown"} else F.lit(False)
    return out | F.col(column).isNull() | (F.col(column) == "") if "unknown" in values else out


def map_places(summary: DataFrame, sessions: DataFrame, observations: DataFrame, place_filter: Column, observation_filter: Column | None = None, counts: dict[str, tuple[int | None, int | None]] | None = None, weather: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Places that can be served and pass. Observation filters and ranges of flag counts select places whose passing
    observations satisfy them; the served figures stay unfiltered. The join is built only if something asks for it."""
    served = summary.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & (F.col("n_observations") > 0)).filter(place_filter)
    if observation_filter is not None or counts or weather:
        some = sessions.filter(F.lower("weather").isin(*[w.lower() for w in weather])) if weather else sessions
        rows = observations.filter(observation_filter) if observation_filter is not None else observations
        per = rows.groupBy("session_id").agg(F.count("*").alias("__n"), *[m.count_true(F.col(c)).alias(f"__{c}") for c in counts or {}])
        per = per.join(some.select("session_id", "place_id"), "session_id").groupBy("place_id").agg(F.sum("__n").alias("__n"), *[F.sum(f"__{c}").alias(f"__{c}") for c in counts or {}])
        for c, (low, high) in (counts or {}).items():
            per = per.filter(in_range(f"__{c}", low, high))
        served = served.join(per.select("place_id"), "place_id", "left_semi")
    return served.orderBy("city").limit(clamp(limit, 1, 10000, 1000)) if limit else served


def newest_sessions(sessions: DataFrame, places: DataFrame, limit: int = 5) -> DataFrame:
    """The newest sessions of each place, with the place's coordinates where a session has none."""
    from pyspark.sql import Window

    w = Window.partitionBy("place_id").orderBy(F.desc_nulls_last("collected"), F.desc("session_id"))
    top = sessions.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= clamp(limit, 1, 500, 5))
    p = places.select("place_id", F.col("latitude").alias("__lat"), F.col("longitude").alias("__lon"))
    lat = F.coalesce("latitude", "__lat") if "latitude" in sessions.columns else F.col("__lat")
    lon = F.coalesce("longitude", "__lon") if "longitude" in sessions.columns else F.col("__lon")
    return top.join(p, "place_id").withColumns({"latitude": lat, "longitude": lon}).drop("__lat", "__lon")


def served_json(df: DataFrame) -> DataFrame:
    """One JSON text a row; NULL fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("row"))
