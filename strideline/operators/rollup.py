"""Roll-ups of places, sessions and observations at their own grains.

Sessions and observations are aggregated apart and then joined on the place, so a session's average isn't weighted by
its observations. Observations are summed per session before they meet their sessions: what is shuffled for the join
is one row a session. Column specs (name -> Column) make the same code serve any three-level data; names not in a spec
are never read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.storage import cut
from . import order

Spec = Mapping[str, Column]
Percentiles = Mapping[str, tuple[str, float]]
#: Rows whose values are counted in one task.
PER_TASK = 1 << 19
#: A place is hot if more than HOT of one session in SAMPLED, by its hash, are its own: more than about 2^16 sessions.
SAMPLED, HOT = 1 << 10, 1 << 6


def session_rollup(sessions: DataFrame, spec: Spec, key: str = "place_id") -> DataFrame:
    return sessions.groupBy(key).agg(*[c.alias(n) for n, c in spec.items()])


def observation_sums(observations: DataFrame, parts: Spec, key: str = "session_id") -> DataFrame:
    """Additive parts (sums, counts) of each session's observations."""
    return observations.groupBy(key).agg(*[c.alias(n) for n, c in parts.items()])


def observation_rollup(observations: DataFrame, sessions: DataFrame, parts: Spec, finals: Spec, place: str = "place_id", session: str = "session_id") -> DataFrame:
    """finals: over the columns of parts summed per place; observations that know their place are summed by it."""
    if place in observations.columns:
        return observation_sums(observations, parts, place).select(place, *[c.alias(n) for n, c in finals.items()])
    per_session = observation_sums(observations, parts, session)
    per_place = per_session.join(sessions.select(session, place), session).groupBy(place).agg(*[F.sum(n).alias(n) for n in parts])
    return per_place.select(place, *[c.alias(n) for n, c in finals.items()])


def counts_and_hot(sessions: DataFrame, name: str, value: Column, place: str = "place_id", session: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """All sessions' counted values (all, name, value, n), and the hot places, from one pass. Which places are hot says how rows are
    dealt and never what comes out; there is at most one for HOT sessions of the sample."""
    some = F.when(F.pmod(F.xxhash64(session), F.lit(SAMPLED)) == 0, F.col(place))
    counted = cut(sessions.groupBy(some.alias("__some"), value.cast("double").alias("value")).agg(F.count("*").alias("n")))
    counts = counted.filter("value IS NOT NULL").groupBy(F.lit(0).alias("all"), F.lit(name).alias("name"), "value").agg(F.sum("n").alias("n"))
    hot = counted.filter("__some IS NOT NULL").groupBy(F.col("__some").alias(place)).agg(F.sum("n").alias("__n")).filter(F.col("__n") > HOT)
    return counts, cut(hot.select(place))


def place_parts(sessions: DataFrame, observations: DataFrame, session_spec: Spec, parts: Spec, hot: DataFrame, percentiles: Percentiles | None = None, place: str = "place_id", session: str = "session_id") -> DataFrame:
    """One row a place, and one for what has none: session aggregates beside sums of the observations' additive parts, from
    one pass over either table. In session_spec the column __session tells sessions from observations without one.
    percentiles: name -> (a column of sessions, p), exact, NULL for what has no place.

    Sums of this table's additive columns are the figures of all rows, so places and the whole need no second pass. Rows are
    dealt by place before they are aggregated, as sets and modes of a few rows each cost more than the rows; those of hot
    places, and without a place, are spread over all tasks, and hot places' percentiles come from counted values."""
    percentiles = percentiles or {}
    tasks, sums = tasks_of(sessions), observation_sums(observations, parts, session)
    rows = sessions.withColumn("__session", F.lit(1)).join(sums, session, "full_outer").join(F.broadcast(hot.withColumn("__hot", F.lit(True))), place, "left")
    spread = F.col(place).isNull() | F.col("__hot").isNotNull()
    rows = rows.repartition(tasks, place, F.when(spread, F.pmod(F.xxhash64(session), F.lit(tasks))).otherwise(F.lit(0)))
    columns = list(dict.fromkeys(x for x, _ in percentiles.values()))
    # Plus 0, so that -0.0 is 0.0 as among counted values.
    lists = [F.sort_array(F.collect_list(F.when(~spread, F.col(x).cast("double") + F.lit(0.0)))).alias(f"__{x}") for x in columns]
    out = rows.groupBy(place).agg(*[x.alias(n) for n, x in session_spec.items()], *[F.sum(n).alias(n) for n in parts], *lists)
    out = out.withColumns({n: order.of_sorted(F.col(f"__{x}"), p) for n, (x, p) in percentiles.items()}).drop(*[f"__{x}" for x in columns])
    if not percentiles or hot.isEmpty():
        return out
    counts = value_counts(sessions.join(F.broadcast(hot), place), {x: F.col(x) for x in columns}, place)
    of_hot = order.percentiles_of_counts(counts, place, {f"__{n}": w for n, w in percentiles.items()})
    return out.join(F.broadcast(of_hot), place, "left").withColumns({n: F.coalesce(n, f"__{n}") for n in percentiles}).drop(*[f"__{n}" for n in percentiles])


def tasks_of(rows: DataFrame) -> int:
    """How many tasks rows are dealt to, so that none holds more of them the more there are."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PER_TASK))


def of_places(observations: DataFrame, sessions: DataFrame, tasks: int, place: str = "place_id", session: str = "session_id") -> DataFrame:
    """Observations beside the columns of sessions, dealt by place: written, they serve any number of aggregates by place, each of
    which counts most rows of a place where it reads them. Rows of a session without a place are left out."""
    return observations.repartition(tasks, session).join(sessions.filter(F.col(place).isNotNull()).hint("shuffle_hash"), session).repartition(tasks, place)


def value_counts(rows: DataFrame, values: Spec, key: str, sessions: DataFrame | None = None, place: str = "place_id") -> DataFrame:
    """key (or place), name, value and n: how often each value occurs. With sessions, key is a session's, and rows meet its
    place before they are counted: few values repeat within a session, so counts a session would be as many as the rows. The
    number of tasks grows with the rows then, PER_TASK in one, so that none holds more values the more rows there are."""
    wide = rows.select(key, *[x.cast("double").alias(f"__v{i}") for i, x in enumerate(values.values())])
    if sessions is not None:
        tasks = tasks_of(rows)
        wide = wide.filter(F.coalesce(*[F.col(f"__v{i}") for i in range(len(values))]).isNotNull()).repartition(tasks, key).join(sessions.select(key, place), key).repartition(tasks, place)
        key = place
    entries = [F.struct(F.lit(n).alias("name"), F.col(f"__v{i}").alias("value")) for i, n in enumerate(values)]
    return wide.select(key, F.explode(F.array(*entries)).alias("e")).select(key, "e.*").filter("value IS NOT NULL").groupBy(key, "name", "value").agg(F.count("*").alias("n"))


def with_default(df: DataFrame, zeros: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in zeros if c in df.columns})


def place_summary(places: DataFrame, sessions: DataFrame, observations: DataFrame, session_spec: Spec, parts: Spec, finals: Spec, zeros: list[str], key: str = "place_id") -> DataFrame:
    """Every place with its session and observation figures; counts in zeros are 0 where a place has none."""
    df = places.join(session_rollup(sessions, session_spec, key), key, "left").join(observation_rollup(observations, sessions, parts, finals, key), key, "left")
    return with_default(df, zeros)


def fanout_summary(places: DataFrame, sessions: DataFrame, observations: DataFrame, spec: Spec, by: list[str]) -> DataFrame:
    """The single-join roll-up that weights sessions by their observations: kept as the control of place_summary."""
    joined = places.join(sessions, "place_id", "left").join(observations, "session_id", "left")
    return joined.groupBy(*by).agg(*[c.alias(n) for n, c in spec.items()])


def session_summary(sessions: DataFrame, observations: DataFrame, parts: Spec, finals: Spec, zeros: list[str]) -> DataFrame:
    sums = observation_sums(observations, parts).select("session_id", *[c.alias(n) for n, c in finals.items()])
    return with_default(sessions.join(sums, "session_id", "left"), zeros)


def baseline(sessions: DataFrame, observations: DataFrame, places: DataFrame, session_spec: Spec, observation_spec: Spec, session_percentiles: Percentiles | None = None, observation_percentiles: Percentiles | None = None) -> DataFrame:
    """One row: global figures of sessions, observations and places. Percentiles: name -> (column, p)."""
    one = lambda df, spec: df.agg(*[c.alias(n) for n, c in spec.items()])
    out = one(sessions, session_spec).crossJoin(one(observations, observation_spec)).crossJoin(places.agg(F.count("*").alias("total_places")))
    for df, wanted in ((sessions, session_percentiles), (observations, observation_percentiles)):
        if wanted:
            out = out.crossJoin(order.percentiles(df, wanted))
    return out


def ranked(df: DataFrame, ranks: Mapping[str, str], percentiles: Mapping[str, str] | None = None, known_only: Mapping[str, str] | None = None, within: Mapping[str, tuple[str, str]] | None = None, key: str = "place_id") -> DataFrame:
    """Global ranks (largest first, NULLs last) and percent ranks (smallest first, NULLs last), ranks among rows that have
    the value (NULL for the others), and ranks within a group: name -> (column, group). One row a key; no global sort."""
    wanted = {c: (c, None) for part in (ranks, percentiles or {}, known_only or {}) for c in part.values()}
    wanted |= {f"{c} in {g}": (c, g) for c, g in (within or {}).values()}
    names = {w: f"__{i}" for i, w in enumerate(wanted)}
    found = order.placed(df, {names[w]: x for w, x in wanted.items()}, key)
    cols = {n: order.rank(names[c]) for n, c in ranks.items()}
    cols |= {n: order.percent_rank(names[c]) for n, c in (percentiles or {}).items()}
    cols |= {n: order.rank_known(names[c]) for n, c in (known_only or {}).items()}
    cols |= {n: order.rank(names[f"{c} in {g}"]) for n, (c, g) in (within or {}).items()}
    return found.withColumns(cols).drop(*names.values())


def peers(df: DataFrame, name: str, group: str) -> DataFrame:
    """Rows in the same group; 0 for a NULL group."""
    sizes = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias(name))
    return df.join(sizes, group, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long"))).select(*df.columns, name)


def sorted_list(x: Column) -> Column:
    """Distinct values, sorted, joined by ', '; NULL if there are none."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(x)), ", "), F.lit(""))


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write df and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
