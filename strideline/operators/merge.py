"""Merging imports into snapshots, with history, provenance and reports of what was turned down.

A merge is one full outer join on the key with a policy for each column; it returns the new snapshot, and writing is
the caller's, so a rerun of a lost task or of a whole import changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

NEW, OLD, NEW_OR_OLD, OLD_OR_NEW = "new", "old", "coalesce_new_old", "coalesce_old_new"


def pick(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """One row a key: the first, or last, by a total order of the input."""
    cols = [(F.desc(c) if last else F.asc(c)) if isinstance(c, str) else c for c in order]
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*cols))).filter("__r = 1").drop("__r")


def merge(old: DataFrame, new: DataFrame, keys: list[str], policy: dict[str, str], default: str = NEW) -> DataFrame:
    """Rows of either side, keyed null-safely; of a row in both each column is taken by its policy: the new value (even
    NULL), the old one, or the first that isn't NULL. Both sides have one row a key; columns are those of old."""
    o, n = old.alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    joined = o.withColumn("__old", F.lit(True)).alias("o").join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    both = F.col("__old").isNotNull() & F.col("__new").isNotNull()
    cols = []
    for c in old.columns:
        a, b = F.col(f"o.`{c}`"), F.col(f"n.`{c}`") if c in new.columns else F.lit(None)
        if c in keys:
            cols.append(F.when(F.col("__old").isNotNull(), a).otherwise(b).alias(c))
            continue
        rule = OLD if c not in new.columns else policy.get(c, default)
        value = {NEW: b, OLD: a, NEW_OR_OLD: F.coalesce(b, a), OLD_OR_NEW: F.coalesce(a, b)}[rule]
        cols.append(F.when(both, value).when(F.col("__new").isNotNull(), b).otherwise(a).alias(c))
    return joined.select(*cols)


def upsert_places(old: DataFrame, new: DataFrame, order: list, keys: tuple[str, ...] = ("city", "country"), id: str = "place_id") -> DataFrame:
    """The batch's first row of a key wins; all attributes are overwritten, the id stays."""
    return merge(old, pick(new, list(keys), order), list(keys), {id: OLD_OR_NEW})


def upsert_sessions(old: DataFrame, new: DataFrame, order: list, batch: str, now: str, key: str = "link") -> DataFrame:
    """The batch's last row of a link wins; the collection date survives a missing one, the first import stays."""
    stamp = F.lit(now).cast("timestamp")
    one = pick(new, [key], order, last=True).withColumns({"batch": F.lit(batch), "first_imported": stamp, "last_updated": stamp})
    return merge(old, one, [key], {"collected": NEW_OR_OLD, "first_imported": OLD_OR_NEW})


def upsert_observations(old: DataFrame, new: DataFrame, order: list, updated: list[str], keys: tuple[str, ...] = ("session_id", "track")) -> DataFrame:
    """Only listed columns are updated; the others keep their first value."""
    return merge(old, pick(new, list(keys), order, last=True), list(keys), {c: NEW for c in updated}, OLD)


def history_rows(old: DataFrame, new: DataFrame, key: str, metrics: list[str], now: str) -> DataFrame:
    """One row for each session that is updated, not added: the metrics it gets and a JSON snapshot of its old row."""
    cols = [F.col(f"n.{c}").alias(c) for c in metrics]
    joined = old.alias("o").join(new.alias("n"), key)
    return joined.select(F.col(key), *cols, F.to_json(F.struct(*[F.col(f"o.{c}").alias(c) for c in old.columns if c != key])).alias("snapshot"), F.lit(now).cast("timestamp").alias("updated_at"))


def start_batch(spark, batch: str, now: str, metadata: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(batch, now, metadata)], "batch string, started string, metadata map<string,string>").withColumn("started", F.col("started").cast("timestamp"))


def finalize_batches(batches: DataFrame, sessions: DataFrame) -> DataFrame:
    """record_count: sessions that carry the batch; file_count: distinct names in the metadata's list of files."""
    n = sessions.groupBy("batch").agg(F.count("*").alias("record_count"))
    files = F.array_remove(F.transform(F.split(F.coalesce(F.try_element_at("metadata", F.lit("files")), F.lit("")), ","), lambda x: F.trim(x)), "")
    return batches.join(n, "batch", "left").withColumns({"record_count": F.coalesce("record_count", F.lit(0)), "file_count": F.size(F.array_distinct(files))})


def append_dedup(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new whose key the target lacks; repeats inside new stay. NULL and '' are one key."""
    k = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    seen = target.select(*[k(c).alias(f"__{i}") for i, c in enumerate(keys)]).distinct()
    return new.join(seen, [k(c) == F.col(f"__{i}") for i, c in enumerate(keys)], "left_anti")


def rejects(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children without a parent."""
    return children.join(parents.select(F.col(parent_key).alias("__p")).distinct(), F.col(child_key) == F.col("__p"), "left_anti")


def lookup_with_fallback(df: DataFrame, table: DataFrame, first: str, second: str, value: str, order: list) -> DataFrame:
    """value from the table by one key, else by another; of several rows with a key the last wins."""
    by = lambda k: pick(table.filter(F.col(k).isNotNull()), [k], order, last=True).select(F.col(k).alias(f"__{k}"), F.col(value).alias(f"__{value}_{k}"))
    out = df.join(by(first), F.col(first) == F.col(f"__{first}"), "left").join(by(second), F.col(second) == F.col(f"__{second}"), "left")
    return out.withColumn(value, F.coalesce(f"__{value}_{first}", f"__{value}_{second}")).drop(f"__{first}", f"__{second}", f"__{value}_{first}", f"__{value}_{second}")


def apply_localizations(sessions: DataFrame, found: DataFrame, columns: list[str], key: str = "link") -> DataFrame:
    """Status 'ok' with usable coordinates sets all columns, any other status only itself; sessions without a row stay.

    found: key, status and the columns, one row a key."""
    rows = found.filter(F.col(key).isNotNull() & (F.col(key) != "")).filter((F.col("status") != "ok") | (F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)))
    n = rows.select(F.col(key).alias("__k"), F.col("status").alias("__status"), *[F.col(c).alias(f"__{c}") for c in columns])
    out = sessions.join(n, F.col(key) == F.col("__k"), "left")
    ok = F.coalesce(F.col("__status") == "ok", F.lit(False))
    out = out.withColumns({c: F.when(ok, F.col(f"__{c}")).otherwise(F.col(c)) for c in columns} | {"status": F.coalesce("__status", "status")})
    return out.drop("__k", "__status", *[f"__{c}" for c in columns])


def backfill_provenance(sessions: DataFrame, batch: str) -> DataFrame:
    """Rows without a batch get one, and dates from their creation."""
    lone = F.col("batch").isNull()
    return sessions.withColumns({
        "collected": F.when(lone, F.coalesce("collected", F.col("created").cast("date"))).otherwise(F.col("collected")),
        "first_imported": F.when(lone, F.coalesce("first_imported", "created")).otherwise(F.col("first_imported")),
        "batch": F.coalesce("batch", F.lit(batch)),
    })
