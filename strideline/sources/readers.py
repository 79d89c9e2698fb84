"""Readers of exports: CSV of unknown encoding, folders of a place's files, localizations, gazetteers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import clean

#: Signs of a wrong decoding.
BROKEN = "�?®¨"


def _strings(spark: SparkSession, path: str | list[str], encoding: str, **options: str) -> DataFrame:
    return spark.read.options(header="true", inferSchema="false", encoding=encoding, quote='"', escape='"', multiLine="true", **options).csv(path)


def first_lines(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """path, header and is_utf8 of every file with a line, from one distributed pass over lines; no file is held whole."""
    lines = spark.read.options(pathGlobFilter=glob, recursiveFileLookup="true").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n")).alias("o"), "value")
    found = lines.groupBy("path").agg(F.min_by("value", "o").alias("v"), F.bool_and(F.expr("is_valid_utf8(value)")).alias("is_utf8"))
    header = F.when(F.expr("is_valid_utf8(v)"), F.col("v")).otherwise(F.decode(F.col("v").cast("binary"), "ISO-8859-1"))
    return found.select("path", F.regexp_replace(header, "^\ufeff|\r$", "").alias("header"), "is_utf8")


def valid_utf8(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """path and is_utf8 of every file, one row a file."""
    return first_lines(spark, path, glob).select("path", "is_utf8")


def read_csv(spark: SparkSession, path: str, glob: str = "*.csv", normalize: bool = True) -> DataFrame:
    """All values as strings, header row, UTF-8 where a file is valid, else ISO-8859-1, values in NFC, source_file added.

    Columns go by their names: files with one header are read together, those of different headers united by name, missing
    ones NULL. The list of files with their headers, not their rows, comes to the driver, where Spark's reader needs it;
    finding it is a job."""
    groups: dict[tuple[bool, str], list[str]] = {}
    for r in first_lines(spark, path, glob).collect():
        groups.setdefault((r["is_utf8"], r["header"]), []).append(r["path"])
    if not groups:
        raise FileNotFoundError(f"no {glob} in {path}")
    df = None
    for (ok, _), files in sorted(groups.items()):
        part = _strings(spark, files, "UTF-8" if ok else "ISO-8859-1").withColumn("source_file", F.col("_metadata.file_path"))
        df = part if df is None else df.unionByName(part, allowMissingColumns=True)
    names = [c for c in df.columns if c != "source_file"]
    df = df.dropna(how="all", subset=names).select(*[F.col(f"`{c}`") for c in names], "source_file")
    return clean.nfc_columns(df, names) if normalize else df


def read_csv_best_encoding(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1", "UTF-16")) -> DataFrame:
    """The decoding of one file with the fewest signs of a wrong one; the first of equals. Counting them is a job for each encoding."""
    counts = []
    for e in encodings:
        text = spark.read.option("encoding", e).option("wholetext", "false").csv(path, sep="\u0001", quote="").select(F.concat_ws("", "*").alias("t"))
        broken = F.length("t") - F.length(F.translate("t", BROKEN, ""))
        counts.append(text.agg(F.coalesce(F.sum(broken), F.lit(0)).alias("n")).first()["n"])
    return _strings(spark, path, encodings[counts.index(min(counts))])


def scan_place_folders(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Lines of every file below one folder a place: place, file, line; files of names like '[A1]...' are left out."""
    df = spark.read.options(recursiveFileLookup="true", pathGlobFilter=glob).text(path).select(F.col("_metadata.file_path").alias("p"), F.col("value").alias("line"))
    parts = F.split("p", "/")
    df = df.select(F.url_decode(F.element_at(parts, -2)).alias("place"), F.url_decode(F.element_at(parts, -1)).alias("file"), "line")
    return df.filter(~F.col("file").rlike(r"^\[A\d+\]"))


def list_headers(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """path and headers (lower case, sorted set) of every CSV, from its first line; quoted names may hold commas."""
    names = F.split(F.lower("header"), r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    names = F.transform(names, lambda h: F.trim(F.replace(F.regexp_replace(F.trim(h), '^"|"$', ""), F.lit('""'), F.lit('"'))))
    return first_lines(spark, path, glob).select("path", F.array_sort(F.array_distinct(F.array_remove(names, ""))).alias("headers"))


def match_headers(a: DataFrame, b: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of files whose headers agree: equal sets, or shared over the larger set of at least threshold.

    a, b: path and headers. Files meet through a shared header, not by a cross join."""
    left = a.select(F.col("path").alias("a"), "headers", F.size("headers").alias("na")).select("a", "na", F.explode("headers").alias("h"))
    right = b.select(F.col("path").alias("b"), "headers", F.size("headers").alias("nb")).select("b", "nb", F.explode("headers").alias("h"))
    shared = left.join(right, "h").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("n"))
    return shared.withColumn("overlap", F.col("n") / F.greatest("na", "nb")).filter(F.col("overlap") >= threshold).select("a", "b", "overlap")


def route_files(files: DataFrame, manual: DataFrame, matched: DataFrame) -> DataFrame:
    """The target of each file: by hand, else by headers (best overlap), else by a weather and daytime column, else none.

    files: path, headers. manual: path, target. matched: from match_headers."""
    from pyspark.sql import Window

    best = matched.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("overlap"), "b"))).filter("r = 1").select(F.col("a").alias("path"), F.col("b").alias("by_header"))
    both = F.array_contains("headers", "weather") & F.array_contains("headers", "daytime")
    df = files.join(manual.select("path", F.col("target").alias("by_hand")), "path", "left").join(best, "path", "left")
    return df.select("path", F.coalesce("by_hand", "by_header", F.when(both, "weather_daytime_stats")).alias("target"))


def read_localizations(spark: SparkSession, path: str) -> DataFrame:
    """One row a session with candidates and route parsed from JSON, coordinates checked, street cut at 255."""
    df = _strings(spark, path, "UTF-8")
    candidate = "struct<rank:int,latitude:double,longitude:double,street_names:array<string>,support:int,google_maps_url:string>"
    return df.select(
        "link", "status", "source", clean.parse_coord(F.col("lat"), -90, 90).alias("latitude"), clean.parse_coord(F.col("lon"), -180, 180).alias("longitude"),
        "confidence_level", clean.safe_numeric(F.col("confidence_spread_m")).alias("confidence_spread_m"), F.substring(clean.clean_string(F.col("street_names")), 1, 255).alias("street_name"),
        clean.parse_json_array(F.col("candidates"), candidate).alias("candidates"), clean.parse_route(F.col("route_latlon")).alias("route"), clean.safe_numeric(F.col("route_length_m")).alias("route_length_m"),
    )


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """alias and name from a JSON object; keys that begin with '_' are comments."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return text.select(F.explode("m").alias("alias", "name")).filter(~F.col("alias").startswith("_"))


_GAZETTEER = "struct<cities:array<struct<city:string,country:string,iso3:string,state:string,continent:string,latitude:double,longitude:double,population_city:bigint,video_count:bigint>>,aliases:map<string,string>>"


def read_gazetteer(spark: SparkSession, path: str, more_aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Canonical places and aliases of JSON documents {"cities": [...], "aliases": {...}}, a file each, as resolve takes them.

    Places are typed and keep all homonyms: several rows may share a name. Places and aliases whose name folds to nothing go;
    of aliases that fold alike the one of more_aliases (as read_aliases gives them) counts, then the least text. A document is
    read whole by one task."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", _GAZETTEER).alias("g"))
    places = doc.select(F.explode("g.cities").alias("c")).select("c.*").filter(clean.normalize_name(F.col("city")) != "").select(
        F.col("city").alias("name"), "country", "iso3", "state", "continent", "latitude", "longitude", F.col("population_city").alias("population"), F.coalesce("video_count", F.lit(0).cast("long")).alias("videos"),
    )
    pairs = doc.select(F.explode("g.aliases").alias("alias", "name")).withColumn("rank", F.lit(1))
    if more_aliases is not None:
        pairs = pairs.unionByName(more_aliases.select("alias", "name").withColumn("rank", F.lit(0)))
    folded = lambda c: clean.normalize_name(F.col(c)) != ""
    one = pairs.filter(folded("alias") & folded("name")).groupBy(clean.normalize_name(F.col("alias")).alias("key")).agg(F.min(F.struct("rank", "alias", "name")).alias("a"))
    return places, one.select("a.alias", "a.name")


def read_world_places(spark: SparkSession, path: str) -> DataFrame:
    """The world's places from CSV (name, country, iso3, continent, population, latitude, longitude): one row a name and
    country, typed, with videos 0, so that resolve takes it as its world layer; rows without a name or a place go."""
    df = _strings(spark, path, "UTF-8")
    text = lambda c: clean.clean_string(F.col(c)) if c in df.columns else F.lit(None).cast("string")
    df = df.select(
        text("name").alias("name"), text("country").alias("country"), text("iso3").alias("iso3"), text("continent").alias("continent"), clean.safe_numeric(F.col("population")).cast("long").alias("population"),
        clean.parse_coord(F.col("latitude"), -90, 90).alias("latitude"), clean.parse_coord(F.col("longitude"), -180, 180).alias("longitude"), F.lit(0).cast("long").alias("videos"),
    ).filter("name IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL")
    best = F.max_by(F.struct(*[c for c in df.columns if c not in ("name", "country")]), F.struct(F.coalesce("population", F.lit(-1)), "latitude", "longitude"))
    return df.groupBy("name", "country").agg(best.alias("b")).select("name", "country", "b.*")


def homonyms(world: DataFrame) -> DataFrame:
    """name_key and its places, most people first: an array for each folded name, as long as the name has homonyms."""
    place = F.struct((-F.coalesce("population", F.lit(0))).alias("o"), "country", "population", "latitude", "longitude")
    found = world.withColumn("name_key", clean.normalize_name(F.col("name"))).groupBy("name_key").agg(F.array_sort(F.collect_list(place)).alias("p"))
    return found.select("name_key", F.transform("p", lambda x: F.struct(*[x[c].alias(c) for c in ("country", "population", "latitude", "longitude")])).alias("places"))


def read_category_stats(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A statistics table by its name, all values as strings, with the file each row comes from."""
    return _strings(spark, f"{folder}/{name}.csv", "UTF-8").withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def realign(df: DataFrame, columns: list[str], renames: dict[str, str] | None = None) -> DataFrame:
    """df with exactly these columns: by mapping, else by a name that differs in case only, else ''."""
    low = {c.lower(): c for c in df.columns}
    source = {v: k for k, v in (renames or {}).items()}
    pick = lambda c: source.get(c) if source.get(c) in df.columns else low.get(c.lower())
    return df.select(*[(F.col(f"`{pick(c)}`") if pick(c) else F.lit("")).alias(c) for c in columns])


def flags_to_categories(df: DataFrame, flags: list[str], name: str) -> DataFrame:
    """One row for each flag that is true in any row."""
    wide = df.agg(*[F.max(clean.loose_true(F.col(f"`{f}`"))).alias(f) for f in flags])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias(name), F.col(f"`{f}`").alias("on")) for f in flags])).alias("e")).filter("e.on").select(f"e.{name}")


def single_valued(df: DataFrame, dimension: str) -> DataFrame:
    """Distinct values of dimension; each other column keeps its value where a group has exactly one, else ''."""
    others = [c for c in df.columns if c != dimension]
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise("")
    return df.groupBy(dimension).agg(*[F.coalesce(one(c), F.lit("")).alias(c) for c in others])
