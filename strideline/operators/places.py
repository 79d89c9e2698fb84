"""Resolving, enriching, merging and repairing place names.

All matching is by equi-joins on a folded key; fuzzy matching is blocked by deletion keys, so that names within one
edit meet without comparing every pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clean

FUZZY_LENGTH = 7


def fold(df: DataFrame, name: str = "name", key: str = "name_key") -> DataFrame:
    return df.withColumn(key, clean.normalize_name(F.col(name)))


def disambiguate(inputs: DataFrame, candidates: DataFrame, key: str = "name_key") -> DataFrame:
    """input_id, candidate columns and confident: the best candidate of each input with any.

    inputs: input_id, key, country, iso3 (hints, may be NULL). candidates: key, country, iso3, videos, population, ....
    A hint that matches is confident and picks the matching candidate with most videos, then people; a hint that
    matches none isn't confident; without a hint only a single candidate is."""
    c = candidates.select(F.col(key).alias("__k"), *[F.col(x).alias(f"c_{x}") for x in candidates.columns if x != key]).filter("__k IS NOT NULL")
    low = lambda x: F.lower(F.trim(x))
    hint = F.coalesce(F.nullif(F.col("iso3"), F.lit("")), F.nullif(F.col("country"), F.lit(""))).isNotNull()
    order = [F.desc_nulls_last("c_videos"), F.desc_nulls_last("c_population"), F.asc_nulls_last("c_country"), F.asc_nulls_last("c_iso3")]
    first = lambda df, *by: df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__r = 1").drop("__r")
    # Hints see a candidate's country and iso3 only, so the best of each of these is enough; no input meets all of a key's candidates.
    best = first(c, "__k", "c_country", "c_iso3")
    way = lambda name, value: F.struct(F.lit(name).alias("way"), value.alias("value"))
    found = first(best.withColumn("__w", F.explode(F.array(way("all", F.lit("")), way("iso3", low("c_iso3")), way("country", low("c_country")), way("country", low("c_iso3"))))).filter("__w.value IS NOT NULL"), "__k", "__w")
    counts = c.groupBy(F.col("__k").alias("__kn")).agg(F.count("*").alias("__n"))
    asked = inputs.withColumns({"__hint": hint, "__way": F.explode(F.array(way("all", F.lit("")), way("iso3", low("iso3")), way("country", low("country"))))})
    df = asked.join(found, (F.col(key) == F.col("__k")) & (F.col("__way.way") == F.col("__w.way")) & (F.col("__way.value") == F.col("__w.value")))
    df = df.withColumn("__hit", F.col("__way.way") != "all").join(counts, F.col("__k") == F.col("__kn"))
    w = Window.partitionBy("input_id")
    df = df.withColumns({"__n": F.sum(F.when(~F.col("__hit"), F.col("__n"))).over(w), "__r": F.row_number().over(w.orderBy(F.desc("__hit"), *order))}).filter("__r = 1")
    return df.withColumn("confident", F.when(F.col("__hint"), F.col("__hit")).otherwise(F.col("__n") == 1)).drop("__k", "__kn", "__hint", "__hit", "__n", "__r", "__way", "__w")


def deletions(key: Column) -> Column:
    """The key and all it becomes by leaving out one letter: two keys within one edit share one of them."""
    n = F.length(key)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, n)))
    return F.array_distinct(F.concat(F.array(key), F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))))


def fuzzy_unique(inputs: DataFrame, known: DataFrame, key: str = "name_key", least: int = FUZZY_LENGTH) -> DataFrame:
    """input_id, key and match: the one known key nearest to a key of at least `least` letters, within one edit; none if
    two are equally near."""
    a = inputs.filter(F.length(key) >= least).select("input_id", key, F.explode(deletions(F.col(key))).alias("__d"))
    b = known.select(F.col(key).alias("match")).distinct().select("match", F.explode(deletions(F.col("match"))).alias("__d"))
    pairs = a.join(b, "__d").select("input_id", key, "match").distinct().withColumn("distance", F.levenshtein(key, "match", 1)).filter("distance >= 0")
    nearest = pairs.groupBy("input_id", key).agg(F.min("distance").alias("distance"))
    hits = pairs.join(nearest, ["input_id", key, "distance"]).groupBy("input_id", key).agg(F.count("*").alias("n"), F.min("match").alias("match"))
    return hits.filter("n = 1").drop("n")


def resolve(inputs: DataFrame, project: DataFrame, aliases: DataFrame, world: DataFrame) -> DataFrame:
    """Every input with the place it means, the layer that told, and confident.

    inputs: input_id, name, country, iso3. project, world: name, country, iso3, videos, population, .... aliases: alias,
    name. An alias counts only if the name itself isn't known; then the project's places, the world's, and last a unique
    fuzzy match among the project's, which is never confident."""
    i, p, w = fold(inputs), fold(project), fold(world)
    names = p.select("name_key").union(w.select("name_key")).distinct()
    alias = fold(aliases, "alias", "__alias").select("__alias", clean.normalize_name(F.col("name")).alias("__to")).dropDuplicates(["__alias"])
    i = i.join(names.withColumn("__known", F.lit(True)), "name_key", "left").join(alias, F.col("name_key") == F.col("__alias"), "left")
    i = i.withColumn("name_key", F.when(F.col("__known").isNull(), F.coalesce("__to", "name_key")).otherwise(F.col("name_key"))).drop("__known", "__alias", "__to")
    common = [c for c in ("name_key", "name", "country", "iso3", "videos", "population", "continent", "state", "latitude", "longitude") if c in p.columns and c in w.columns]
    found = disambiguate(i, p.select(*common)).withColumn("layer", F.lit("project"))
    left = i.join(found.select("input_id"), "input_id", "left_anti")
    found_w = disambiguate(left, w.select(*common)).withColumn("layer", F.lit("world"))
    left = left.join(found_w.select("input_id"), "input_id", "left_anti")
    near = fuzzy_unique(left, p).select("input_id", F.col("match").alias("__match"))
    found_f = disambiguate(left.join(near, "input_id").withColumn("name_key", F.col("__match")).drop("__match"), p.select(*common)).withColumns({"layer": F.lit("fuzzy"), "confident": F.lit(False)})
    told = found.unionByName(found_w).unionByName(found_f)
    return inputs.join(told.drop("name", "country", "iso3", "name_key"), "input_id", "left").withColumn("confident", F.coalesce("confident", F.lit(False)))


def enrich(rows: DataFrame, resolved: DataFrame, fields: list[str]) -> DataFrame:
    """rows with blank or unknown fields filled from confident matches, and name and country made canonical; what is
    still missing of country is 'Unknown'. resolved: from resolve over the same input_id."""
    sure = resolved.filter("confident").select("input_id", *[c for c in resolved.columns if c.startswith("c_")])
    df = rows.join(sure, "input_id", "left")
    hit = F.col("c_name").isNotNull()
    cols: dict[str, Column] = {"name": F.coalesce("c_name", "name")}
    for f in fields:
        if f not in rows.columns or f"c_{f}" not in sure.columns:
            continue
        text = dict(rows.dtypes)[f] == "string"
        blank = F.col(f).isNull() | (F.lower(F.trim(f)).isin("", "unknown") if text else F.lit(False))
        cols[f] = F.when(hit & blank, F.col(f"c_{f}")).otherwise(F.col(f))
    cols["country"] = F.coalesce(F.when(hit, F.col("c_country")), F.nullif(F.trim("country"), F.lit("")), F.lit("Unknown"))
    return df.withColumns(cols).select(*rows.columns)


def score_candidates(places: DataFrame, candidates: DataFrame, least: float = 30.0) -> DataFrame:
    """The best of each place's supplied candidates: place_id, candidate columns and score.

    candidates: place_id, candidate, code. 100 for an equal name, 50 if one contains the other, else 30 times their
    similarity; populated places come first and get 20, 15 or 10 more by their code; a score must exceed `least`."""
    a, b = F.lower("name"), F.lower("candidate")
    base = F.when(a == b, 100.0).when(F.contains(a, b) | F.contains(b, a), 50.0).otherwise(30.0 * clean.similarity(a, b))
    more = F.when(F.col("code") == "PPLC", 20).when(F.col("code") == "PPLA", 15).when(F.coalesce(F.col("code").startswith("PPL"), F.lit(False)), 10).otherwise(0)
    df = places.select("place_id", "name").join(candidates, "place_id").withColumn("score", base + more)
    populated = F.coalesce(F.col("code").startswith("PPL"), F.lit(False))
    w = Window.partitionBy("place_id").orderBy(F.desc(populated), F.desc("score"), "candidate")
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").filter(F.col("score") > least).drop("__r", "name")


def missing_fields(df: DataFrame, text: list[str], numbers: list[str], key: str = "place_id") -> DataFrame:
    """key and missing: the names of fields without a value, in the given order."""
    flags = [F.when(clean.is_missing_text(F.col(c)), F.lit(c)) for c in text] + [F.when(clean.is_missing_number(F.col(c)), F.lit(c)) for c in numbers]
    return df.select(key, F.array_compact(F.array(*flags)).alias("missing"))


def missing_report(missing: DataFrame) -> DataFrame:
    """kind 'field' or 'pattern', what, and how many places miss it."""
    fields = missing.select(F.explode("missing").alias("what")).groupBy("what").agg(F.count("*").alias("n")).select(F.lit("field").alias("kind"), "what", "n")
    patterns = missing.filter(F.size("missing") > 0).select(F.array_join(F.array_sort("missing"), ",").alias("what")).groupBy("what").agg(F.count("*").alias("n")).select(F.lit("pattern").alias("kind"), "what", "n")
    return fields.unionByName(patterns)


def work_list(missing: DataFrame, optional: list[str]) -> DataFrame:
    """Places with a gap that isn't optional."""
    return missing.filter(F.size(F.array_except("missing", F.array(*[F.lit(c) for c in optional]))) > 0)


def merge_duplicates(places: DataFrame, sessions: DataFrame, id: str = "place_id") -> tuple[DataFrame, DataFrame]:
    """Places without the rows whose country is spelled as the iso3 of another row of the name, and sessions moved to
    that row; rows of unknown country without sessions go too if their name is in another row."""
    pairs = places.alias("d").join(places.alias("k"), (F.col("d.city") == F.col("k.city")) & (F.col("d.country") == F.col("k.iso3")) & (F.col("d.country") != F.col("k.country")))
    moves = pairs.groupBy(F.col(f"d.{id}").alias("__from")).agg(F.min(f"k.{id}").alias("__to"))
    moved = sessions.join(moves, F.col(id) == F.col("__from"), "left").withColumn(id, F.coalesce("__to", id)).select(*sessions.columns)
    kept = places.join(moves, F.col(id) == F.col("__from"), "left_anti")
    several = places.groupBy("city").agg(F.count("*").alias("n")).filter("n > 1").select("city")
    empty = kept.filter(F.col("country") == "Unknown").join(several, "city", "left_semi").join(moved.select(id).distinct(), id, "left_anti").select(id)
    return kept.join(empty, id, "left_anti"), moved


def dedup_homonyms(places: DataFrame, id: str = "place_id", videos: str = "videos") -> DataFrame:
    """Of places with one folded name and iso3 (or country) the one with most videos; ties to the smaller id."""
    df = fold(places, "city").withColumn("__land", F.coalesce(F.nullif(F.col("iso3"), F.lit("")), F.col("country")))
    w = Window.partitionBy("name_key", "__land").orderBy(F.desc_nulls_last(videos), id)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "name_key", "__land")


def _grams(key: Column) -> Column:
    """Substrings of three letters; of a key so short that less than three can be more than half of it, also of one and two."""
    n = F.length(key)
    of = lambda q: F.when(n >= q, F.transform(F.sequence(F.lit(1), n - (q - 1)), lambda i: F.substring(key, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(n > 5, of(3)).otherwise(F.concat(of(1), of(2), of(3))))


def _contained(whole: DataFrame, whole_key: str, part: DataFrame, part_key: str) -> DataFrame:
    """Pairs of a country where the key of whole may contain that of part: they meet where the whole has the part's rarest
    substring of three letters, or all of a shorter part. A part with a substring that no whole of its country has meets none."""
    # Spark takes an exploded table for as small as the names, so it would broadcast it: hence the merge hints.
    left = whole.select("*", F.explode(_grams(F.col(whole_key))).alias("__g")).hint("merge")
    seen = left.groupBy("__c", "__g").agg(F.count("*").alias("__seen"))
    n = F.length(part_key)
    own = F.array_distinct(F.when(n < 3, F.array(F.col(part_key))).otherwise(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(F.col(part_key), i, F.lit(3)))))
    keys = part.select("__c", part_key).filter(n > 0).distinct().select("__c", part_key, F.explode(own).alias("__g"))
    rarest = keys.hint("merge").join(seen, ["__c", "__g"], "left").groupBy("__c", part_key).agg(F.min(F.struct(F.coalesce("__seen", F.lit(0)).alias("seen"), "__g")).alias("r"))
    blocked = part.hint("merge").join(rarest.filter("r.seen > 0").select("__c", part_key, F.col("r.__g").alias("__g")), ["__c", part_key])
    return left.join(blocked, ["__c", "__g"])


def repair_names(bad: DataFrame, clean_names: DataFrame, country: str = "country", least: float = 50.0) -> DataFrame:
    """place_id, city and repaired: a known name of the same country that equals the name, or its folded key, or has the
    best containment score (shorter over longer length times 100, above `least`, 50 or more) where one key contains the other.

    Names of a country meet where a folded key is equal, or where the rarest three letters of one, by their count among the
    others, are in the other: what lies within a key has all its letters there, so no pair is lost, and a beginning that
    many names share brings none together. Each different name of a country is matched once, however many rows have it."""
    if least < 50:
        raise ValueError("least must be 50 or more")
    rows = bad.select("place_id", "city", F.col(country).alias("__c"))
    a = fold(rows.select("city", "__c").distinct(), "city", "__a").withColumn("__na", F.length("__a"))
    b = fold(clean_names.select("city", F.col(country).alias("__c")).distinct(), "city", "__b").select(F.col("city").alias("repaired"), "__c", "__b").withColumn("__nb", F.length("__b"))
    same = a.hint("merge").join(b, (a["__c"] == b["__c"]) & (a["__a"] == b["__b"])).select(a["__c"], "city", "repaired", F.when(F.col("city") == F.col("repaired"), 300.0).otherwise(200.0).alias("score"))
    length = (F.col("__na") > 0) & (F.col("__nb") > 0) & (100.0 * F.least("__na", "__nb") / F.greatest("__na", "__nb") > least)
    score = (100.0 * F.least("__na", "__nb") / F.greatest("__na", "__nb")).alias("score")

    def inside(whole: DataFrame, whole_key: str, part: DataFrame, part_key: str) -> DataFrame:
        return _contained(whole, whole_key, part, part_key).filter((F.col("__a") != F.col("__b")) & length & F.contains(whole_key, part_key)).select("__c", "city", "repaired", score)

    scored = same.unionByName(inside(a, "__a", b, "__b")).unionByName(inside(b, "__b", a, "__a"))
    w = Window.partitionBy("__c", "city").orderBy(F.desc("score"), "repaired")
    best = scored.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select("__c", "city", "repaired", "score")
    one = rows.hint("merge").join(best, ["__c", "city"]).withColumn("__r", F.row_number().over(Window.partitionBy("place_id").orderBy(F.desc("score"), "repaired")))
    return one.filter("__r = 1").select("place_id", "city", "repaired", "score")


def country_codes(rows: DataFrame, countries: DataFrame, hint: str = "hint") -> DataFrame:
    """rows with iso2, iso3 and continent of the country that a hint names by iso2, iso3 or name (in this order, whatever
    the case); iso codes are NULL and the continent 'Unknown' where it names none.

    countries: name, iso2, iso3, continent."""
    ways = F.array(*[F.struct(F.lit(i).alias("way"), F.lower(F.trim(c)).alias("__key")) for i, c in enumerate(("iso2", "iso3", "name"))])
    keys = countries.select("iso2", "iso3", "continent", F.explode(ways).alias("w")).select("iso2", "iso3", "continent", "w.*").filter(F.col("__key") != "")
    one = keys.groupBy("__key").agg(F.min(F.struct("way", "iso2", "iso3", "continent")).alias("__c"))
    df = rows.join(one, F.lower(F.trim(hint)) == F.col("__key"), "left")
    unknown = F.coalesce(F.nullif(F.col("__c.continent"), F.lit("")), F.lit("Unknown"))
    return df.select(*rows.columns, F.col("__c.iso2").alias("iso2"), F.col("__c.iso3").alias("iso3"), unknown.alias("continent"))


#: Fields that a match fills if it has them, and fields that it decides.
FILLED, DECIDED = ["state", "country", "iso3", "population"], ["continent", "latitude", "longitude"]


def fill_from_match(places: DataFrame, matches: DataFrame, key: str = "place_id") -> DataFrame:
    """places with what the place-name service found: FILLED fields where the match has a value, DECIDED fields as the
    match has them; places without a match stay as they are. matches: one row a key."""
    found = matches.select(F.col(key).alias("__key"), *[F.col(x).alias(f"__{x}") for x in FILLED + DECIDED])
    df = places.join(found, F.col(key) == F.col("__key"), "left")
    hit = F.col("__key").isNotNull()
    cols = {x: F.coalesce(f"__{x}", x) for x in FILLED} | {x: F.when(hit, F.col(f"__{x}")).otherwise(F.col(x)) for x in DECIDED}
    return df.withColumns(cols).select(*places.columns)
