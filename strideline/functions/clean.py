"""Cleaning of text values: casts, names, dates, coordinates, JSON. Column in, Column out; NULL stays NULL unless said."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Letters that decomposition leaves whole.
SPECIAL_LETTERS = {"ł": "l", "đ": "d", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ħ": "h", "ı": "i", "ĸ": "k", "ŋ": "n"}


def safe_numeric(s: Column) -> Column:
    """The number at the start of a text: '12.5abc' is 12.5; NULL without one."""
    return F.regexp_extract(s, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double")


def strict_numeric(s: Column) -> Column:
    return s.try_cast("double")


def safe_integer(s: Column) -> Column:
    """The integer at the start of a text, truncated: '23.7' is 23."""
    return F.regexp_extract(s, r"^\s*([-+]?\d+)", 1).try_cast("int")


def case_boolean(s: Column) -> Column:
    """'1', 'true' and 'yes' are true, '' is NULL, anything else, 'True' too, is false."""
    return F.when(s.isNull() | (s == ""), F.lit(None).cast("boolean")).otherwise(s.isin("1", "true", "yes"))


def tri_boolean(s: Column) -> Column:
    """1/true/yes and 0/false/no in any case, else NULL."""
    low = F.lower(s)
    return F.when(low.isin("1", "true", "yes"), True).when(low.isin("0", "false", "no"), False)


def loose_true(s: Column) -> Column:
    return F.coalesce(F.lower(s).isin("true", "1"), F.lit(False))


def safe_age(s: Column) -> Column:
    """A positive integer at the start, or the rounded middle of 'Age(a)-(b)' or 'a-b'; else NULL."""
    between = r"^\s*(?:Age)?\(?(\d+)\)?\s*-\s*\(?(\d+)\)?"
    low, high = (F.regexp_extract(s, between, i).try_cast("int") for i in (1, 2))
    single = safe_integer(s)
    return F.when(low.isNotNull() & high.isNotNull(), F.floor((low + high) / 2 + 0.5).cast("int")).when(single > 0, single)


def clean_string(s: Column) -> Column:
    return F.nullif(F.trim(s), F.lit(""))


def parse_coord(s: Column, low: float, high: float) -> Column:
    n = safe_numeric(s)
    return F.when(n.between(low, high), n)


def parse_date(s: Column) -> Column:
    return F.substring(F.trim(s), 1, 10).try_cast("date")


def _normalizer(form: str):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    return run


def nfc(s: Column) -> Column:
    """Unicode NFC; Spark has no built-in, so batches go through Arrow."""
    return _normalizer("NFC")(s)


def nfc_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df with these text columns in Unicode NFC; all of them cross to Python once, together."""
    @F.pandas_udf(StructType([StructField(f"c{i}", StringType()) for i in range(len(names))]))
    def run(texts: pd.DataFrame) -> pd.DataFrame:
        return texts.apply(lambda s: s.str.normalize("NFC"))

    if not names:
        return df
    packed = df.withColumn("__nfc", run(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])))
    at = {c: i for i, c in enumerate(names)}
    return packed.select(*[F.col(f"__nfc.c{at[c]}").alias(c) if c in at else F.col(f"`{c}`") for c in df.columns])


def _decomposed() -> tuple[str, str]:
    """Latin letters with accents and the letters below them, made from Unicode's own decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs += [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0x1E00, 0x1F00)]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normalize_name(s: Column) -> Column:
    """The comparison key of a name: lower case, special letters spelled out, accents dropped, only a-z and 0-9 kept.

    Accents of Latin letters are dropped by one translate, so the key stays in generated code. NULL is ''."""
    out = F.lower(F.coalesce(s, F.lit("")))
    for letter, base in SPECIAL_LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(base))
    accented, plain = _decomposed()
    return F.regexp_replace(F.translate(out, accented, plain), r"[^a-z0-9]+", "")


def fix_mojibake(s: Column, whole: dict[str, str], parts: dict[str, str]) -> Column:
    """A whole-string correction first, then every partial one."""
    out = s
    for bad, good in parts.items():
        out = F.replace(out, F.lit(bad), F.lit(good))
    if not whole:
        return out
    table = F.create_map(*[F.lit(x) for pair in whole.items() for x in pair])
    return F.coalesce(F.try_element_at(table, s), out)


def is_corrupted(s: Column) -> Column:
    return s.rlike("[?®¨]")


def age_bucket(age: Column) -> Column:
    return F.when(age < 18, "under_18").when(age <= 30, "18_30").when(age <= 50, "31_50").when(age <= 65, "51_65").when(age > 65, "over_65")


def age_detail(age: Column) -> Column:
    return F.when(age < 18, "Under 18").when(age <= 30, "18-30").when(age <= 50, "31-50").when(age.isNotNull(), "50+")


def age_effect_group(age: Column) -> Column:
    """Ages below 18 are in no group."""
    return F.when(age.between(18, 30), "18-30").when(age.between(31, 50), "31-50").when(age >= 51, "51+")


def capitalise_first(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 2**31 - 1))


def format_daytime(s: Column) -> Column:
    return F.when(s == "1", "Day").when(s == "0", "Night").when(s.isNull() | (s == ""), "Unknown").otherwise(capitalise_first(s))


def parse_json_array(s: Column, element: str) -> Column:
    """An array from JSON text; NULL if it isn't an array, is empty or can't be parsed."""
    parsed = F.when(F.ltrim(s).startswith("["), F.from_json(s, f"array<{element}>"))
    return F.when(F.size(parsed) > 0, parsed)


def parse_route(s: Column) -> Column:
    """Points (latitude, longitude) that are whole and in range; NULL with fewer than two."""
    good = lambda p: (F.size(p) >= 2) & p[0].between(-90, 90) & p[1].between(-180, 180)
    points = F.filter(parse_json_array(s, "array<double>"), lambda p: F.coalesce(good(p), F.lit(False)))
    return F.when(F.size(points) >= 2, points)


def is_missing_text(s: Column) -> Column:
    return s.isNull() | s.isin("", "Unknown")


def is_missing_number(n: Column) -> Column:
    """0 counts as missing."""
    return n.isNull() | (n == 0)


def effective_date(collected: Column, imported: Column, created: Column) -> Column:
    """The month a row belongs to."""
    return F.trunc(F.coalesce(collected, imported.cast("date"), created.cast("date")), "month")


def similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, falling with edit distance to 0."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise((longest - F.levenshtein(a, b)) / longest)


def month_label(day: Column) -> Column:
    """The label of a month on a chart, as 'Jan 1997'."""
    return F.date_format(day, "MMM yyyy")
