from pyspark.sql import functions as F

from strideline.functions import clean, measures as m


def values(spark, fn, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_numbers(spark):
    assert values(spark, clean.safe_numeric, ["12.5abc", "", None, "abc", "-3", " 7e2x", ".5", "5."]) == [12.5, None, None, None, -3.0, 700.0, 0.5, 5.0]
    assert values(spark, clean.strict_numeric, ["12.5abc", "12.5", ""]) == [None, 12.5, None]
    assert values(spark, clean.safe_integer, ["23.7", "x", "-4abc", None]) == [23, None, -4, None]


def test_booleans(spark):
    assert values(spark, clean.case_boolean, ["1", "true", "yes", "True", "maybe", "", None]) == [True, True, True, False, False, None, None]
    assert values(spark, clean.tri_boolean, ["YES", "False", "maybe", None]) == [True, False, None, None]
    assert values(spark, clean.loose_true, ["True", "1", "yes", None]) == [True, True, False, False]


def test_ages_and_buckets(spark):
    assert values(spark, clean.safe_age, ["30", "Age(20)-(29)", "18-25", "-5", "old", "0"]) == [30, 25, 22, None, None, None]
    assert values(spark, clean.age_bucket, [17, 18, 30, 31, 65, 66, None], "int") == ["under_18", "18_30", "18_30", "31_50", "51_65", "over_65", None]
    assert values(spark, clean.age_detail, [17, 50, 51, None], "int") == ["Under 18", "31-50", "50+", None]
    assert values(spark, clean.age_effect_group, [17, 18, 31, 51], "int") == [None, "18-30", "31-50", "51+"]


def test_names(spark):
    assert values(spark, clean.normalize_name, ["Łódź", "São Paulo", "New-York", "Straße", None, "東京", "ÆØ"]) == ["lodz", "saopaulo", "newyork", "strasse", "", "", "aeo"]
    assert values(spark, clean.nfc, ["é", None]) == ["é", None]
    assert values(spark, lambda s: clean.fix_mojibake(s, {"Bogot?": "Bogotá"}, {"Ã©": "é"}), ["Bogot?", "MontrÃ©al", None]) == ["Bogotá", "Montréal", None]
    assert values(spark, clean.is_corrupted, ["a?", "b®", "ok"]) == [True, True, False]


def test_json_and_coordinates(spark):
    assert values(spark, lambda s: clean.parse_json_array(s, "int"), ["[1,2]", "[]", "{}", "oops", None]) == [[1, 2], None, None, None, None]
    assert values(spark, clean.parse_route, ["[[1,2],[3,4]]", "[[1,2]]", "[[1,2],[99,4],[5,6]]", "{}"]) == [[[1, 2], [3, 4]], None, [[1, 2], [5, 6]], None]
    assert values(spark, lambda s: clean.parse_coord(s, -90, 90), ["45.5N", "91", ""]) == [45.5, None, None]
    assert [str(x) if x else None for x in values(spark, clean.parse_date, ["2024-02-29", "2023-02-29", "x"])] == ["2024-02-29", None, None]


def test_texts(spark):
    assert values(spark, clean.format_daytime, ["1", "0", "", None, "dusk"]) == ["Day", "Night", "Unknown", "Unknown", "Dusk"]
    assert values(spark, clean.clean_string, [" a ", " ", None]) == ["a", None, None]
    assert values(spark, clean.is_missing_text, ["", "Unknown", "x", None]) == [True, True, False, True]


def test_similarity(spark):
    df = spark.createDataFrame([("", ""), ("abc", "abd"), ("a", "xyz")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(clean.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.6667, 0.0]


def test_measures_keep_null_apart_from_zero(spark):
    df = spark.createDataFrame([(1, 2.0, 3, True), (2, None, 100, None), (3, 4.0, 100, False)], "i int, x double, n int, b boolean")
    r = df.agg(m.mean(F.col("x")).alias("mean"), m.weighted_mean(F.col("x"), F.col("n")).alias("w"), m.pooled_rate(F.col("b"), F.col("i")).alias("rate"), m.exposure_rate(F.col("x"), F.col("n")).alias("e")).first()
    assert r["mean"] == 3.0 and abs(r["w"] - (6 + 400) / 103) < 1e-12 and abs(r["rate"] - 1 / 3) < 1e-12 and abs(r["e"] - 600 / 103) < 1e-12
    empty = df.filter("false").agg(m.mean(F.col("x")).alias("a"), m.pooled_rate(F.col("b"), F.col("i")).alias("b")).first()
    assert empty["a"] is None and empty["b"] is None
    d = spark.createDataFrame([(5.0, 4.0), (5.0, 0.0), (None, 4.0)], "v double, g double").select(m.delta_percent(F.col("v"), F.col("g"))).collect()
    assert [x[0] for x in d] == [25.0, None, None]
    t = spark.createDataFrame([(5.0, 0.0, 10.0), (5.0, 5.0, 5.0), (99.0, 0.0, 10.0), (None, 0.0, 1.0)], "v double, a double, b double")
    assert [x[0] for x in t.select(m.safe_normalize(*map(F.col, "vab"))).collect()] == [0.5, 0.5, 1.0, 0.5]
