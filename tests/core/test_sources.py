import json

import pytest
from pyspark.sql import functions as F

from strideline.operators import facts, places as place_ops
from strideline.sources import readers, writers


def test_csv_of_two_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("city,n\nMünchen,1\n\n\"São, \"\"x\"\"\",2\n".encode())
    (tmp_path / "b.csv").write_bytes("city,n\nZürich,3\n".encode("latin-1"))
    got = sorted((r["city"], r["n"]) for r in readers.read_csv(spark, str(tmp_path)).collect())
    assert got == [("München", "1"), ('São, "x"', "2"), ("Zürich", "3")]
    assert readers.read_csv_best_encoding(spark, str(tmp_path / "b.csv")).first()["city"] == "Zürich"


def test_headers_and_routing(spark, tmp_path):
    for place, file, head in (("Rome", "x.csv", "Gender,risky"), ("Rome", "[A1]x.csv", "a"), ("Oslo", "y.csv", "weather,daytime,z")):
        (tmp_path / "in" / place).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / place / file).write_text(f"{head}\n1,2\n")
    lines = readers.scan_place_folders(spark, str(tmp_path / "in"))
    assert {(r["place"], r["file"]) for r in lines.collect()} == {("Rome", "x.csv"), ("Oslo", "y.csv")}
    heads = readers.list_headers(spark, str(tmp_path / "in"))
    target = spark.createDataFrame([("gender_stats", ["gender", "risky"])], "path string, headers array<string>")
    matched = readers.match_headers(heads, target)
    manual = spark.createDataFrame([], "path string, target string")
    got = {r["path"].split("/")[-1]: r["target"] for r in readers.route_files(heads, manual, matched).collect()}
    assert got["x.csv"] == "gender_stats" and got["y.csv"] == "weather_daytime_stats"


def test_localizations_and_aliases(spark, tmp_path):
    (tmp_path / "l.csv").write_text('link,status,source,lat,lon,confidence_level,confidence_spread_m,street_names,candidates,route_latlon,route_length_m\nv1,ok,s,10.5,20,high,5,Main,"[{""rank"":1,""latitude"":1.0}]","[[1,2],[3,4]]",12\nv2,failed,s,999,20,,,,{},[],\n')
    got = {r["link"]: r for r in readers.read_localizations(spark, str(tmp_path / "l.csv")).collect()}
    assert got["v1"]["candidates"][0]["rank"] == 1 and len(got["v1"]["route"]) == 2 and got["v2"]["latitude"] is None and got["v2"]["candidates"] is None
    (tmp_path / "a.json").write_text(json.dumps({"_comment": "x", "Bombay": "Mumbai"}))
    assert [tuple(r) for r in readers.read_aliases(spark, str(tmp_path / "a.json")).collect()] == [("Bombay", "Mumbai")]


def test_reshaping(spark):
    df = spark.createDataFrame([("True", "0"), ("no", "0")], "Rain string, Snow string")
    assert [r["w"] for r in readers.flags_to_categories(df, ["Rain", "Snow"], "w").collect()] == ["Rain"]
    assert readers.realign(df, ["rain", "wind"]).columns == ["rain", "wind"] and readers.realign(df, ["rain", "wind"]).first()["wind"] == ""
    one = readers.single_valued(spark.createDataFrame([("a", "1", "x"), ("a", "1", "y")], "d string, p string, q string"), "d").first()
    assert (one["p"], one["q"]) == ("1", "")


def test_csv_written_and_read_again(spark, tmp_path):
    df = spark.createDataFrame([("a, \"b\"\nc", "")], "x string, y string")
    writers.write_csv(df, str(tmp_path / "o"))
    assert readers.read_csv(spark, str(tmp_path / "o"), "*.csv").first()["x"] == "a, \"b\"\nc"


def test_gazetteer_export_and_snapshots(spark, tmp_path):
    p = spark.createDataFrame([(1, "São Paulo", "Brazil", "BRA", "SA", 1.23456789, 2.0, 5), (2, "Sao Paulo", "Brazil", "BRA", "SA", 1.0, 2.0, 9), (3, "X", "Unknown", "", "SA", 1.0, 1.0, 1)], "place_id int, city string, country string, iso3 string, continent string, latitude double, longitude double, videos int")
    a = spark.createDataFrame([("Sampa", "são paulo"), ("Q", "X")], "alias string, name string")
    kept, aliases = writers.export_gazetteer(p, a)
    assert [r["place_id"] for r in kept.collect()] == [2] and [r["alias"] for r in aliases.collect()] == ["Sampa"]
    tables = writers.refresh_snapshots(spark, str(tmp_path), {"snap_a": lambda s: s.range(3), "snap_b": lambda s: s.table("snap_a").filter("id > 0")})
    assert tables["snap_b"].count() == 2


def test_publish_runs_every_step_on_the_last_ones_snapshot(spark, tmp_path):
    places = spark.createDataFrame([(1, "A"), (2, "B")], "place_id long, city string")
    kind = "session_id long, link string, place_id long, speed double, status string, latitude double"
    old = spark.createDataFrame([(1, "u", 1, 2.0, "none", None)], kind)
    new = spark.createDataFrame([(None, "u", 1, 4.0, "none", None), (2, "v", 2, 8.0, "none", None)], kind)
    found = spark.createDataFrame([("v", "ok", 5.0, 6.0)], "link string, status string, latitude double, longitude double")

    def summarize(p, s):
        return p.join(s.groupBy("place_id").agg(F.avg("speed").alias("speed"), F.max("latitude").alias("latitude")), "place_id", "left")

    def describe(p, s):
        return s.filter("speed > 5").select("place_id", F.lit(1).alias("position"), F.lit("fast").alias("category"), F.lit("x").alias("text"))

    out = writers.publish(spark, str(tmp_path), places, old, new, found, ["latitude"], summarize, describe)
    assert list(out) == ["sessions", "located", "summary", "insights", "published"]
    rows = {r["city"]: r for r in out["published"].collect()}
    assert (rows["A"]["speed"], rows["A"]["latitude"], rows["A"]["insights"]) == (4.0, None, [])
    assert (rows["B"]["speed"], rows["B"]["latitude"], rows["B"]["insights"][0]["category"]) == (8.0, 5.0, "fast")
    assert sorted(r["session_id"] for r in out["sessions"].collect()) == [1, 2]


def test_world_places_and_homonyms(spark, tmp_path):
    (tmp_path / "w.csv").write_text("name,country,population,latitude,longitude\nParis,France,2000000,48.8,2.3\nPARIS,United States,25000,33.6,-95.5\nParis,France,10,1,1\n,Nowhere,1,1,1\nLost,X,5,99,0\n", encoding="utf-8")
    world = readers.read_world_places(spark, str(tmp_path / "w.csv"))
    assert sorted((r["name"], r["country"], r["population"], r["videos"]) for r in world.collect()) == [("PARIS", "United States", 25000, 0), ("Paris", "France", 2000000, 0)]
    assert [(r["name_key"], [p["country"] for p in r["places"]]) for r in readers.homonyms(world).collect()] == [("paris", ["France", "United States"])]


def test_columns_go_by_name_across_files(spark, tmp_path):
    for name, text in (("a", "a,b\n1,2\n"), ("b", "b,a\n2,1\n"), ("c", "\ufeffa,c\n1,3\n"), ("d", "a,b\n5,6\n")):
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    rows = sorted((r["a"], r["b"] or "", r["c"] or "") for r in readers.read_csv(spark, str(tmp_path)).collect())
    assert rows == [("1", "", "3"), ("1", "2", ""), ("1", "2", ""), ("5", "6", "")]


def test_long_and_quoted_headers(spark, tmp_path):
    names = [f"column_{i:05d}" for i in range(9000)]
    (tmp_path / "long.csv").write_text(",".join(names) + "\n1\n", encoding="utf-8")
    (tmp_path / "q.csv").write_bytes(b'"x, y","Say ""hi""",Z\xfc\r\n1,2,3\n')
    got = {r["path"].rsplit("/", 1)[1]: r["headers"] for r in readers.list_headers(spark, str(tmp_path)).collect()}
    assert got["long.csv"] == names and got["q.csv"] == ['say "hi"', "x, y", "zü"]


def test_gazetteer_documents(spark, tmp_path):
    doc = {"cities": [{"city": "Paris", "country": "France", "iso3": "FRA", "continent": "Europe", "latitude": 48.8, "longitude": 2.3, "population_city": 2000000, "video_count": 7}, {"city": "Paris", "country": "United States", "iso3": "USA"}, {"city": "?"}], "aliases": {"Lutetia": "Paris", "!": "Paris", "City of Light": "Paris"}}
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "g" / "b.json").write_text(json.dumps({"cities": [{"city": "Oslo", "country": "Norway"}]}))
    more = spark.createDataFrame([("lutetia!", "Oslo")], "alias string, name string")
    places, aliases = readers.read_gazetteer(spark, str(tmp_path / "g"), more)
    assert sorted((r["name"], r["country"], r["population"], r["videos"]) for r in places.collect()) == [("Oslo", "Norway", None, 0), ("Paris", "France", 2000000, 7), ("Paris", "United States", None, 0)]
    assert sorted(map(tuple, aliases.collect())) == [("City of Light", "Paris"), ("lutetia!", "Oslo")]
    inputs = spark.createDataFrame([(1, "PARIS", None, "usa"), (2, "city of light", None, None), (3, "Lutetia", None, None)], "input_id int, name string, country string, iso3 string")
    world = places.limit(0)
    got = {r["input_id"]: (r["c_name"], r["c_country"], r["confident"]) for r in place_ops.resolve(inputs, places, aliases, world).collect()}
    assert got == {1: ("Paris", "United States", True), 2: ("Paris", "France", False), 3: ("Oslo", "Norway", True)}


def test_statistics_by_name_with_rejects(spark, tmp_path):
    (tmp_path / "gender_stats.csv").write_text("gender,risky_crossing,run_red_light,more\nmale,0.5,,x\nfemale,often,0.25,y\n")
    (tmp_path / "time_stats.csv").write_text("index,duration_minutes\nmean,27.8\n")
    (tmp_path / "other.csv").write_text("a\n1\n")
    assert readers.read_category_stats(spark, str(tmp_path), "gender_stats").columns[-1] == "source_file"
    good, bad = facts.load_stats(spark, str(tmp_path))
    assert sorted((r["data_source"], r["source_file"], r["metric_name"], r["dimension_value"], r["value_numeric"]) for r in good.collect()) == [
        ("gender_stats", "gender_stats.csv", "risky_crossing_rate", "male", 0.5), ("gender_stats", "gender_stats.csv", "run_red_light_rate", "female", 0.25), ("time_stats", "time_stats.csv", "duration_minutes", "mean", 27.8)]
    assert [tuple(r) for r in bad.collect()] == [("gender_stats", "gender_stats.csv", "female", "risky_crossing", "often")]
    with pytest.raises(FileNotFoundError):
        facts.load_stats(spark, str(tmp_path), ["age_stats"])


def test_dimension_ids_are_looked_up_or_made(spark):
    f = facts.melt(spark.createDataFrame([("male", "1"), ("other", "2")], "gender string, risky_crossing string"), "gender_stats", facts.MELTS["gender_stats"])
    known = facts.dimensions(f, spark.createDataFrame([("gender", "male", 7)], "dimension_type string, dimension_value string, dimension_id long"))
    with_ids = facts.keyed(f, known)
    assert "dimension_value" not in with_ids.columns
    view = {r["value_numeric"]: r for r in facts.analytics_summary(with_ids, known.filter("dimension_value = 'male'")).collect()}
    assert (view[1.0]["dimension_id"], view[1.0]["dimension_value"]) == (7, "male")
    assert view[2.0]["dimension_id"] is not None and view[2.0]["dimension_value"] is None


def test_all_columns_are_normalized_in_one_crossing(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a,b c,d\ne\u0301,,o\u0308\n", encoding="utf-8")
    df = readers.read_csv(spark, str(tmp_path))
    assert tuple(df.drop("source_file").first()) == ("\u00e9", None, "\u00f6") and df.columns == ["a", "b c", "d", "source_file"]
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
