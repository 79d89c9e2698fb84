import pytest
from pyspark.sql import functions as F

from strideline.operators import api, mixes, rollup
from strideline.plans.adapters import FLAGS, Data
from strideline.plans import driver


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    return Data(spark, sf_dir)


def details(data, place=None, **changes):
    ages = data.sessions.select("place_id", F.lit(30.0).alias("avg_age")).distinct()
    ranks = driver.rank_base(data).select("place_id", "avg_speed")
    given = {"averages": ranks, "stored_ranks": ranks, "stored_ages": ages, "flags": FLAGS, "place": place} | changes
    return api.city_details(data.sessions, data.observations, **given)


def test_details_of_one_place(data):
    place = data.sessions.first()["place_id"]
    panels = details(data, place)
    got = {k: df.collect() for k, df in panels.items()}
    assert set(got) == {"ranks", "weather", "daytime", "gender", "vehicles", "risk_by_age", "risk_factors", "age", "measured"}
    assert got["ranks"][0]["place_id"] == place and all(r["place_id"] == place for rows in got.values() for r in rows)
    for k in ("weather", "gender", "daytime"):
        assert not got[k] or abs(sum(r["percent"] for r in got[k]) - 100) < 1e-9
    rows = api.details_rows(panels).collect()
    assert {r["panel"] for r in rows} == {k for k, v in got.items() if v} and {r["place_id"] for r in rows} == {place}


@pytest.mark.parametrize("panel, layers", [("ranks", {"stored", "counted"}), ("weather", {"sessions", "observations"}), ("age", {"summary", "observations", "buckets"})])
def test_every_fallback_is_used_by_the_registered_query(spark, sf_dir, panel, layers):
    rows = driver.queries()["city_details"](spark, sf_dir).filter(F.col("panel") == panel).collect()
    assert {r["layer"] for r in rows} == layers
    told = {}
    for r in rows:
        told.setdefault(r["place_id"], set()).add(r["layer"])
    assert all(len(x) == 1 for x in told.values())


def test_a_place_without_stored_rank_is_counted_among_all(data):
    averages = driver.rank_base(data).select("place_id", "avg_speed")
    place = averages.filter("avg_speed IS NOT NULL").first()
    row = details(data, place["place_id"], averages=averages, stored_ranks=averages.limit(0))["ranks"].collect()[0]
    assert row["layer"] == "counted" and row["avg_speed"] == averages.filter(F.col("avg_speed") > place["avg_speed"]).count() + 1


def test_bucket_ages(spark):
    rows = spark.createDataFrame([(1, "Under 18", 1), (1, "50+", 3), (2, "other", 4)], "place_id int, bucket string, n long")
    assert [tuple(r) for r in mixes.average_of_buckets(rows).collect()] == [(1, (15 + 180) / 4)]


def test_lists_and_series(data, spark):
    s = driver.summary(data)
    assert api.city_list(s, "customer", None, 3).count() == 3 and api.city_list(s, "no such").count() == 0
    with pytest.raises(ValueError):
        api.city_compare(s, s, "2024-13-01", "2024-12-31", [], [])
    place = data.sessions.filter("risky_ratio IS NOT NULL").first()
    end = place["collected"].strftime("%Y-%m")
    rows = api.metric_series(data.sessions, data.observations, place["place_id"], "avg_crossing_speed", end, 6).collect()
    assert 1 <= len(rows) <= 6


def test_stored_insights_routes_and_appends(spark):
    df = spark.createDataFrame([(1, "A", '[{"id":"x","category":"speed","text":"t","relevance_score":"0.9"},{"id":"y","category":"meta","text":"t","relevance_score":"1"}]'), (2, "B", "{}"), (3, "C", '[{"id":"z","category":null,"text":"t","relevance_score":"high"}]')], "place_id int, city string, insights string")
    assert [r["id"] for r in api.top_stored_insights(df).collect()] == ["x"]
    r = spark.createDataFrame([("v", [[1.0, 2.0], [3.0, 4.0]])], "link string, route array<array<double>>")
    assert [tuple(x) for x in api.route_points(r).collect()] == [("v", 0, 1.0, 2.0), ("v", 1, 3.0, 4.0)]
    t = spark.createDataFrame([("Rain", "1")], "weather string, n string")
    assert [x["weather"] for x in api.append_categories(t, spark.createDataFrame([("1", "true")], "Rain string, Fog string"), ["Rain", "Fog"]).collect()] == ["Fog"]
    assert [tuple(x) for x in api.append_categories(t, spark.createDataFrame([("Snow", "2"), ("Rain", "3")], "Weather string, count string"), renames={"count": "n"}).collect()] == [("Snow", "2")]


def test_observations_that_know_their_place_give_the_same_panels_without_a_join(data):
    """Also dealt to tasks: then no panel's rows are as many in a task as Spark finds small enough."""
    ages, ranks = data.sessions.select("place_id", F.lit(30.0).alias("avg_age")).distinct(), driver.rank_base(data).select("place_id", "avg_speed")
    seen = F.when(F.col("crosswalk"), "Sunny").otherwise("dusk")
    panels = lambda o, **more: api.city_details(data.sessions, o, ranks, ranks, ages, FLAGS, seen, **more)
    placed = rollup.of_places(data.observations, data.sessions.select("session_id", "place_id"), 3).localCheckpoint()
    one, other = panels(data.observations), panels(placed, tasks=5)
    rows = lambda found: sorted(map(repr, api.details_rows(found).collect()))
    assert rows(one) == rows(other)
    assert all(other[x].rdd.getNumPartitions() % 5 == 0 for x in ("ranks", "weather", "gender", "age"))
    assert "Join" not in other["gender"]._jdf.queryExecution().optimizedPlan().toString()


def test_flags_are_put_in_order_without_a_sort_across_places(spark):
    df = spark.createDataFrame([(1, 3, 0, 3, 9), (2, 0, 0, 0, 0), (3, 0, 1, 0, 0)], "place_id long, b long, c long, a long, d long")
    out = mixes.flag_mix(df, "place_id", ["b", "c", "a", "d"], 2)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", 3, 20.0, 2), (1, "d", 9, 60.0, 1), (3, "c", 1, 100.0, 1)]
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
