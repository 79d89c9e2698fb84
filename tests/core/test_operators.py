import pytest
from pyspark.sql import functions as F

from strideline.functions import clean
from strideline.operators import asof, effects, facts, filters, insights, merge, mixes, places, rank, reports, rollup

c = F.col


@pytest.fixture(scope="module")
def city(spark):
    p = spark.createDataFrame([(1, "A", "X"), (2, "B", "X"), (3, "C", None)], "place_id long, city string, continent string")
    s = spark.createDataFrame([(10, 1, 2.0), (11, 1, 4.0), (12, 2, None)], "session_id long, place_id long, speed double")
    o = spark.createDataFrame([(10, i, True) for i in range(1)] + [(11, i, i % 4 == 0) for i in range(100)], "session_id long, track long, risky boolean")
    return p, s, o


def test_sessions_are_not_weighted_by_their_observations(city):
    p, s, o = city
    got = {r["place_id"]: r for r in rollup.place_summary(p, s, o, {"avg_speed": F.avg("speed"), "n_sessions": F.count("*")}, {"n": F.count("*"), "r": F.count_if("risky")}, {"n_people": c("n"), "rate": c("r") / c("n")}, ["n_sessions", "n_people"]).collect()}
    assert got[1]["avg_speed"] == 3.0 and got[1]["n_people"] == 101 and abs(got[1]["rate"] - 26 / 101) < 1e-12
    assert got[2]["n_people"] == 0 and got[2]["avg_speed"] is None and got[3]["n_sessions"] == 0
    wrong = rollup.fanout_summary(p, s, o, {"avg_speed": F.avg("speed")}, ["place_id"]).filter("place_id = 1").first()
    assert wrong["avg_speed"] != 3.0


def test_ranks_put_nulls_last_and_measured_ranks_leave_them_out(spark):
    df = spark.createDataFrame([(1, 5.0, "X"), (2, 5.0, "X"), (3, None, "Y"), (4, 1.0, None)], "place_id int, v double, g string")
    got = {r["place_id"]: r for r in rollup.peers(rollup.ranked(df, {"r": "v"}, {"p": "v"}, {"m": "v"}, {"w": ("v", "g")}), "n", "g").collect()}
    assert [got[i]["r"] for i in (1, 2, 3, 4)] == [1, 1, 4, 3] and got[3]["m"] is None and got[4]["m"] == 3
    assert got[4]["p"] == 0.0 and got[3]["p"] == 1.0 and got[4]["n"] == 0 and got[1]["n"] == 2


def test_gate_is_closed_for_small_and_unknown_samples(spark):
    rows = [(i, float(i), n) for i, n in enumerate([30, 29, None, 31, 40, 50, 60])]
    df = spark.createDataFrame(rows, "place_id int, v double, n int")
    metric = rank.Metric("v", "", "n", 30, True)
    board = rank.leaderboard(df, metric).collect()
    assert [r["place_id"] for r in board] == [6, 5, 4, 3, 0] and [r["position"] for r in board] == [1, 2, 3, 4, 5]
    scale = rank.rank_scale(df, metric).first()
    assert (scale["n_ranked"], scale["low"], scale["high"]) == (5, 0.0, 6.0)
    few = rank.rank_scale(df.filter("place_id < 5"), metric).first()
    assert few["low"] is None and few["n_ranked"] == 3
    rows = {r["place_id"]: r for r in rank.layer_rows(df, metric).collect()}
    assert rows[1]["evidence"] == "below_bar" and rows[2]["evidence"] == "unknown" and rows[6]["t"] == 1.0 and rows[1]["t"] is None
    with pytest.raises(ValueError):
        rank.top_by_rank(df, "nope", 3, ("v",))


def test_extremes_ignore_zero(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 2.0), ("c", 9.0), ("d", None)], "city string, v double")
    r = rank.extremes(df, ["v"]).first()
    assert (r["top_name"], r["bottom_name"]) == ("c", "b")


def test_as_of_midnight_and_comparison(spark):
    df = spark.sql("SELECT * FROM VALUES (1, DATE'2024-01-01', TIMESTAMP'2024-01-02 00:00:00'), (2, DATE'2024-01-01', TIMESTAMP'2024-01-02 09:00:00'), (3, NULL, NULL), (4, DATE'2024-01-03', NULL) AS t(i, collected, imported)")
    assert sorted(r["i"] for r in df.filter(asof.known_at("2024-01-02")).collect()) == [1, 3]
    a = spark.createDataFrame([("A", 5, 2.0), ("B", 1, 1.0)], "city string, n long, v double")
    b = spark.createDataFrame([("A", 3, None)], "city string, n long, v double")
    got = {r["city"]: r for r in asof.compare(a, b, ["city"], ["n"], ["v"], "2024-01-01", "2024-01-31").collect()}
    assert got["A"]["change_n"] == 2 and got["A"]["change_v"] is None and got["B"]["change_n"] == 1 and got["A"]["period_days"] == 30


def test_series_fills_forward_and_drops_leading_gaps(spark):
    v = spark.sql("SELECT * FROM VALUES (DATE'2024-02-01', 1.0D), (DATE'2024-04-01', 3.0D) AS t(month, value)")
    got = [(str(r["month"]), r["value"]) for r in asof.monthly_series(v, "2024-01-01", "2024-05-01").orderBy("month").collect()]
    assert got == [("2024-02-01", 1.0), ("2024-03-01", 1.0), ("2024-04-01", 3.0), ("2024-05-01", 3.0)]


def test_mix_percentages_sum_to_100(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, ""), (1, None), (2, "c")], "place_id int, w string")
    got = mixes.mix(df, "place_id", c("w")).collect()
    assert abs(sum(r["percent"] for r in got if r["place_id"] == 1) - 100) < 1e-9 and len(got) == 3


def test_merge_policies(spark):
    s = "link string, id int, a int, b int, c int"
    old = spark.createDataFrame([("x", 1, 1, 1, None), ("y", 2, 5, 5, 5)], s)
    new = spark.createDataFrame([("x", 9, None, None, 7), ("z", 3, 4, 4, 4)], s)
    got = {r["link"]: tuple(r)[1:] for r in merge.merge(old, new, ["link"], {"id": merge.OLD, "b": merge.NEW_OR_OLD, "c": merge.OLD_OR_NEW}).collect()}
    assert got == {"x": (1, None, 1, 7), "y": (2, 5, 5, 5), "z": (3, 4, 4, 4)}
    same = merge.merge(old, new, ["link"], {}).collect()
    twice = merge.merge(merge.merge(old, new, ["link"], {}), new, ["link"], {}).collect()
    assert sorted(same) == sorted(twice)


def test_upserts(spark):
    old = spark.createDataFrame([("x", "2020-01-01", 1)], "link string, collected string, n int").withColumns({"batch": F.lit("b0"), "first_imported": F.lit("2020-01-01").cast("timestamp"), "last_updated": F.lit("2020-01-01").cast("timestamp")})
    new = spark.createDataFrame([("x", None, 2, 1), ("x", None, 3, 2), ("w", "2021-01-01", 9, 3)], "link string, collected string, n int, o int")
    got = {r["link"]: r for r in merge.upsert_sessions(old, new, ["o"], "b1", "2022-01-01 00:00:00").collect()}
    assert got["x"]["n"] == 3 and got["x"]["collected"] == "2020-01-01" and got["x"]["batch"] == "b1" and got["x"]["first_imported"].year == 2020 and got["x"]["last_updated"].year == 2022
    b = merge.finalize_batches(merge.start_batch(spark, "b1", "2022-01-01 00:00:00", {"files": "a.csv, b.csv,a.csv"}), merge.upsert_sessions(old, new, ["o"], "b1", "2022-01-01 00:00:00")).first()
    assert b["record_count"] == 2 and b["file_count"] == 2


def test_append_rejects_and_lookup(spark):
    t = spark.createDataFrame([("a", None), ("b", "1")], "k string, l string")
    n = spark.createDataFrame([("a", ""), ("c", "1"), ("c", "1")], "k string, l string")
    assert [tuple(r) for r in merge.append_dedup(t, n, ["k", "l"]).collect()] == [("c", "1"), ("c", "1")]
    assert merge.rejects(n, t, "k", "k").count() == 2
    x = spark.createDataFrame([("l1", 5), ("l9", 5), ("l8", 6)], "link string, d int")
    y = spark.createDataFrame([("l1", 5, 100, 1), ("l2", 5, 200, 2)], "link string, d int, sec int, o int")
    assert {r["link"]: r["sec"] for r in merge.lookup_with_fallback(x, y, "link", "d", "sec", ["o"]).collect()} == {"l1": 100, "l9": 200, "l8": None}


def test_filters(spark):
    df = spark.createDataFrame([("Berlin", 5, True, None, "male"), ("Bern", None, False, True, ""), ("Rome", 9, None, True, None)], "city string, n int, a boolean, b boolean, gender string")
    pick = lambda f: [r["city"] for r in df.filter(f).collect()]
    assert pick(filters.contains_ci("city", "BER")) == ["Berlin", "Bern"] and pick(filters.in_range("n", 6)) == ["Rome"] and len(pick(filters.in_range("n"))) == 3
    assert pick(filters.any_flag(["a", "b"])) == ["Berlin", "Bern", "Rome"] and pick(filters.all_flags(["b"])) == ["Bern", "Rome"]
    assert pick(filters.gender_is(["unknown"])) == ["Bern", "Rome"] and pick(filters.gender_is(["male", "unknown"])) == ["Berlin", "Bern", "Rome"]
    assert filters.clamp(None, 1, 10, 5) == 5 and filters.clamp(99, 1, 10, 5) == 10
    with pytest.raises(ValueError):
        filters.real_date("2024-02-30")


def test_facts(spark):
    g = spark.createDataFrame([("male", "0.5", ""), ("female", "x", "0.25")], "gender string, risky_crossing string, run_red_light string")
    got = facts.melt(g, "gender_stats", facts.MELTS["gender_stats"]).collect()
    assert sorted((r["dimension_value"], r["metric_name"], r["value_numeric"]) for r in got) == [("female", "run_red_light_rate", 0.25), ("male", "risky_crossing_rate", 0.5)]
    f = facts.melt(g, "gender_stats", facts.MELTS["gender_stats"])
    first = facts.dimensions(f)
    assert facts.dimensions(f, first).count() == first.count() == 2


def test_replacing_a_source_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "facts")
    df = lambda rows: spark.createDataFrame(rows, "v int, data_source string")
    facts.replace_source(df([(1, "a"), (2, "b")]), path)
    facts.replace_source(df([(3, "a")]), path)
    assert sorted((r["v"], r["data_source"]) for r in spark.read.parquet(path).collect()) == [(2, "b"), (3, "a")]


def test_effects_are_balanced(spark):
    rows = [(f"l{i}", float(i * 10)) for i in range(8)]
    e = effects.effect_sizes(spark.createDataFrame(rows, "l string, r double"), c("l"), c("r"), "one", 2.0)
    assert e.filter("label = 'l4'").first() is None  # at the mean of the rates above the floor
    top = effects.balanced(e.unionByName(effects.effect_sizes(spark.createDataFrame(rows, "l string, r double"), c("l"), c("r") * 2, "two", 2.0))).collect()
    assert len(top) == 6 and [r["position"] for r in top] == [1, 2, 3, 4, 5, 6]


def test_insight_json_that_is_no_array(spark):
    df = spark.createDataFrame([('[{"id":"a","category":"speed"}]',), ("{}",), (None,)], "j string")
    assert [len(r[0]) for r in df.select(insights.from_json_insights(c("j"))).collect()] == [1, 0, 0]


def test_reports(spark):
    df = spark.createDataFrame([(True, None), (None, None), (False, True)], "a boolean, b boolean")
    r = reports.flag_coverage(df, ["a", "b"]).first()
    assert (r["total"], r["with_a"], r["with_b"], r["all_null"]) == (3, 1, 1, 1)


GAZETTEER = "name string, country string, iso3 string, videos long, population long, continent string"


@pytest.fixture(scope="module")
def gazetteer(spark):
    project = spark.createDataFrame([("São Paulo", "Brazil", "BRA", 9, 12, "SA"), ("Springfield", "United States", "USA", 2, 5, "NA"), ("Springfield", "Canada", "CAN", 3, 1, "NA"), ("Kathmandu", "Nepal", "NPL", 1, 1, "AS")], GAZETTEER)
    world = spark.createDataFrame([("Lodz", "Poland", "POL", None, 700, "EU"), ("Kathmandu", "Nowhere", "NOW", None, 1, "XX")], GAZETTEER)
    aliases = spark.createDataFrame([("Sampa", "Sao Paulo"), ("Kathmandu", "Lodz")], "alias string, name string")
    return project, aliases, world


def test_resolver_cases(spark, gazetteer):
    rows = [(1, "sao paulo", None, None), (2, "SAMPA", None, None), (3, "Łódź", None, None), (4, "Springfield", None, None), (5, "Springfield", "Canada", None), (6, "Springfield", None, "USA"), (7, "Kathmandu", "France", None), (8, "Kathmand", None, None), (9, "Sao P", None, None), (10, "gibberish city", None, None), (11, None, None, None)]
    inputs = spark.createDataFrame(rows, "input_id int, name string, country string, iso3 string")
    got = {r["input_id"]: r for r in places.resolve(inputs, *gazetteer).collect()}
    want = {1: ("São Paulo", "project", True), 2: ("São Paulo", "project", True), 3: ("Lodz", "world", True), 4: ("Springfield", "project", False), 5: ("Springfield", "project", True), 6: ("Springfield", "project", True), 7: ("Kathmandu", "project", False), 8: ("Kathmandu", "fuzzy", False), 9: (None, None, False), 10: (None, None, False), 11: (None, None, False)}
    assert {i: (r["c_name"], r["layer"], r["confident"]) for i, r in got.items()} == want
    assert got[5]["c_iso3"] == "CAN" and got[6]["c_iso3"] == "USA"


def test_enrichment_fills_blanks_of_confident_rows_only(spark, gazetteer):
    rows = spark.createDataFrame([(1, "sao paulo", "", None, "unknown"), (2, "Springfield", "unknown", None, None), (3, "Nowhere", " ", None, "EU")], "input_id int, name string, country string, iso3 string, continent string")
    got = {r["input_id"]: tuple(r)[1:] for r in places.enrich(rows, places.resolve(rows.withColumn("country", F.nullif(F.col("country"), F.lit("unknown"))), *gazetteer), ["iso3", "continent"]).collect()}
    assert got[1] == ("São Paulo", "Brazil", "BRA", "SA")
    assert got[2][0] == "Springfield" and got[2][2] is None and got[3][1] == "Unknown"


def test_candidates_and_duplicates(spark):
    p = spark.createDataFrame([(1, "new york")], "place_id int, name string")
    k = spark.createDataFrame([(1, "New York City", "PPLA"), (1, "new york", "ADM"), (1, "Boston", "PPL")], "place_id int, candidate string, code string")
    assert places.score_candidates(p, k).first()["candidate"] == "New York City"
    pl = spark.createDataFrame([(1, "Rome", "Italy", "ITA"), (2, "Rome", "ITA", "ITA"), (3, "Rome", "Unknown", None), (4, "Oslo", "Unknown", None)], "place_id int, city string, country string, iso3 string")
    s = spark.createDataFrame([(7, 2), (8, 1)], "session_id int, place_id int")
    kept, moved = places.merge_duplicates(pl, s)
    assert sorted(r["place_id"] for r in kept.collect()) == [1, 4] and {r["place_id"] for r in moved.collect()} == {1}


def test_effects_that_differ_by_rounding_are_ties(spark):
    rows = [("A", "x", 1.0, 0.1 + 0.2, "up"), ("A", "w", 1.0, -0.3, "down"), ("B", "v", 1.0, 0.3 - 1e-13, "up")]
    got = effects.balanced(spark.createDataFrame(rows, "category string, label string, rate double, effect double, direction string"))
    assert [r.label for r in got.orderBy("position").collect()] == ["w", "x", "v"]


def test_names_of_one_beginning_do_not_all_meet(spark):
    """A thousand names begin alike; what each contains has rarer letters, so few pairs meet and none is lost."""
    rows = [(i, f"san {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i:03d}") for i in range(1000)]
    good = spark.createDataFrame(rows, "place_id int, city string").withColumn("country", F.lit("X"))
    bad = good.select("place_id", F.concat("city", F.lit("?q")).alias("city"), "country")
    fold = lambda df, key: places.fold(df, "city", key).select(F.col("country").alias("__c"), key)
    a, b = fold(bad, "__a"), fold(good, "__b")
    pairs = places._contained(a, "__a", b, "__b")
    assert pairs.count() < 20 * len(rows)
    begun = a.withColumn("g", F.substring("__a", 1, 3)).join(b.withColumn("g", F.substring("__b", 1, 3)), "g")
    assert begun.count() == len(rows) ** 2
    got = {r["place_id"]: r["repaired"] for r in places.repair_names(bad, good.drop("place_id")).collect()}
    assert got == dict(rows)


def test_contained_names_equal_all_pairs(spark):
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randrange(1, 8)))
    bad = [(i, word(), "X") for i in range(120)]
    good = sorted({word() for _ in range(60)})
    got = {x["place_id"]: (x["repaired"], round(x["score"], 6)) for x in places.repair_names(spark.createDataFrame(bad, "place_id int, city string, country string"), spark.createDataFrame([(g, "X") for g in good], "city string, country string")).collect()}
    for i, a, _ in bad:
        scored = [(300.0 if a == b else 100.0 * min(len(a), len(b)) / max(len(a), len(b)), b) for b in good if a in b or b in a]
        best = sorted(((-s, b) for s, b in scored if s > 50))
        assert got.get(i) == ((best[0][1], round(-best[0][0], 6)) if best else None)


def test_repair_broadcasts_no_exploded_names_and_keeps_repeated_rows(spark, tmp_path):
    spark.range(600).select(F.col("id").alias("place_id"), F.concat(F.lit("large ring "), F.col("id") % 7).alias("city"), F.lit("X").alias("country")).write.parquet(str(tmp_path / "names"))
    names = spark.read.parquet(str(tmp_path / "names"))
    df = places.repair_names(names.withColumn("city", F.concat("city", F.lit("®s"))), names.select("city", "country").distinct())
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r["place_id"]: r["repaired"] for r in df.collect()} == {i: f"large ring {i % 7}" for i in range(600)}


def joined_rows(df):
    """Rows that come out of the joins of a DataFrame's plan, as it ran."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        inner = p.executedPlan() if name == "AdaptiveSparkPlan" else p.plan() if "QueryStage" in name else None
        rows = p.metrics().get("numOutputRows") if "Join" in name else None
        found += [rows.get().value()] if rows is not None and rows.isDefined() else []
        kids = p.children()
        todo += [inner] if inner is not None else [kids.apply(i) for i in range(kids.size())]
    return found


def test_disambiguation_meets_few_candidates_and_equals_all_pairs(spark):
    import random

    r = random.Random(3)
    land = lambda: (r.choice([None, "", "France", "peru ", "FRA"]), r.choice([None, "", "FRA", "per"]))
    cands = [(r.choice(["a", "a", "a", "b", "c"]), *land(), r.choice([None, i]), i) for i in range(400)] + [("d", "France", "FRA", 1, 1)]
    asked = [(i, r.choice(["a", "a", "b", "d", "e", None]), *land()) for i in range(300)]
    df = places.disambiguate(spark.createDataFrame(asked, "input_id int, name_key string, country string, iso3 string"), spark.createDataFrame(cands, "name_key string, country string, iso3 string, videos int, population int"))
    got = {x["input_id"]: (x["c_population"], x["confident"]) for x in df.collect()}
    low = lambda x: None if x is None else x.strip().lower()
    same = lambda x, y: x is not None and low(x) == low(y)
    want = {}
    for i, key, country, iso3 in asked:
        own = [c for c in cands if c[0] == key]
        rated = sorted((not (same(iso3, c[2]) or same(country, c[1]) or same(country, c[2])), c[3] is None, -(c[3] or 0), -c[4]) for c in own)
        if own:
            want[i] = (-rated[0][3], not rated[0][0] if iso3 or country else len(own) == 1)
    assert got == want
    assert max(joined_rows(df)) <= 3 * len(asked)


def test_values_meet_their_place_before_one_count(spark, monkeypatch):
    """One aggregation holds the values, in as many tasks as the rows need."""
    monkeypatch.setattr(rollup, "PER_TASK", 1)
    rows = spark.createDataFrame([(1, 5, None), (1, 5, 2), (2, 5, None), (3, None, None), (9, 5, 5)], "session_id int, a int, b int")
    df = rollup.value_counts(rows, {"a": F.col("a"), "b": F.col("b")}, "session_id", spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "session_id int, place_id int"))
    assert sorted(map(tuple, df.collect())) == [(7, "a", 5.0, 3), (7, "b", 2.0, 1)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert df.rdd.getNumPartitions() == 5


def test_keys_without_a_value_and_dates(spark):
    rows = spark.createDataFrame([("1996-05-06", "1997-01-02 00:00:00", None), (None, "1997-01-02 00:00:00", None), (None, None, "1998-03-04 05:06:07"), (None, None, None)], "a string, b string, c string")
    df = rows.select(F.col("a").cast("date").alias("a"), F.col("b").cast("timestamp").alias("b"), F.col("c").cast("timestamp").alias("c"))
    months = [str(r[0]) for r in df.select(clean.effective_date(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert months == ["1996-05-01", "1997-01-01", "1998-03-01", "None"]
    assert [r["row"] for r in filters.served_json(rows.select("a", "c")).collect()] == ['{"a":"1996-05-06"}', "{}", '{"c":"1998-03-04 05:06:07"}', "{}"]


def test_backfill_keeps_what_is_there(spark):
    rows = spark.createDataFrame([(1, None, None, None, "1996-05-06 07:08:09"), (2, "b", None, None, "1996-05-06 07:08:09"), (3, None, "1990-01-01", "1991-01-01 00:00:00", "1996-05-06 07:08:09")], "id int, batch string, collected string, first_imported string, created string")
    df = rows.withColumns({"collected": F.col("collected").cast("date"), "first_imported": F.col("first_imported").cast("timestamp"), "created": F.col("created").cast("timestamp")})
    got = {r["id"]: (r["batch"], str(r["collected"]), str(r["first_imported"])) for r in merge.backfill_provenance(df, "x").collect()}
    assert got == {1: ("x", "1996-05-06", "1996-05-06 07:08:09"), 2: ("b", "None", "None"), 3: ("x", "1990-01-01", "1991-01-01 00:00:00")}


def test_insights_as_arrays_equal_insights_as_rows(spark):
    kind = "place_id int, city string, insights array<struct<id:string,rule:string,category:string,relevance_score:double>>"
    some = [("1_b", "b", None, 0.9), ("1_a", "a", "x", 0.9), ("1_m", "m", "meta", 2.0), ("1_n", "n", "x", None)]
    arrays = spark.createDataFrame([(1, "A", some), (2, "A", [("2_a", "a", "x", 0.95)]), (3, "B", [("3_m", "m", "meta", 1.0)]), (4, "C", []), (5, "D", [("5_a", "a", "x", float("nan")), ("5_b", "b", "x", 3.0)])], kind)
    rows = insights.exploded(arrays)
    plain = lambda df: [repr(tuple(r)) for r in df.select("place_id", "city", "rule", "relevance_score").collect()]
    assert plain(insights.top_of_arrays(arrays, 5)) == plain(insights.top_insights(rows, 5)) != []
    places_ = arrays.select("place_id", "city").union(spark.createDataFrame([(9, "E")], "place_id int, city string"))
    stored = lambda df: sorted(map(repr, df.select("place_id", "city", "insights").collect()))
    assert stored(insights.store_arrays(places_, arrays)) == stored(insights.store_insights(places_, rows.drop("city")))


def test_insights_are_made_once_best_first(spark):
    rule = lambda id, when, score: insights.Rule(id, "x", when, score, f"concat('made of {id} ', v)", "v")
    rules = lambda: [rule("A", "v > 0", "0.5D"), rule("B", "v > 1", "v"), rule("C", "v > 0", "0.5D"), rule("D", "v > 2", "CAST('NaN' AS double)"), rule("E", "v > 2", "CAST(NULL AS double)")]
    base = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 0.0), (5, None)], "place_id int, v double")
    of = base.withColumns({"video_count": F.lit(1), "pedestrian_count": F.lit(1), "city": F.lit("Z")})
    made = insights.generate(of, spark.range(1).select(F.lit(1).alias("whole")), rules, 4)
    got = {}
    for r in sorted(insights.exploded(made).collect(), key=lambda r: (r["place_id"], r["position"])):
        assert r["text"] == f"made of {r['rule']} {r['metrics']['city_value']}" and r["position"] == len(got.get(r["place_id"], "")) + 1
        got[r["place_id"]] = got.get(r["place_id"], "") + r["rule"]
    assert got == {1: "AC", 2: "BAC", 3: "EBAC"}
    # Not again in a filter that Spark infers for rows of an array, or for the best of one.
    for df in (insights.exploded(made), insights.top_of_arrays(insights.generate(of, spark.range(1).select(F.lit(1).alias("whole")), rules), 5)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("CASE WHEN") > 0 and "array_sort(filter(array(CASE" not in plan and "Inner, (size(" not in plan and "Cross, (size(" not in plan
        assert sum("named_struct(o, " in line for line in plan.splitlines()) == 1


@pytest.mark.parametrize("hot", [False, True])
def test_parts_of_places_are_the_same_of_hot_ones(spark, monkeypatch, hot):
    monkeypatch.setattr(rollup, "SAMPLED", 1 if hot else 1 << 40)
    monkeypatch.setattr(rollup, "HOT", 1)
    values = {1: [5.0, -0.0, 2.0, None], 2: [7.0, 7.5], 3: [1.0], 4: [None, None], None: [9.0, 4.0]}
    of = [(p, v) for p, some in values.items() for v in some]
    s = spark.createDataFrame([(i, p, v, f"w{i % 2}") for i, (p, v) in enumerate(of)], "session_id long, place_id long, speed double, weather string")
    o = spark.createDataFrame([(i, x) for i in (0, 0, 1, 5, 99) for x in (1, 2)], "session_id long, x long")
    counts, hot_places = rollup.counts_and_hot(s, "speed", c("speed"))
    assert {r["place_id"] for r in hot_places.collect()} == ({1, 2, 4} if hot else set())
    assert {r["value"]: r["n"] for r in counts.collect()} == {v: 1 for _, v in of if v is not None}
    spec = {"n": F.count("__session"), "kinds": F.size(F.collect_set("weather")), "s": F.sum("speed")}
    got = {r["place_id"]: tuple(r)[1:] for r in rollup.place_parts(s, o, spec, {"x": F.sum("x")}, hot_places, {"median": ("speed", 0.5), "low": ("speed", 0.25)}).collect()}
    assert got == {1: (4, 2, 7.0, 9, 2.0, 1.0), 2: (2, 2, 14.5, 3, 7.25, 7.125), 3: (1, 1, 1.0, None, 1.0, 1.0), 4: (2, 2, None, None, None, None), None: (2, 2, 13.0, 3, None, None)}


def test_places_sets_are_made_after_their_rows_meet(spark):
    """A set or mode a place and task, of a row or two each, cost more than all else before."""
    s = spark.createDataFrame([(1, 1, 2.0, "a")], "session_id long, place_id long, speed double, weather string")
    o = spark.createDataFrame([(1, 1)], "session_id long, x long")
    parts = rollup.place_parts(s, o, {"kinds": F.size(F.collect_set("weather"))}, {"x": F.sum("x")}, s.select("place_id").filter("false"))
    lines = parts._jdf.queryExecution().sparkPlan().toString().splitlines()
    own = [i for i, line in enumerate(lines) if "Aggregate" in line and "collect_set" in line]
    assert own and any("REPARTITION_BY_NUM" in line for line in lines[own[-1]:])
