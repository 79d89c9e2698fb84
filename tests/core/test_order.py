"""Ranks and percentiles without a global sort, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from strideline.operators import order, rollup


@pytest.fixture
def rows(spark):
    r = random.Random(3)
    # A third of all rows share one value; NULLs and groups of unlike size.
    data = [(i, None if r.random() < 0.1 else 7.0 if r.random() < 0.33 else float(r.randrange(400)), r.choice(["a", "b", "b", "b", None])) for i in range(900)]
    return data, spark.createDataFrame(data, "place_id long, v double, g string").repartition(5)


def test_ranks_equal_counting(rows):
    data, df = rows
    got = {r["place_id"]: r for r in rollup.ranked(df, {"r": "v"}, {"p": "v"}, {"m": "v"}, {"w": ("v", "g")}).collect()}
    known = [v for _, v, _ in data if v is not None]
    for i, v, g in data:
        above = sum(x > v for x in known) if v is not None else len(known)
        below = sum(x < v for x in known) if v is not None else len(known)
        mine = [x for _, x, h in data if h == g and x is not None]
        assert got[i]["r"] == above + 1 and got[i]["p"] == below / (len(data) - 1)
        assert got[i]["m"] == (None if v is None else above + 1)
        assert got[i]["w"] == (sum(x > v for x in mine) if v is not None else len(mine)) + 1


def test_percentiles_equal_interpolation(rows):
    data, df = rows
    known = sorted(v for _, v, _ in data if v is not None)
    wanted = {f"q{p}": ("v", p / 100) for p in (0, 25, 50, 90, 100)}
    got = order.percentiles(df, wanted).first()
    for name, (_, p) in wanted.items():
        at = p * (len(known) - 1)
        low = known[int(at)]
        assert got[name] == pytest.approx(low + (known[min(int(at) + 1, len(known) - 1)] - low) * (at - int(at)))


@pytest.mark.parametrize("most", [1 << 12, 3])
def test_small_ranges_give_the_same_order(rows, monkeypatch, most):
    """Many ranges, also with edges thinned out."""
    data, df = rows
    want = {r["place_id"]: r for r in rollup.ranked(df, {"r": "v"}, {"p": "v"}, {"m": "v"}, {"w": ("v", "g")}).collect()}
    quartiles = {"a": ("v", 0.25), "b": ("v", 0.9)}
    q = order.percentiles(df, quartiles).first()
    monkeypatch.setattr(order, "RANGE", 8)
    monkeypatch.setattr(order, "MOST_EDGES", most)
    assert {r["place_id"]: r for r in rollup.ranked(df, {"r": "v"}, {"p": "v"}, {"m": "v"}, {"w": ("v", "g")}).collect()} == want
    assert order.percentiles(df, quartiles).first() == q
    counts = order.melt(df, {"v": ("v", None)}).groupBy("name", "grp", "value").count().withColumnRenamed("count", "n").filter("value IS NOT NULL")
    edges = [v for (v,) in counts.select("value").distinct().filter(F.pmod(F.xxhash64("value"), F.lit(8)) == 0).collect()]
    assert len(edges) > 20  # 400 values, 8 a range


@pytest.mark.parametrize("size", [1 << 16, 4])
def test_percentiles_within_groups(spark, monkeypatch, size):
    monkeypatch.setattr(order, "RANGE", size)
    r = random.Random(5)
    data = [(r.choice([1, 1, 1, 2, None]), float(r.randrange(200)), r.choice([None, 1.5, 2.5])) for _ in range(2000)] + [(3, None, None), (4, 2.0, None)]
    df = spark.createDataFrame(data, "g long, a double, b double").repartition(3)
    got = {x["g"]: x for x in order.group_percentiles(df, "g", {"m": ("a", 0.5), "q": ("a", 0.9), "b": ("b", 0.25)}).collect()}
    want = df.groupBy("g").agg(F.percentile("a", F.lit(0.5)).alias("m"), F.percentile("a", F.lit(0.9)).alias("q"), F.percentile("b", F.lit(0.25)).alias("b")).filter("m IS NOT NULL").collect()
    assert len(got) == len(want) == 4
    for x in want:
        for name in "mqb":
            assert got[x["g"]][name] == (None if x[name] is None else pytest.approx(x[name]))


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "place_id long, v double")
    assert rollup.ranked(df, {"r": "v"}).count() == 0
    assert order.percentiles(df, {"q": ("v", 0.5)}).first()["q"] is None
    one = rollup.ranked(spark.createDataFrame([(1, 2.0)], "place_id long, v double"), {"r": "v"}, {"p": "v"}).first()
    assert (one["r"], one["p"]) == (1, 0.0)


def test_no_window_without_a_partition(rows):
    plan = rollup.ranked(rows[1], {"r": "v"}, {"p": "v"})._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
