"""Registered queries that read whole tables, against SQL of their own here."""

import datetime as dt

import duckdb
import pytest

from strideline.operators import asof
from strideline.plans import driver
from strideline.plans.adapters import TABLES, prelude


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return lambda sql: con.sql(f"{prelude()} {sql}").fetchall()


def test_monthly_series_uses_every_session(spark, sf_dir, duck):
    """A month's value is that of the newest month up to it with one."""
    want = duck("""SELECT m.place_id, m.month, (SELECT sum(risky_ratio)::double / count(*) FROM sessions s WHERE s.place_id = m.place_id AND risky_ratio IS NOT NULL AND date_trunc('month', collected) =
      (SELECT max(date_trunc('month', collected)) FROM sessions t WHERE t.place_id = m.place_id AND risky_ratio IS NOT NULL AND collected BETWEEN '1992-01-01' AND last_day(m.month))) AS value
      FROM (SELECT DISTINCT place_id, unnest(generate_series(DATE '1992-01-01', DATE '1998-12-01', INTERVAL 1 MONTH))::date AS month FROM sessions) m""")
    got = driver.queries()["monthly_series"](spark, sf_dir).collect()
    assert {(r["place_id"], r["month"]): pytest.approx(r["value"]) for r in got} == {(p, str(m)): v for p, m, v in want if v is not None}


def test_series_fills_gaps_within_a_place(spark):
    day = lambda m: dt.date(1995, m, 1)
    df = spark.createDataFrame([(1, day(2), 5.0), (1, day(4), 7.0), (2, day(1), 1.0)], "place_id long, month date, value double")
    got = sorted(tuple(r) for r in asof.series_by_place(df, "1995-01-01", "1995-05-01").collect())
    assert got == [(1, day(2), 5.0), (1, day(3), 5.0), (1, day(4), 7.0), (1, day(5), 7.0), *((2, day(m), 1.0) for m in range(1, 6))]


def test_append_dedup_takes_every_observation(spark, sf_dir, duck):
    """Target rows have sessions of their own, so what is left are all rows of the others."""
    want = duck("SELECT session_id, track, gender FROM observations WHERE session_id % 4 <> 0")
    got = driver.queries()["append_dedup"](spark, sf_dir).select("session_id", "track", "gender").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and {r["session_id"] % 4 for r in got} == {1, 2, 3}
