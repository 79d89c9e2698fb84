"""The driver's tables seen as places, sessions and observations.

The texts are SQL that Spark and DuckDB both run; measures are whole numbers, so sums are exact in either engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ADAPTERS = {
    "places": """SELECT c_custkey AS place_id, c_name AS city, n_name AS country, concat('N', n_nationkey) AS iso3, r_name AS continent, c_mktsegment AS state,
  CAST(round(c_acctbal * 100) AS bigint) AS population, CAST(n_nationkey + 20 AS bigint) AS city_med_age,
  CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal / 200 END AS latitude, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal / 100 END AS longitude
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "sessions": """SELECT o_orderkey AS session_id, o_custkey AS place_id, concat('v', o_orderkey) AS link, CAST(o_orderdate AS date) AS collected, CAST(year(o_orderdate) AS bigint) AS batch,
  CASE o_orderstatus WHEN 'F' THEN 'dense_v2' WHEN 'O' THEN 'legacy_1hz' END AS pipeline_version, o_orderpriority AS weather,
  CAST(round(o_totalprice) AS bigint) AS speed, CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice) AS bigint) END AS measured_speed, o_orderkey % 40 AS measured_n,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 101 END AS risky_ratio, o_orderkey % 97 AS red_ratio, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 89 END AS crosswalk_ratio,
  CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 5 END AS severe_conflicts, o_orderkey % 50 AS n_people, o_orderkey % 17 AS n_vehicles,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 END AS n_groups, o_orderkey % 6 AS grouped_people,
  CASE WHEN o_orderkey % 3 = 0 THEN 'ok' ELSE 'none' END AS status, concat('St ', o_orderkey % 13) AS street_name, concat('veh', o_orderkey % 4) AS top_vehicles, o_orderkey % 23 AS crossing_time, o_orderkey % 31 AS hazard,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 181 - 90 AS double) END AS latitude, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 361 - 180 AS double) END AS longitude,
  CASE WHEN o_orderkey % 3 = 0 THEN CASE o_orderkey % 2 WHEN 0 THEN 'high' ELSE 'low' END END AS confidence, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 500 AS double) END AS spread_m, CASE WHEN o_orderkey % 3 = 0 THEN concat('run ', o_orderkey % 4) END AS provenance
FROM {orders}""",
    "observations": """SELECT l_orderkey AS session_id, l_linenumber AS track, l_returnflag = 'R' AS risky, l_discount > CAST(0.08 AS double) AS red_light, l_linestatus = 'O' AS crosswalk, l_tax > CAST(0.05 AS double) AS phone,
  CASE WHEN l_partkey % 10 <> 0 THEN CAST(l_quantity AS bigint) END AS age, CASE l_suppkey % 4 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN '' END AS gender,
  l_suppkey % 2 = 0 AS daytime, CAST(round(l_extendedprice) AS bigint) % 500 AS walking, l_partkey % 70 - 10 AS delay,
  l_partkey % 2 = 0 AS car, l_partkey % 3 = 0 AS bus, l_partkey % 5 = 0 AS truck, l_partkey % 7 = 0 AS motorbike, l_partkey % 11 = 0 AS bicycle, l_partkey % 13 = 0 AS scooter, CASE WHEN l_partkey % 2 = 1 THEN l_partkey % 17 = 0 END AS tram
FROM {lineitem}""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
FLAGS = ["car", "bus", "truck", "motorbike", "bicycle", "scooter", "tram"]


class Data:
    """Lazy DataFrames of one folder: the tables by name, and the adapters over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in ADAPTERS:
            used = {t: self.table(t) for t in TABLES if "{" + t + "}" in ADAPTERS[name]}
            return self.spark.sql(ADAPTERS[name], **used)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def prelude() -> str:
    """The adapters as DuckDB CTEs."""
    return "WITH " + ",\n".join(f"{n} AS ({sql.format(**{t: t for t in TABLES})})" for n, sql in ADAPTERS.items())
