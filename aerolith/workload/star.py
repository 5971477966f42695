"""Flights, airlines and airports as they are played by the driver's tables.

A flight is a line item: the supplier is its airline, the supplier's nation its
origin and the customer's nation its destination.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions.rules import on_time_flag, total_delay
from aerolith.operators.joins import Lookup, star_join
from aerolith.plans.gold import dimension
from aerolith.schemas import DELAY_PARTS
from aerolith.workload.registry import table

# Line item columns in the roles of flight columns.
ROLES = {
    "flight_date": "CAST(l_shipdate AS DATE)",
    "departure_delay": "l_linenumber * 10 - 30",
    "arrival_delay": (
        "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN NULL ELSE CAST(l_quantity AS INT) - 25 END"
    ),
    "cancelled": "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END",
    "diverted": "CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END",
    "distance": "CAST(floor(l_extendedprice / 50) AS INT)",
    "air_system_delay": "CAST(floor(l_discount * 100 + 0.5e0) AS INT)",
    "security_delay": "CASE WHEN l_linenumber = 1 THEN 5 ELSE 0 END",
    "airline_delay": "CAST(l_quantity AS INT)",
    "late_aircraft_delay": "l_linenumber",
    "weather_delay": "CAST(floor(l_tax * 1000 + 0.5e0) AS INT)",
}
_ROLES_SQL = ", ".join(f"{text} AS {name}" for name, text in ROLES.items())

FLIGHTS_SQL = f"flights AS (SELECT l_orderkey, l_linenumber, l_suppkey, {_ROLES_SQL} FROM lineitem)"
AIRLINES_SQL = """airlines AS (
  SELECT md5(CAST(s_suppkey AS VARCHAR)) AS airline_sk, CAST(s_suppkey AS VARCHAR) AS iata_code,
         s_name AS airline_name, s_suppkey
  FROM supplier)"""
AIRPORTS_SQL = """airports AS (
  SELECT md5(CAST(n_nationkey AS VARCHAR)) AS airport_sk, CAST(n_nationkey AS VARCHAR) AS iata_code,
         n_name AS city, NULLIF(r_name, 'ASIA') AS state, n_nationkey
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey)"""
FACT_SQL = f"""{FLIGHTS_SQL}, {AIRLINES_SQL}, {AIRPORTS_SQL}, fact AS (
  SELECT a.airline_sk, o.airport_sk AS origin_airport_sk, d.airport_sk AS destination_airport_sk,
         f.departure_delay, f.arrival_delay, f.departure_delay + f.arrival_delay AS total_delay,
         f.air_system_delay, f.security_delay, f.airline_delay, f.late_aircraft_delay, f.weather_delay,
         f.distance, f.cancelled, f.diverted,
         CASE WHEN f.departure_delay + f.arrival_delay <= 0 THEN 1 ELSE 0 END AS on_time_flag, f.flight_date
  FROM flights f
  LEFT JOIN supplier s ON f.l_suppkey = s.s_suppkey
  LEFT JOIN orders ON f.l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN airlines a ON f.l_suppkey = a.s_suppkey
  LEFT JOIN airports o ON s.s_nationkey = o.n_nationkey
  LEFT JOIN airports d ON c_nationkey = d.n_nationkey)"""

ORDER_FLIGHTS_SQL = """order_flights AS (
  SELECT o_orderkey, o_orderdate AS flight_date, o_orderpriority = '5-LOW' AS is_late,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS cancelled,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN NULL
              ELSE CAST(floor(o_totalprice / 10000) AS INT) - 25 END AS arrival_delay
  FROM orders)"""


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_suppkey", *[f"{text} AS {name}" for name, text in ROLES.items()]
    )


def airlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    return dimension(suppliers, "airline_sk", ["s_suppkey"], [
        F.col("s_suppkey").cast("string").alias("iata_code"), F.col("s_name").alias("airline_name"),
        "s_suppkey", "s_nationkey",
    ])


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = star_join(table(spark, sf_dir, "nation"), [
        Lookup(table(spark, sf_dir, "region"), {"n_regionkey": "r_regionkey"}, {"state": "r_name"}),
    ])
    return dimension(nations, "airport_sk", ["n_nationkey"], [
        F.col("n_nationkey").cast("string").alias("iata_code"), F.col("n_name").alias("city"),
        F.nullif(F.col("state"), F.lit("ASIA")).alias("state"), "n_nationkey",
    ])


def airline_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights with the airline key alone: what reports by airline or date read."""
    return star_join(flights(spark, sf_dir), [
        Lookup(airlines(spark, sf_dir), {"l_suppkey": "s_suppkey"}, {"airline_sk": "airline_sk"}),
    ])


def with_places(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds the airline key and the nations a line item comes from and goes to.

    The destination is put on the orders first, so line items, the largest table,
    are shuffled once at most.
    """
    destinations = star_join(table(spark, sf_dir, "orders"), [
        Lookup(table(spark, sf_dir, "customer"), {"o_custkey": "c_custkey"}, {"destination": "c_nationkey"}),
    ], ["o_orderkey", "destination"])
    return star_join(rows, [
        Lookup(airlines(spark, sf_dir), {"l_suppkey": "s_suppkey"},
               {"airline_sk": "airline_sk", "origin_airport": "s_nationkey"}),
        Lookup(destinations, {"l_orderkey": "o_orderkey"}, {"destination_airport": "destination"}),
    ])


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole star: keys, measures and flags of every flight."""
    ports = airports(spark, sf_dir)
    total = total_delay(F.col("departure_delay"), F.col("arrival_delay"))
    measured = flights(spark, sf_dir).withColumn("total_delay", total)
    return star_join(
        with_places(measured, spark, sf_dir),
        [
            Lookup(ports, {"origin_airport": "n_nationkey"}, {"origin_airport_sk": "airport_sk"}),
            Lookup(ports, {"destination_airport": "n_nationkey"}, {"destination_airport_sk": "airport_sk"}),
        ],
        [
            "airline_sk", "origin_airport_sk", "destination_airport_sk", "departure_delay", "arrival_delay",
            "total_delay", *DELAY_PARTS, "distance", "cancelled", "diverted",
            on_time_flag(F.col("total_delay")).alias("on_time_flag"), "flight_date",
        ],
    )


def order_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as flights, one per order; low-priority ones arrive late."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_orderdate AS flight_date", "o_orderpriority = '5-LOW' AS is_late",
        "CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS cancelled",
        "CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN NULL"
        " ELSE CAST(floor(o_totalprice / 10000) AS INT) - 25 END AS arrival_delay",
    )


