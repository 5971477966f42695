"""Aggregates and KPI tables, full and incremental."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.functions.numbers import exact_mean
from aerolith.operators.changes import ACTION
from aerolith.operators.periods import (
    DAILY, MONTHLY, QUARTERLY, StoredPeriods, keep_up, period_metrics, recompute_periods,
)
from aerolith.operators.reports import date_bounds
from aerolith.session import scratch_dir
from aerolith.sources.versioned import VersionedTable
from aerolith.sources.writers import settle
from aerolith.workload.registry import query, table
from aerolith.workload.star import FLIGHTS_SQL, ORDER_FLIGHTS_SQL, flights, order_flights

CUT = "1998-06-15"  # the stored tables end with this day, in the middle of a month and a quarter

_MEASURES = """count(*) FILTER (WHERE arrival_delay > 0) AS total_delayed_flights,
               count(*) FILTER (WHERE cancelled = 1) AS total_cancelled_flights,
               CAST(sum(arrival_delay) AS DOUBLE) / NULLIF(count(arrival_delay), 0) AS avg_delay"""


def _daily(rows: str) -> str:
    return f"""SELECT d AS metric_date, {_MEASURES}, CAST(month(d) AS INTEGER) AS month,
                      CAST(year(d) AS INTEGER) AS year, 'Q' || quarter(d) AS quarter
               FROM (SELECT *, CAST(flight_date AS DATE) AS d FROM order_flights) WHERE {rows} GROUP BY d"""


def _monthly(rows: str) -> str:
    return f"""SELECT d AS month_date, CAST(month(d) AS INTEGER) AS month, CAST(year(d) AS INTEGER) AS year,
                      count(*) AS total_flights, {_MEASURES}
               FROM (SELECT *, CAST(date_trunc('month', flight_date) AS DATE) AS d FROM order_flights)
               WHERE {rows} GROUP BY d"""


def _quarterly(rows: str) -> str:
    return f"""SELECT CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter,
                      year(d) || '-Q' || quarter(d) AS metric_quarter, count(*) AS total_flights, {_MEASURES}
               FROM (SELECT *, CAST(date_trunc('quarter', flight_date) AS DATE) AS d FROM order_flights)
               WHERE {rows} GROUP BY d"""


def _kept(unit: str) -> str:
    """Rows an incremental run ends up with: stored ones, and those of periods after the last stored one."""
    old = f"flight_date <= '{CUT}' AND NOT is_late"
    return f"""({old}) OR flight_date >= (
        SELECT date_trunc('{unit}', max(flight_date)) + INTERVAL 1 {unit} FROM order_flights WHERE {old})"""


@query(f"WITH {FLIGHTS_SQL} SELECT l_suppkey, count(*) FILTER (WHERE arrival_delay > 0) AS delayed, "
       "count(*) FILTER (WHERE cancelled = 1) AS cancelled FROM flights GROUP BY l_suppkey")
def agg_conditional_count(spark, sf_dir):
    return flights(spark, sf_dir).groupBy("l_suppkey").agg(
        F.count_if(F.col("arrival_delay") > 0).alias("delayed"), F.count_if(F.col("cancelled") == 1).alias("cancelled"))


@query(f"WITH {FLIGHTS_SQL} SELECT l_suppkey, CAST(sum(arrival_delay) AS DOUBLE) / NULLIF(count(arrival_delay), 0) "
       "AS avg_delay FROM flights GROUP BY l_suppkey")
def agg_avg(spark, sf_dir):
    mean = exact_mean(F.sum("arrival_delay"), F.count("arrival_delay"))
    return flights(spark, sf_dir).groupBy("l_suppkey").agg(mean.alias("avg_delay"))


@query("SELECT min(o_orderdate) AS min_date, max(o_orderdate) AS max_date FROM orders")
def agg_bounds(spark, sf_dir):
    return date_bounds(table(spark, sf_dir, "orders"), "o_orderdate")


@query(f"WITH {ORDER_FLIGHTS_SQL} {_daily('true')}")
def kpi_daily(spark, sf_dir):
    return period_metrics(order_flights(spark, sf_dir), DAILY)


@query(f"WITH {ORDER_FLIGHTS_SQL} {_monthly('true')}")
def kpi_monthly(spark, sf_dir):
    return period_metrics(order_flights(spark, sf_dir), MONTHLY)


@query(f"WITH {ORDER_FLIGHTS_SQL} {_quarterly('true')}")
def kpi_quarterly(spark, sf_dir):
    return period_metrics(order_flights(spark, sf_dir), QUARTERLY)


def _stored_metrics(rows, grain):
    """The table an earlier run left: rows up to the cut, without those that come late."""
    return settle(period_metrics(rows.filter(f"flight_date <= '{CUT}' AND NOT is_late"), grain), "metrics")


def _kept_up(spark, sf_dir, grain):
    """A stored table of an earlier run, and what a second run makes of it."""
    rows = order_flights(spark, sf_dir)
    stored = VersionedTable(spark, scratch_dir(spark, "kpi"), grain.key, part=F.year(grain.stored()))
    stored.overwrite(period_metrics(rows.filter(f"flight_date <= '{CUT}' AND NOT is_late"), grain))
    keep_up(stored, rows, grain)
    return stored.read()


@query(f"WITH {ORDER_FLIGHTS_SQL} {_daily(_kept('day'))}")
def incremental_daily(spark, sf_dir):
    return _kept_up(spark, sf_dir, DAILY)


@query(f"WITH {ORDER_FLIGHTS_SQL} {_monthly(_kept('month'))}")
def incremental_monthly(spark, sf_dir):
    return _kept_up(spark, sf_dir, MONTHLY)


@query(f"WITH {ORDER_FLIGHTS_SQL} {_quarterly(_kept('quarter'))}")
def incremental_quarterly(spark, sf_dir):
    return _kept_up(spark, sf_dir, QUARTERLY)


@query(f"WITH {ORDER_FLIGHTS_SQL} {_monthly('true')}")
def incremental_recompute(spark, sf_dir):
    rows = order_flights(spark, sf_dir)
    arrived = rows.filter(f"flight_date > '{CUT}' OR is_late")
    return recompute_periods(_stored_metrics(rows, MONTHLY), rows, arrived, MONTHLY)


_SIGNED_SQL = """order_flights AS (
  SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN flight_date + INTERVAL 40 DAY ELSE flight_date END AS flight_date, cancelled,
         CASE WHEN o_orderpriority = '1-URGENT' THEN arrival_delay + 7 ELSE arrival_delay END AS arrival_delay
  FROM all_flights JOIN (SELECT o_orderkey AS k, o_orderpriority FROM orders) ON o_orderkey = k WHERE o_orderpriority <> '4-NOT SPECIFIED')"""


@query(f"WITH {ORDER_FLIGHTS_SQL.replace('order_flights AS', 'all_flights AS', 1)}, {_SIGNED_SQL} {_monthly('true')}")
def incremental_signed(spark, sf_dir):
    """Flights arrive in two loads, the second with late ones; then some are moved and changed, and some deleted."""
    rows = order_flights(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    urgent, gone = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "4-NOT SPECIFIED"
    stored = StoredPeriods(spark, scratch_dir(spark, "periods"), MONTHLY)
    stored.apply(rows.filter(f"flight_date <= '{CUT}' AND NOT is_late"))
    stored.apply(rows.filter(f"flight_date > '{CUT}' OR is_late"))
    moved = rows.filter(urgent).withColumns({
        "flight_date": F.col("flight_date") + F.expr("INTERVAL 40 DAY"), "arrival_delay": F.col("arrival_delay") + 7})
    stored.apply(rows.filter(urgent).withColumn(ACTION, F.lit("DELETE")).unionByName(moved.withColumn(ACTION, F.lit("INSERT"))))
    stored.apply(rows.filter(gone).withColumn(ACTION, F.lit("DELETE")))
    return stored.read()
