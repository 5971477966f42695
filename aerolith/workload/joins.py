"""Star joins, calendars and the fact table."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.functions.keys import surrogate_key
from aerolith.operators.filters import matching
from aerolith.operators.joins import Lookup, fill_date, star_join
from aerolith.plans.gold import DATE_PARTS, days_between, dim_calendar, dim_date, dimension
from aerolith.workload import star
from aerolith.workload.registry import query, table

_DAY_SQL = """days AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS flight_date,
                              CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
                              CAST(day(o_orderdate) AS INTEGER) AS day FROM orders)"""
_DATE_SK = "md5(year || '|' || month || '|' || day)"


def _order_days(spark, sf_dir):
    date = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.to_date(date).alias("flight_date"), F.year(date).alias("year"),
        F.month(date).alias("month"), F.dayofmonth(date).alias("day"))


@query("""SELECT o_orderkey, o.o_custkey, c.customer_sk, c.c_mktsegment
          FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN -o_custkey - 1 ELSE o_custkey END AS o_custkey FROM orders) o
          LEFT JOIN (SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS customer_sk, c_mktsegment FROM customer) c
            ON o.o_custkey = c.c_custkey""")
def join_dim_left(spark, sf_dir):
    customers = dimension(table(spark, sf_dir, "customer"), "customer_sk", ["c_custkey"], ["c_custkey", "c_mktsegment"])
    key = F.when(F.col("o_orderstatus") == "P", -F.col("o_custkey") - 1).otherwise(F.col("o_custkey"))  # no such customer
    return star_join(
        table(spark, sf_dir, "orders").withColumn("o_custkey", key),
        [Lookup(customers, {"o_custkey": "c_custkey"}, {"customer_sk": "customer_sk", "c_mktsegment": "c_mktsegment"})],
        ["o_orderkey", "o_custkey", "customer_sk", "c_mktsegment"])


@query(f"""WITH {star.AIRPORTS_SQL}
           SELECT l_orderkey, l_linenumber, o.airport_sk AS origin_airport_sk, d.airport_sk AS destination_airport_sk
           FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN orders ON l_orderkey = o_orderkey
           LEFT JOIN customer ON o_custkey = c_custkey
           LEFT JOIN airports o ON s_nationkey = o.n_nationkey LEFT JOIN airports d ON c_nationkey = d.n_nationkey""")
def join_role_playing(spark, sf_dir):
    ports = star.airports(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return star_join(star.with_places(lines, spark, sf_dir), [
        Lookup(ports, {"origin_airport": "n_nationkey"}, {"origin_airport_sk": "airport_sk"}),
        Lookup(ports, {"destination_airport": "n_nationkey"}, {"destination_airport_sk": "airport_sk"}),
    ], ["l_orderkey", "l_linenumber", "origin_airport_sk", "destination_airport_sk"])


@query(f"""WITH {_DAY_SQL}, dates AS (SELECT DISTINCT year, month, day, {_DATE_SK} AS date_sk FROM days)
           SELECT o_orderkey, date_sk FROM (SELECT o_orderkey, year, month, CASE month WHEN 2 THEN NULL ELSE day END AS day FROM days)
           LEFT JOIN dates USING (year, month, day)""")
def join_composite_key(spark, sf_dir):
    days = _order_days(spark, sf_dir)
    dates = dim_date(days)
    undated = days.withColumn("day", F.when(F.col("month") != 2, F.col("day")))
    return star_join(undated, [Lookup(dates, {part: part for part in DATE_PARTS}, {"date_sk": "date_sk"})],
                     ["o_orderkey", "date_sk"])


@query("""SELECT o_orderkey, o_custkey FROM orders
          WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD'))""")
def filter_semi_join(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD"))
    return matching(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", chosen, "c_custkey")


@query(f"WITH {_DAY_SQL} SELECT DISTINCT {_DATE_SK} AS date_sk, year, month, day FROM days")
def dim_date_from_facts(spark, sf_dir):
    return dim_date(_order_days(spark, sf_dir))


@query("""WITH b AS (SELECT CAST(date_trunc('year', min(o_orderdate)) AS DATE) AS a,
                            CAST(date_trunc('year', max(o_orderdate)) AS DATE) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS z
                     FROM orders),
          d AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE)
                AS date FROM b)
          SELECT md5(strftime(date, '%Y-%m-%d') || ' 00:00:00.000') AS date_sk, CAST(year(date) AS INTEGER) AS year,
                 CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day FROM d""")
def dim_calendar_(spark, sf_dir):
    bounds = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    first = F.trunc(F.col("a").cast("date"), "year")
    last = F.date_sub(F.add_months(F.trunc(F.col("z").cast("date"), "year"), 12), 1)
    return dim_calendar(days_between(bounds.select(first.alias("first"), last.alias("last")), "first", "last"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS flight_date FROM orders")
def fact_date_fallback(spark, sf_dir):
    days = _order_days(spark, sf_dir)
    fact = days.select("o_orderkey", surrogate_key(*DATE_PARTS).alias("date_sk"))
    return fill_date(fact, dim_date(days), "flight_date", "date_sk").select("o_orderkey", "flight_date")


@query(f"WITH {star.FACT_SQL} SELECT * FROM fact")
def fact_build(spark, sf_dir):
    return star.fact(spark, sf_dir)
