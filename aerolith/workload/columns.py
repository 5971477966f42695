"""Projections, filters, scalar functions and business rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.functions import dates, rules
from aerolith.functions.keys import surrogate_key as sk
from aerolith.functions.numbers import or_default, round_even, to_date, to_double, to_int
from aerolith.functions.text import clean_code, initcap_words, normalise_name, place_label
from aerolith.operators import filters
from aerolith.operators.changes import differs
from aerolith.plans.gold import dimension
from aerolith.plans.silver import Cleaning, clean
from aerolith.workload.files import STAMP
from aerolith.workload.registry import query, table
from aerolith.workload.star import FLIGHTS_SQL, flights


def initcap_sql(column: str) -> str:
    """Words of letters parted by single spaces."""
    return (
        f"array_to_string(list_transform(string_split(lower({column}), ' '), "
        "lambda w: upper(w[1]) || w[2:]), ' ')"
    )


# Cleaning and dimensions

@query("""SELECT upper(trim('  ' || s_name)) AS code, trim(s_name || '  ') AS name,
                 CAST(s_acctbal AS DOUBLE) AS balance, CAST(s_nationkey AS INTEGER) AS nation,
                 COALESCE(NULLIF(s_nationkey, 3), 0) AS minutes, TIMESTAMP '2025-11-26 01:23:14' AS load_timestamp
          FROM supplier WHERE s_nationkey <> 7""")
def silver_clean(spark, sf_dir):
    raw = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("  "), "s_name").alias("code"), F.concat("s_name", F.lit("  ")).alias("name"),
        F.col("s_acctbal").cast("string").alias("balance"),
        F.nullif(F.col("s_nationkey"), F.lit(7)).cast("string").alias("nation"),
        F.nullif(F.col("s_nationkey"), F.lit(3)).cast("string").alias("minutes"),
    )
    steps = Cleaning(codes=["code"], trimmed=["name"], doubles=["balance"], integers=["nation"],
                     defaults={"minutes": 0}, required=["code", "nation"])
    return clean(raw, steps, STAMP).withColumn("load_timestamp", F.col("load_timestamp").cast("timestamp_ntz"))


@query("""SELECT md5(CAST(s_suppkey AS VARCHAR)) AS supplier_sk, s_suppkey, s_name,
                 CASE WHEN s_nationkey IN (0, 1, 2) THEN 'MAJOR' ELSE 'REGIONAL' END AS category FROM supplier""")
def dim_build(spark, sf_dir):
    category = rules.airline_category(F.col("s_nationkey"), {"MAJOR": [0, 1, 2]})
    return dimension(table(spark, sf_dir, "supplier"), "supplier_sk", ["s_suppkey"],
                     ["s_suppkey", "s_name", category.alias("category")])


@query("""SELECT *, CASE WHEN o_totalprice <= 50000 THEN 'NO_DELAY' WHEN o_totalprice <= 150000 THEN 'SHORT'
                         WHEN o_totalprice <= 300000 THEN 'MEDIUM' ELSE 'LONG' END AS price_category,
                 CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_final,
                 CAST(o_orderdate AS DATE) AS record_date FROM orders""")
def silver_enrich(spark, sf_dir):
    bounds = [(50_000, "NO_DELAY"), (150_000, "SHORT"), (300_000, "MEDIUM")]
    return table(spark, sf_dir, "orders").select(
        "*", rules.up_to(F.col("o_totalprice"), bounds, "LONG").alias("price_category"),
        rules.cases([(F.col("o_orderstatus") == "F", 1)], 0).alias("is_final"),
        F.to_date("o_orderdate").alias("record_date"),
    )


# Filters

@query("SELECT event_id, event_type FROM (SELECT event_id, NULLIF(event_type, 'error') AS event_type FROM events) "
       "WHERE event_type IS NOT NULL")
def filter_not_null(spark, sf_dir):
    kind = F.nullif(F.col("event_type"), F.lit("error")).alias("event_type")
    return table(spark, sf_dir, "events").select("event_id", kind).filter(F.col("event_type").isNotNull())


@query("""SELECT * FROM (SELECT event_id, NULLIF(event_type, 'view') AS event_type, NULLIF(user_id, 3) AS user_id
                         FROM events) WHERE event_type IS NOT NULL AND user_id IS NOT NULL""")
def drop_critical_nulls(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.nullif(F.col("event_type"), F.lit("view")).alias("event_type"),
        F.nullif(F.col("user_id"), F.lit(3)).alias("user_id"))
    return filters.keep_present(events, ["event_type", "user_id"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def filter_equality(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").filter(F.col("o_orderstatus") == "F")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN '1996-03-01' AND '1998-07-15'")
def filter_date_range(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return filters.between_dates(orders, "o_orderdate", "1996-03-01", "1998-07-15")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')")
def filter_membership(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    everything = filters.member_of(orders, "o_orderpriority", [])
    return filters.member_of(everything, "o_orderpriority", ["1-URGENT", "3-MEDIUM"])


@query("""WITH pairs AS (SELECT event_id, NULLIF(event_type, 'error') AS a,
                                CASE WHEN value < 40 THEN 'view' ELSE NULL END AS b FROM events)
          SELECT event_id, a, b FROM pairs WHERE a IS DISTINCT FROM b""")
def change_detect(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").select(
        "event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("a"),
        F.when(F.col("value") < 40, F.lit("view")).alias("b"))
    return pairs.filter(differs([F.col("a")], [F.col("b")]))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sort_limit(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


# Scalar functions

@query("SELECT s_suppkey, upper(s_name) AS upper_name, trim('  ' || s_name || ' ') AS trimmed, "
       "upper(trim('  ' || s_name || ' ')) AS code, CAST(length(s_name) AS INTEGER) AS chars FROM supplier")
def fn_strings(spark, sf_dir):
    padded = F.concat(F.lit("  "), F.col("s_name"), F.lit(" "))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.upper("s_name").alias("upper_name"), F.trim(padded).alias("trimmed"),
        clean_code(padded).alias("code"), F.length("s_name").alias("chars"))


@query(f"SELECT p_partkey, {initcap_sql('p_name')} AS plain, {initcap_sql('p_name')} AS words FROM part")
def fn_initcap(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.initcap("p_name").alias("plain"), initcap_words(F.upper("p_name")).alias("words"))


@query("SELECT o_orderkey, md5(CAST(o_custkey AS VARCHAR) || '|' || NULLIF(o_orderstatus, 'P') || '|' || "
       "o_orderpriority) AS order_sk, md5(CAST(o_orderkey AS VARCHAR)) AS single_sk FROM orders")
def surrogate_key(spark, sf_dir):
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", sk("o_custkey", status, "o_orderpriority").alias("order_sk"), sk("o_orderkey").alias("single_sk"))


@query("""SELECT c_custkey, c_mktsegment || ', ' || s || ' (' || c_name || ')' AS full_name,
                 c_mktsegment || ', ' || s AS short_name,
                 c_mktsegment || ', ' || COALESCE(s, '') || ' (' || c_name || ')' AS filled_name
          FROM (SELECT c_custkey, c_mktsegment, c_name, NULLIF(n_name, 'NATION_3') AS s
                FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)""")
def label_concat(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    city, state, code = F.col("c_mktsegment"), F.nullif(F.col("n_name"), F.lit("NATION_3")), F.col("c_name")
    return customers.select(
        "c_custkey", place_label(city, state, code).alias("full_name"), place_label(city, state).alias("short_name"),
        place_label(city, state, code, missing_state="").alias("filled_name"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INTEGER) AS y,
                 CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_date,
                 CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_date,
                 CAST(date_trunc('year', o_orderdate) AS DATE)
                   + CAST((quarter(o_orderdate) - 1) * 90 AS INTEGER) AS rough_date,
                 'Q' || quarter(o_orderdate) AS quarter_label,
                 year(o_orderdate) || '-Q' || quarter(o_orderdate) AS metric_quarter,
                 TRY_CAST(year(o_orderdate) || '-' || month(o_orderdate) || '-' || (day(o_orderdate) + 2) AS DATE)
                   AS shifted,
                 CAST(o_orderdate AS DATE) AS parsed, strftime(o_orderdate, '%Y-%m-%d') AS day_text
          FROM orders""")
def date_parts(spark, sf_dir):
    date = F.col("o_orderdate")
    y, m, d = F.year(date), F.month(date), F.dayofmonth(date)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.to_date(date).alias("day"), y.alias("y"), F.quarter(date).alias("q"),
        dates.month_start(date).alias("month_date"), dates.quarter_start(date).alias("quarter_date"),
        dates.rough_quarter_date(date).alias("rough_date"), dates.quarter_name(date).alias("quarter_label"),
        dates.year_quarter_name(date).alias("metric_quarter"), dates.date_from_parts(y, m, d + 2).alias("shifted"),
        to_date(F.concat_ws("-", y, m, d)).alias("parsed"), dates.day_text(date).alias("day_text"))


_RAW = "CASE event_type WHEN 'error' THEN '' WHEN 'view' THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END"


def _raw_minutes():
    kind = F.col("event_type")
    return F.when(kind == "error", F.lit("")).when(kind == "view", F.lit("n/a")).otherwise(F.col("user_id").cast("string"))


@query(f"""SELECT event_id, TRY_CAST({_RAW} AS INTEGER) AS minutes, TRY_CAST({_RAW} AS DOUBLE) AS degrees,
                  value FROM events""")
def cast_enforce(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", to_int(_raw_minutes()).alias("minutes"), to_double(_raw_minutes()).alias("degrees"),
        to_double(F.col("value").cast("string")).alias("value"))


@query(f"""SELECT event_id, COALESCE(TRY_CAST({_RAW} AS INTEGER), 0) AS minutes,
                  COALESCE(NULLIF(event_type, 'error'), 'NONE') AS reason FROM events""")
def null_defaults(spark, sf_dir):
    reason = F.nullif(F.col("event_type"), F.lit("error"))
    return table(spark, sf_dir, "events").select(
        "event_id", or_default(_raw_minutes(), 0).alias("minutes"), or_default(reason, "NONE").alias("reason"))


@query("SELECT event_id, ts + to_microseconds(event_id) AS unique_ts FROM events")
def tie_break_ts(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", dates.later_by_micros(F.col("ts"), F.col("event_id")).alias("unique_ts"))


@query("SELECT event_id, round_even(value * 1.37, 2) AS rounded FROM events")
def fn_round_even(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", round_even(F.col("value") * 1.37).alias("rounded"))


@query("SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR) || '|' || '2025-11-26') AS row_id FROM customer")
def surrogate_row_id(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", sk("c_custkey", F.date_format(F.lit(STAMP.date()), "yyyy-MM-dd")).alias("row_id"))


# Business rules

@query(f"WITH {FLIGHTS_SQL} SELECT l_orderkey, l_linenumber, departure_delay, arrival_delay, "
       "departure_delay + arrival_delay AS total_delay FROM flights")
def derive_total(spark, sf_dir):
    return flights(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "departure_delay", "arrival_delay",
        rules.total_delay(F.col("departure_delay"), F.col("arrival_delay")).alias("total_delay"))


@query(f"""WITH {FLIGHTS_SQL}, t AS (SELECT *, departure_delay + arrival_delay AS total FROM flights)
          SELECT l_orderkey, l_linenumber, total,
                 CASE WHEN total <= 0 THEN 'NO_DELAY' WHEN total <= 15 THEN 'SHORT' WHEN total <= 60 THEN 'MEDIUM'
                      ELSE 'LONG' END AS delay_category,
                 CASE WHEN total IS NULL THEN 'UNKNOWN' WHEN total <= 0 THEN 'NO_DELAY' WHEN total <= 25 THEN 'SHORT'
                      WHEN total <= 60 THEN 'MEDIUM' ELSE 'LONG' END AS delay_category_25,
                 CASE WHEN distance < 500 THEN 'SHORT_HAUL' WHEN distance BETWEEN 500 AND 1500 THEN 'MEDIUM_HAUL'
                      ELSE 'LONG_HAUL' END AS distance_category,
                 CASE WHEN weather_delay > 30 THEN 'WEATHER_HIGH' WHEN weather_delay > 0 THEN 'WEATHER_LOW'
                      ELSE 'NO_WEATHER_IMPACT' END AS weather_impact
          FROM t""")
def classify_thresholds(spark, sf_dir):
    total = rules.total_delay(F.col("departure_delay"), F.col("arrival_delay"))
    return flights(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", total.alias("total"), rules.delay_category(total).alias("delay_category"),
        rules.delay_category(total, threshold=25, null_label="UNKNOWN").alias("delay_category_25"),
        rules.distance_category(F.col("distance")).alias("distance_category"),
        rules.weather_impact(F.col("weather_delay")).alias("weather_impact"))


@query("""SELECT o_orderkey, CASE WHEN isodow(o_orderdate) IN (1, 7) THEN 'WEEKEND' ELSE 'WEEKDAY' END AS day_type,
                 CASE WHEN isodow(o_orderdate) IN (6, 7) THEN 'WEEKEND' ELSE 'WEEKDAY' END AS iso_day_type FROM orders""")
def classify_day_type(spark, sf_dir):
    code = F.weekday("o_orderdate") + 1
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", rules.day_type(code).alias("day_type"), rules.day_type(code, (6, 7)).alias("iso_day_type"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'CANCELLED' WHEN o_orderpriority = '5-LOW'
                 THEN 'DIVERTED' ELSE 'COMPLETED' END AS flight_status FROM orders""")
def classify_status(spark, sf_dir):
    cancelled = (F.col("o_orderstatus") == "P").cast("int")
    diverted = (F.col("o_orderpriority") == "5-LOW").cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.flight_status(cancelled, diverted).alias("flight_status"))


@query(f"WITH {FLIGHTS_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN departure_delay + arrival_delay <= 0 "
       "THEN 1 ELSE 0 END AS on_time_flag FROM flights")
def flag_on_time(spark, sf_dir):
    total = rules.total_delay(F.col("departure_delay"), F.col("arrival_delay"))
    return flights(spark, sf_dir).select("l_orderkey", "l_linenumber", rules.on_time_flag(total).alias("on_time_flag"))


@query(f"""SELECT p_partkey, CASE WHEN p_name ILIKE '%RING%' THEN 'Ring Works' WHEN p_name ILIKE '%Red%' THEN 'Red Works'
                  ELSE {initcap_sql('p_name')} END AS name FROM part""")
def normalise_names(spark, sf_dir):
    patterns = {"RING": "Ring Works", "Red": "Red Works"}
    return table(spark, sf_dir, "part").select("p_partkey", normalise_name(F.col("p_name"), patterns).alias("name"))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey IN (0, 3, 6, 9) THEN 'MAJOR' WHEN s_nationkey IN (1, 4, 7)
                 THEN 'LOW_COST' ELSE 'REGIONAL' END AS category FROM supplier""")
def classify_in_list(spark, sf_dir):
    groups = {"MAJOR": [0, 3, 6, 9], "LOW_COST": [1, 4, 7]}
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", rules.airline_category(F.col("s_nationkey"), groups).alias("category"))


@query("SELECT p_partkey, CASE WHEN length(p_brand) = 7 THEN 'VALID' ELSE 'INVALID' END AS code_validation FROM part")
def validate_code(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", rules.code_validation(F.col("p_brand"), 7).alias("code_validation"))


@query("""SELECT n_nationkey, CASE WHEN n_name IN ('NATION_0', 'NATION_5') THEN 'WEST' WHEN n_name IN ('NATION_7')
                 THEN 'SOUTH' ELSE 'INTERNATIONAL' END AS region,
                 CASE WHEN r_name IN ('AMERICA') THEN 'NORTH_AMERICA' WHEN r_name IN ('ASIA') THEN 'ASIA'
                      ELSE 'OTHER' END AS continent_group
          FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def classify_region(spark, sf_dir):
    joined = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select(
        "n_nationkey",
        rules.airport_region(F.col("n_name"), {"WEST": ["NATION_0", "NATION_5"], "SOUTH": ["NATION_7"]}).alias("region"),
        rules.airport_continent(F.col("r_name"), {"NORTH_AMERICA": ["AMERICA"], "ASIA": ["ASIA"]}).alias("continent_group"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING') THEN 'LARGE' WHEN c_mktsegment IN ('MACHINERY',
                 'FURNITURE') THEN 'MEDIUM' WHEN NULLIF(c_nationkey, 4) <> 1 THEN 'INTERNATIONAL' ELSE 'REGIONAL' END
                 AS size_category FROM customer""")
def classify_two_column(spark, sf_dir):
    size = rules.airport_size(F.col("c_mktsegment"), F.nullif(F.col("c_nationkey"), F.lit(4)),
                              ["BUILDING"], ["MACHINERY", "FURNITURE"], 1)
    return table(spark, sf_dir, "customer").select("c_custkey", size.alias("size_category"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal / 100 BETWEEN -90 AND 90 AND c_acctbal / 30 BETWEEN -180 AND 180
                 AND NULLIF(c_mktsegment, 'FURNITURE') IS NOT NULL THEN 'VALID' ELSE 'INVALID' END AS location_validation
          FROM customer""")
def validate_ranges(spark, sf_dir):
    valid = rules.location_validation(F.col("c_acctbal") / 100, F.col("c_acctbal") / 30,
                                      F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE")))
    return table(spark, sf_dir, "customer").select("c_custkey", valid.alias("location_validation"))
