"""The dashboard's queries over the star of line items."""

from __future__ import annotations

from aerolith.operators import reports as r
from aerolith.workload.registry import query
from aerolith.workload.star import FACT_SQL, FLIGHTS_SQL, airline_fact, airlines, airports, fact, flights

_MEAN = "CAST(sum(arrival_delay) AS DOUBLE) / NULLIF(count(arrival_delay), 0)"
_ROUTE = "origin_airport_sk, destination_airport_sk"
_HAS_ROUTE = "origin_airport_sk IS NOT NULL AND destination_airport_sk IS NOT NULL"


@query(f"""WITH {FLIGHTS_SQL}
           SELECT count(*) AS total_flights, count(*) FILTER (WHERE arrival_delay > 0) AS delayed_flights,
                  CAST(sum(cancelled) AS BIGINT) AS cancelled_flights, round_even({_MEAN}, 2) AS avg_delay FROM flights""")
def report_kpis(spark, sf_dir):
    return r.key_figures(flights(spark, sf_dir))


@query(f"""WITH {FACT_SQL}, top AS (SELECT {_ROUTE}, count(*) AS flight_count FROM fact WHERE {_HAS_ROUTE}
             GROUP BY {_ROUTE} ORDER BY flight_count DESC, {_ROUTE} LIMIT 10)
           SELECT t.*, o.iata_code AS origin_code, o.city || ', ' || o.state || ' (' || o.iata_code || ')' AS origin_name,
                  d.iata_code AS dest_code, d.city || ', ' || d.state || ' (' || d.iata_code || ')' AS dest_name
           FROM top t LEFT JOIN airports o ON t.origin_airport_sk = o.airport_sk
           LEFT JOIN airports d ON t.destination_airport_sk = d.airport_sk""")
def report_busiest_routes(spark, sf_dir):
    return r.busiest_routes(fact(spark, sf_dir), airports(spark, sf_dir))


@query(f"""WITH {FACT_SQL}, top AS (SELECT {_ROUTE}, {_MEAN} AS arrival_delay FROM fact WHERE {_HAS_ROUTE}
             GROUP BY {_ROUTE} ORDER BY arrival_delay DESC NULLS LAST, {_ROUTE} LIMIT 10)
           SELECT t.*, o.city || ', ' || COALESCE(o.state, '') || ' (' || o.iata_code || ')' AS origin,
                  d.city || ', ' || COALESCE(d.state, '') || ' (' || d.iata_code || ')' AS destination
           FROM top t LEFT JOIN airports o ON t.origin_airport_sk = o.airport_sk
           LEFT JOIN airports d ON t.destination_airport_sk = d.airport_sk""")
def report_worst_routes(spark, sf_dir):
    return r.worst_routes(fact(spark, sf_dir), airports(spark, sf_dir))


@query(f"""WITH {FACT_SQL}, routes AS (SELECT {_ROUTE}, {_MEAN} AS arrival_delay FROM fact WHERE {_HAS_ROUTE}
             GROUP BY {_ROUTE})
           SELECT o.iata_code AS origin, d.iata_code AS destination, t.arrival_delay,
                  o.city || ', ' || o.state AS origin_full, d.city || ', ' || d.state AS destination_full
           FROM routes t LEFT JOIN airports o ON t.origin_airport_sk = o.airport_sk
           LEFT JOIN airports d ON t.destination_airport_sk = d.airport_sk""")
def report_route_heatmap(spark, sf_dir):
    return r.route_heatmap(fact(spark, sf_dir), airports(spark, sf_dir))


def _by_airline(value: str, name: str) -> str:
    return f"""WITH {FACT_SQL} SELECT f.airline_sk, {value} AS {name}, any_value(a.airline_name) AS airline_name
               FROM fact f LEFT JOIN airlines a ON f.airline_sk = a.airline_sk
               WHERE f.airline_sk IS NOT NULL GROUP BY f.airline_sk"""


@query(_by_airline(f"round_even({_MEAN}, 2)", "avg_arrival_delay"))
def report_airline_delay(spark, sf_dir):
    return r.airline_delay(airline_fact(spark, sf_dir), airlines(spark, sf_dir))


@query(_by_airline("CAST(sum(cancelled) AS BIGINT)", "cancelled"))
def report_cancellations(spark, sf_dir):
    return r.cancellations(airline_fact(spark, sf_dir), airlines(spark, sf_dir))


@query(_by_airline("CAST(sum(weather_delay) AS BIGINT)", "weather_delay"))
def report_weather(spark, sf_dir):
    return r.weather_minutes(airline_fact(spark, sf_dir), airlines(spark, sf_dir))


@query(f"""WITH {FLIGHTS_SQL}, sums AS (
             SELECT CAST(sum(air_system_delay) AS BIGINT) AS air_system_delay,
                    CAST(sum(security_delay) AS BIGINT) AS security_delay,
                    CAST(sum(airline_delay) AS BIGINT) AS airline_delay,
                    CAST(sum(late_aircraft_delay) AS BIGINT) AS late_aircraft_delay,
                    CAST(sum(weather_delay) AS BIGINT) AS weather_delay FROM flights)
           UNPIVOT sums ON COLUMNS(*) INTO NAME reason VALUE delay""")
def report_reason_breakdown(spark, sf_dir):
    return r.delay_reasons(flights(spark, sf_dir))


@query(f"""WITH {FLIGHTS_SQL} SELECT strftime(flight_date, '%Y-%m-%d') AS date, round_even({_MEAN}, 2) AS avg_arrival_delay
           FROM flights GROUP BY flight_date""")
def report_delay_trend(spark, sf_dir):
    return r.delay_trend(flights(spark, sf_dir))


@query(f"""WITH {FACT_SQL} SELECT f.airline_sk, f.flight_date, f.arrival_delay, origin_airport_sk,
                  destination_airport_sk FROM fact f
           WHERE flight_date BETWEEN '1996-02-01' AND '1999-10-31' AND airline_sk IN (
             SELECT airline_sk FROM airlines WHERE airline_name IN ('Supplier#000000002', 'Supplier#000000005'))
           AND destination_airport_sk IN (
             SELECT airport_sk FROM airports WHERE iata_code IN ('1', '2', '3', '5', '8', '13', '21'))""")
def report_filter(spark, sf_dir):
    names = ["Supplier#000000002", "Supplier#000000005"]
    chosen = r.select_flights(
        fact(spark, sf_dir), airlines(spark, sf_dir), names, "1996-02-01", "1999-10-31",
        airports(spark, sf_dir), destinations=["1", "2", "3", "5", "8", "13", "21"])
    return chosen.select("airline_sk", "flight_date", "arrival_delay", *r.ROUTE)


@query("SELECT s_name AS airline_name, max(CAST(s_suppkey AS VARCHAR)) AS iata_code FROM supplier GROUP BY s_name")
def dim_lookup(spark, sf_dir):
    return r.airline_codes(airlines(spark, sf_dir))
