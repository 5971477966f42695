"""Report queries over a fact table and its dimensions.

Each aggregates on the keys of the fact first and puts names on the small result.
Facts without a key (no dimension row matched) are left out of grouped reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.dates import day_text
from aerolith.functions.numbers import exact_mean, round_even
from aerolith.functions.text import place_label
from aerolith.operators.filters import all_present, between_dates, matching
from aerolith.operators.joins import Lookup, look_up
from aerolith.schemas import DELAY_PARTS

ROUTE = ["origin_airport_sk", "destination_airport_sk"]
AIRLINE = "airline_sk"


def select_flights(fact: DataFrame, airlines: DataFrame | None = None, names: list[str] | None = None,
                   first=None, last=None, airports: DataFrame | None = None, origins: list[str] | None = None,
                   destinations: list[str] | None = None, date: str = "flight_date") -> DataFrame:
    """Facts in a date range and, where chosen, of these airlines and airport codes."""
    fact = between_dates(fact, date, first, last)
    if names:
        fact = matching(fact, AIRLINE, airlines.filter(F.col("airline_name").isin(names)), AIRLINE)
    for key, codes in zip(ROUTE, (origins, destinations)):
        if codes:
            fact = matching(fact, key, airports.filter(F.col("iata_code").isin(codes)), "airport_sk")
    return fact


def filter_choices(fact: DataFrame, airlines: DataFrame, date: str = "flight_date") -> tuple[DataFrame, DataFrame]:
    """What a user can choose from: first and last date, and airline names with codes."""
    return date_bounds(fact, date), airline_codes(airlines)


def date_bounds(fact: DataFrame, date: str = "flight_date") -> DataFrame:
    return fact.agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"))


def airline_codes(airlines: DataFrame, name: str = "airline_name", code: str = "iata_code") -> DataFrame:
    """One code per name; of several the largest."""
    return airlines.groupBy(F.col(name).alias("airline_name")).agg(F.max(code).alias("iata_code"))


def _mean(column: str) -> Column:
    return exact_mean(F.sum(column), F.count(column))


def key_figures(fact: DataFrame) -> DataFrame:
    return fact.agg(
        F.count(F.lit(1)).alias("total_flights"),
        F.count_if(F.col("arrival_delay") > 0).alias("delayed_flights"),
        F.coalesce(F.sum("cancelled"), F.lit(0)).alias("cancelled_flights"),
        round_even(_mean("arrival_delay")).alias("avg_delay"),
    )


def _with_airports(routes: DataFrame, airports: DataFrame, take: dict[str, dict[str, str]]) -> DataFrame:
    for role, columns in take.items():
        routes = look_up(routes, Lookup(airports, {f"{role}_airport_sk": "airport_sk"}, columns))
    return routes


def _by_route(fact: DataFrame, value: Column, name: str) -> DataFrame:
    return fact.filter(all_present(ROUTE)).groupBy(*ROUTE).agg(value.alias(name))


def busiest_routes(fact: DataFrame, airports: DataFrame, top: int = 10) -> DataFrame:
    """Most flights first; ties in order of the route keys."""
    counts = _by_route(fact, F.count(F.lit(1)), "flight_count")
    first = counts.orderBy(F.desc("flight_count"), *ROUTE).limit(top)
    full = airports.withColumn("full_name", place_label(F.col("city"), F.col("state"), F.col("iata_code")))
    return _with_airports(first, full, {
        "origin": {"origin_code": "iata_code", "origin_name": "full_name"},
        "destination": {"dest_code": "iata_code", "dest_name": "full_name"},
    })


def worst_routes(fact: DataFrame, airports: DataFrame, top: int = 10) -> DataFrame:
    """Highest mean arrival delay first; routes without one last, ties by route keys."""
    means = _by_route(fact, _mean("arrival_delay"), "arrival_delay")
    first = means.orderBy(F.desc_nulls_last("arrival_delay"), *ROUTE).limit(top)
    full = airports.withColumn(
        "full_name", place_label(F.col("city"), F.col("state"), F.col("iata_code"), missing_state="")
    )
    return _with_airports(first, full, {
        "origin": {"origin": "full_name"}, "destination": {"destination": "full_name"},
    })


def route_heatmap(fact: DataFrame, airports: DataFrame) -> DataFrame:
    means = _by_route(fact, _mean("arrival_delay"), "arrival_delay")
    named = airports.withColumn("airport_name", place_label(F.col("city"), F.col("state")))
    return _with_airports(means, named, {
        "origin": {"origin": "iata_code", "origin_full": "airport_name"},
        "destination": {"destination": "iata_code", "destination_full": "airport_name"},
    }).select("origin", "destination", "arrival_delay", "origin_full", "destination_full")


def _by_airline(fact: DataFrame, airlines: DataFrame, value: Column, name: str) -> DataFrame:
    grouped = fact.filter(all_present([AIRLINE])).groupBy(AIRLINE).agg(value.alias(name))
    return look_up(grouped, Lookup(airlines, {AIRLINE: AIRLINE}, {"airline_name": "airline_name"}))


def airline_delay(fact: DataFrame, airlines: DataFrame) -> DataFrame:
    return _by_airline(fact, airlines, round_even(_mean("arrival_delay")), "avg_arrival_delay")


def cancellations(fact: DataFrame, airlines: DataFrame) -> DataFrame:
    return _by_airline(fact, airlines, F.coalesce(F.sum("cancelled"), F.lit(0)), "cancelled")


def weather_minutes(fact: DataFrame, airlines: DataFrame) -> DataFrame:
    return _by_airline(fact, airlines, F.coalesce(F.sum("weather_delay"), F.lit(0)), "weather_delay")


def delay_reasons(fact: DataFrame, parts: list[str] | None = None) -> DataFrame:
    """Minutes by reason in long form."""
    parts = parts or DELAY_PARTS
    sums = fact.agg(*[F.coalesce(F.sum(part), F.lit(0)).cast("long").alias(part) for part in parts])
    return sums.unpivot([], parts, "reason", "delay")


def delay_trend(fact: DataFrame, date: str = "flight_date") -> DataFrame:
    daily = fact.filter(F.col(date).isNotNull()).groupBy(date).agg(round_even(_mean("arrival_delay")).alias("avg_arrival_delay"))
    return daily.select(day_text(F.col(date)).alias("date"), "avg_arrival_delay")
