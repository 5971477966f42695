"""Star schema: dimensions with surrogate keys, the calendar and the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions.dates import date_from_parts
from aerolith.functions.keys import calendar_key, surrogate_key
from aerolith.operators.history import HistorySpec, valid_at
from aerolith.operators.joins import Lookup, star_join
from aerolith.operators.periods import DAILY, MONTHLY, QUARTERLY, period_metrics
from aerolith.schemas import DELAY_PARTS

DATE_PARTS = ["year", "month", "day"]
VERSION_KEY = "dim_flight_id"


def dimension(rows: DataFrame, key: str, natural: list[str], attributes: list[str | Column]) -> DataFrame:
    """Attributes under an md5 key of the natural key."""
    return rows.select(surrogate_key(*natural).alias(key), *attributes)


def dim_airlines(silver: DataFrame) -> DataFrame:
    return dimension(silver, "airline_sk", ["iata_code"], [
        "iata_code", "airline_name", "airline", "airline_category", "code_validation", "record_date",
        "load_timestamp",
    ])


def dim_airports(silver: DataFrame) -> DataFrame:
    return dimension(silver, "airport_sk", ["iata_code"], [
        "iata_code", "city", "state", "country", "latitude", "longitude", "region", "continent_group",
        "airport_size_category", "location_validation", "record_year", "load_timestamp",
    ])


def dim_date(flights: DataFrame) -> DataFrame:
    """The days that occur in the flights."""
    return dimension(flights.select(*DATE_PARTS).distinct(), "date_sk", DATE_PARTS, DATE_PARTS)


def days_between(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """Every day from the first to the last column of a one-row frame."""
    return bounds.select(F.explode(F.sequence(F.col(first), F.col(last), F.expr("interval 1 day"))).alias("date"))


def dim_calendar(days: DataFrame, key_format: str = "timestamp") -> DataFrame:
    """Calendar rows for a ``date`` column.

    ``key_format``: "timestamp" hashes the day as a midnight timestamp, "parts" hashes
    year, month and day, which is the key of ``dim_date``.
    """
    date = F.col("date")
    parts = days.select(
        date, F.year(date).alias("year"), F.month(date).alias("month"), F.dayofmonth(date).alias("day")
    )
    key = calendar_key(date) if key_format == "timestamp" else surrogate_key(*DATE_PARTS)
    return parts.select(key.alias("date_sk"), *DATE_PARTS)


def year_calendar(spark: SparkSession, year: int, key_format: str = "timestamp") -> DataFrame:
    bounds = spark.range(1).select(
        F.make_date(F.lit(year), F.lit(1), F.lit(1)).alias("first"),
        F.make_date(F.lit(year), F.lit(12), F.lit(31)).alias("last"),
    )
    return dim_calendar(days_between(bounds, "first", "last"), key_format)


def with_flight_date(flights: DataFrame) -> DataFrame:
    return flights.withColumn("flight_date", date_from_parts(*[F.col(part) for part in DATE_PARTS]))


def fact_flights(flights: DataFrame, airlines: DataFrame, airports: DataFrame, dates: DataFrame) -> DataFrame:
    """One row per flight; keys of dimensions without a match are null.

    A code that a dimension holds several times makes as many rows of its flights.
    Flights that carry the key of their version (``with_flight_version``) keep it.
    """
    version = [VERSION_KEY] if VERSION_KEY in flights.columns else []
    return star_join(
        with_flight_date(flights),
        [
            Lookup(airlines, {"airline": "iata_code"}, {"airline_sk": "airline_sk"}, repeated=True),
            Lookup(airports, {"origin_airport": "iata_code"}, {"origin_airport_sk": "airport_sk"}, repeated=True),
            Lookup(airports, {"destination_airport": "iata_code"}, {"destination_airport_sk": "airport_sk"}, repeated=True),
            Lookup(dates, {part: part for part in DATE_PARTS}, {"date_sk": "date_sk"}),
        ],
        [
            "date_sk", "airline_sk", "origin_airport_sk", "destination_airport_sk", "departure_delay",
            "arrival_delay", "total_delay", *DELAY_PARTS, "distance", "cancelled", "diverted",
            "on_time_flag", "load_timestamp", "flight_date", *version,
        ],
    )


def with_flight_version(flights: DataFrame, versions: DataFrame, spec: HistorySpec) -> DataFrame:
    """Flights with the key of the version of their key that was valid when they were loaded."""
    return valid_at(flights, versions, spec.keys, spec.ts, {VERSION_KEY: VERSION_KEY})


def daily_metrics(flights: DataFrame) -> DataFrame:
    return period_metrics(with_flight_date(flights), DAILY)


def monthly_metrics(flights: DataFrame) -> DataFrame:
    return period_metrics(with_flight_date(flights), MONTHLY)


def quarterly_metrics(flights: DataFrame) -> DataFrame:
    return period_metrics(with_flight_date(flights), QUARTERLY)
