"""Declared schemas of the raw files and of the typed Bronze tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and their order in the raw files.
AIRLINE_COLUMNS = ["iata_code", "airline"]
AIRPORT_COLUMNS = ["iata_code", "airport", "city", "state", "country", "latitude", "longitude"]
FLIGHT_COLUMNS = [
    "year", "month", "day", "day_of_week", "airline", "flight_number", "tail_number",
    "origin_airport", "destination_airport", "scheduled_departure", "departure_time",
    "departure_delay", "taxi_out", "wheels_off", "scheduled_time", "elapsed_time", "air_time",
    "distance", "wheels_on", "taxi_in", "scheduled_arrival", "arrival_time", "arrival_delay",
    "diverted", "cancelled", "cancellation_reason", "air_system_delay", "security_delay",
    "airline_delay", "late_aircraft_delay", "weather_delay",
]
DELAY_PARTS = [
    "air_system_delay", "security_delay", "airline_delay", "late_aircraft_delay", "weather_delay",
]
#: Orders rows of equal load stamps, where it was noted.
ARRIVAL = "arrival"
BRONZE_INTEGERS = {"year", "month", "day", "day_of_week", "distance"}


def text_schema(columns: list[str]) -> T.StructType:
    """Every column as text: how a raw file is scanned."""
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


def bronze_schema(columns: list[str]) -> T.StructType:
    """Target schema of a Bronze load: a few integers, text, and the load stamp."""
    fields = [
        T.StructField(name, T.IntegerType() if name in BRONZE_INTEGERS else T.StringType())
        for name in columns
    ]
    return T.StructType([*fields, T.StructField("load_timestamp", T.TimestampType())])


AUDIT = T.StructType([
    T.StructField("log_time", T.TimestampType()),
    T.StructField("process_name", T.StringType()),
    T.StructField("step_name", T.StringType()),
    T.StructField("dataset_name", T.StringType()),
    T.StructField("row_count_before", T.LongType()),
    T.StructField("row_count_after", T.LongType()),
    T.StructField("message", T.StringType()),
    T.StructField("status", T.StringType()),
])
