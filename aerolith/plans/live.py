"""The latest feed as streams: landed files to Silver, Silver to flight history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from aerolith.operators.history import HistorySpec
from aerolith.plans.bronze import DATASETS, bronze
from aerolith.plans.flight_history import flight_states, with_arrival
from aerolith.plans.silver import clean_flights, enrich_flights
from aerolith.schemas import text_schema
from aerolith.streaming.history import read_history, start_history
from aerolith.streaming.ingest import file_stream, start_ingest


def silver_flights(landed: DataFrame, at=None) -> DataFrame:
    """Landed text to Silver flights; the same for history, latest feed and stream."""
    return enrich_flights(clean_flights(bronze(landed, "flights_latest"), at))


def load_latest(spark: SparkSession, landing: str, target: str, checkpoint: str, at=None,
                every: str | None = None) -> StreamingQuery:
    """Cleans and enriches each landed Parquet file once and appends it to Silver, with the order of arrival."""
    schema = T.StructType([
        *text_schema(DATASETS["flights_latest"]), T.StructField("load_timestamp", T.TimestampType()),
    ])
    stream = with_arrival(file_stream(spark, landing, schema))
    return start_ingest(stream, target, checkpoint, lambda df: silver_flights(df, at), every)


def track_flights(spark: SparkSession, silver: str, schema: T.StructType, root: str, checkpoint: str,
                  spec: HistorySpec, every: str | None = None) -> StreamingQuery:
    """Keeps the Type-2 history of the flights appended to Silver."""
    states = flight_states(file_stream(spark, silver, schema), spec)
    return start_history(states, root, checkpoint, spec, every)


def flight_history(spark: SparkSession, silver: DataFrame, root: str, spec: HistorySpec) -> DataFrame:
    return read_history(spark, root, flight_states(silver, spec).schema, spec)
