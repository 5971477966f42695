"""Type-2 history of flights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.functions.keys import surrogate_key
from aerolith.functions.numbers import to_int
from aerolith.operators.history import START, HistorySpec
from aerolith.schemas import ARRIVAL

TRACKED = ["departure_time", "arrival_time", "total_delay", "flight_status"]
CARRIED = ["flight_number", "tail_number", "origin_airport", "destination_airport"]


def flight_spec(keys: list[str] | None = None, ts: str = "load_timestamp", seq: str | None = ARRIVAL) -> HistorySpec:
    """Flight numbers repeat across airlines and days; name more key columns to tell them apart.

    Flights of one load have equal stamps: they count in the order of their arrival.
    """
    return HistorySpec(keys or ["flight_number"], TRACKED, ts, seq)


def with_arrival(files: DataFrame) -> DataFrame:
    """Parquet files, or a stream of them, with each row's place: by the second of its file, then by its place in the file."""
    second = F.unix_seconds(F.col("_metadata.file_modification_time"))
    return files.select("*", (F.shiftleft(second, 30) + F.col("_metadata.row_index")).alias(ARRIVAL))


def flight_states(silver: DataFrame, spec: HistorySpec) -> DataFrame:
    """Flights as change records: keys, carried and tracked columns, clock times as numbers.

    Flights without the sequence column of the spec have none: equal stamps are then ordered by a hash.
    """
    names = list(dict.fromkeys([*spec.keys, *CARRIED]))
    seq = F.col(spec.seq) if spec.seq in silver.columns else F.lit(None)
    return silver.select(
        *names,
        to_int(F.col("departure_time")).alias("departure_time"),
        to_int(F.col("arrival_time")).alias("arrival_time"),
        "total_delay", "flight_status", spec.ts, *([seq.cast("long").alias(spec.seq)] if spec.seq else []),
    )


def with_version_id(history: DataFrame, spec: HistorySpec, name: str = "dim_flight_id") -> DataFrame:
    """A repeatable id per version: md5 of key, start and, if there is one, sequence, which tells equal starts apart."""
    start = F.date_format(F.col(START), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    seq = [F.coalesce(F.col(spec.seq), F.lit(0))] if spec.seq else []
    return history.select(surrogate_key(*spec.keys, start, *seq).alias(name), "*")
