"""The column tests of the Silver and Gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.operators.quality import (
    Check, accepted_values, in_order, in_range, not_null, relationship, run_checks, unique,
)

# Fixed values.
DELAY_CATEGORIES = ["NO_DELAY", "SHORT", "MEDIUM", "LONG"]
MINUTES = (-24 * 60, 7 * 24 * 60)
MILES = (1, 12_500)


def airline_checks() -> list[Check]:
    return [*not_null("iata_code"), unique("iata_code")]


def airport_checks() -> list[Check]:
    return not_null("iata_code", "city", "state", "country")


def flight_checks(airlines: DataFrame | None = None, airports: DataFrame | None = None) -> list[Check]:
    checks = [
        *not_null(
            "year", "month", "day", "airline", "origin_airport", "destination_airport",
            "departure_delay", "arrival_delay", "total_delay", "delay_category",
        ),
        accepted_values("delay_category", DELAY_CATEGORIES),
        unique("flight_number", "year", "month", "day"),
        in_range("departure_delay", *MINUTES),
        in_range("arrival_delay", *MINUTES),
        in_range("distance", *MILES),
    ]
    if airlines is not None:
        checks.append(relationship(["airline"], airlines, ["iata_code"]))
    if airports is not None:
        checks += [relationship([c], airports, ["iata_code"]) for c in ("origin_airport", "destination_airport")]
    return checks


def metric_checks(key: str) -> list[Check]:
    return [*not_null(key), unique(key)]


def history_checks() -> list[Check]:
    return [*not_null("effective_start"), in_order("effective_start", "effective_end")]


def quality_report(tables: dict[str, tuple[DataFrame, list[Check]]]) -> DataFrame:
    """All tests of all tables, one row each."""
    report = None
    for name, (df, checks) in tables.items():
        part = run_checks(df, name, checks)
        report = part if report is None else report.unionByName(part)
    return report.withColumn("failures", F.col("failures").cast("long"))
