"""The whole batch: raw files to Bronze, Silver and Gold tables with an audit log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.operators.periods import DAILY, MONTHLY, QUARTERLY, Measures, period_metrics
from aerolith.plans import bronze, checks, gold, silver
from aerolith.plans.flight_history import flight_spec, flight_states, with_version_id
from aerolith.sources.audit import audited_overwrite
from aerolith.sources.writers import overwrite_parquet, union_feeds
from aerolith.streaming.history import apply_batch, last_finished, read_history


@dataclass(frozen=True)
class Tables:
    airlines: DataFrame
    airports: DataFrame
    flights: DataFrame
    dim_airlines: DataFrame
    dim_airports: DataFrame
    dim_date: DataFrame
    dim_flights: DataFrame
    fact_flights: DataFrame
    daily: DataFrame
    monthly: DataFrame
    quarterly: DataFrame
    audit: DataFrame

    def quality(self) -> DataFrame:
        return checks.quality_report({
            "silver_airlines": (self.airlines, checks.airline_checks()),
            "silver_airports": (self.airports, checks.airport_checks()),
            "silver_flights": (self.flights, checks.flight_checks(self.dim_airlines, self.dim_airports)),
            "dim_flights": (self.dim_flights, checks.history_checks()),
            "gold_flight_metrics": (self.daily, checks.metric_checks("metric_date")),
            "gold_monthly_metrics": (self.monthly, checks.metric_checks("month_date")),
            "gold_quarterly_metrics": (self.quarterly, checks.metric_checks("metric_quarter")),
        })


def run_batch(spark: SparkSession, raw: dict[str, str], root: str, at=None, buckets: int = 64) -> Tables:
    """Builds every table under ``root`` from raw CSV paths by dataset name.

    The flights' history is kept from run to run: a run adds its flights as one more batch.

    Each layer is written once and read back, so a later layer does not repeat the
    work of an earlier one.
    """
    root = root.rstrip("/")
    log = f"{root}/audit_log"
    landed = {
        name: bronze.bronze(bronze.land(spark, name, raw[name], f"{root}/landing/{name}", at), name)
        for name in bronze.DATASETS
    }

    def layer(source, transform, name, process, step, message, count_before=True):
        return audited_overwrite(
            source, transform, f"{root}/{name}", log, process=process, step=step, dataset=name,
            message=message, count_before=count_before, at=at,
        )

    def cleaned(source, transform, name, message):
        return layer(source, transform, f"clean/{name}", "SPARK", "CLEANING", message)

    def model(source, transform, name):
        return layer(
            source, transform, name, "MODEL", "BUSINESS LOGIC", "Applied transformations for this model",
            count_before=False,
        )

    clean_airlines = cleaned(
        landed["airlines"], lambda df: silver.clean_airlines(df, at), "airlines",
        "Codes in capitals, names trimmed, load time added",
    )
    clean_airports = cleaned(
        landed["airports"], lambda df: silver.clean_airports(df, at), "airports",
        "City, state and country normalised, coordinates cast, null rows removed",
    )
    feeds = union_feeds(landed["flights_history"], landed["flights_latest"])
    clean_flights = cleaned(
        feeds, lambda df: silver.clean_flights(df, at), "flights", "Cleaned raw data, computed total delay",
    )
    airlines = model(clean_airlines, silver.enrich_airlines, "silver/airlines")
    airports = model(clean_airports, silver.enrich_airports, "silver/airports")
    flights = model(clean_flights, silver.enrich_flights, "silver/flights")

    dim_airlines = model(airlines, gold.dim_airlines, "gold/dim_airlines")
    dim_airports = model(airports, gold.dim_airports, "gold/dim_airports")
    dim_date = overwrite_parquet(gold.dim_date(flights), f"{root}/gold/dim_date")
    spec = flight_spec(["airline", "flight_number"])
    states, kept = flight_states(flights, spec), f"{root}/gold/flight_history"
    last = last_finished(spark, kept)
    apply_batch(states, 0 if last is None else last + 1, kept, spec, buckets=buckets)
    dim_flights = overwrite_parquet(
        with_version_id(read_history(spark, kept, states.schema, spec), spec, gold.VERSION_KEY), f"{root}/gold/dim_flights")
    versioned = gold.with_flight_version(flights, dim_flights, spec)
    # Rebalancing collects a month into few files, and AQE splits a month that is too large for one.
    fact = overwrite_parquet(
        gold.fact_flights(versioned, dim_airlines, dim_airports, dim_date)
        .withColumns({"year": F.year("flight_date"), "month": F.month("flight_date")})
        .hint("rebalance", "year", "month"),
        f"{root}/gold/fact_flights", ["year", "month"],
    ).drop("year", "month")
    measures = Measures()
    metrics = {
        name: overwrite_parquet(period_metrics(fact, grain, measures), f"{root}/gold/{name}_metrics")
        for name, grain in {"daily": DAILY, "monthly": MONTHLY, "quarterly": QUARTERLY}.items()
    }
    return Tables(
        airlines, airports, flights, dim_airlines, dim_airports, dim_date, dim_flights, fact,
        metrics["daily"], metrics["monthly"], metrics["quarterly"], spark.read.parquet(log),
    )
