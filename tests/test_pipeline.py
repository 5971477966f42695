"""The batch from raw files to reports on a few made-up flights, and on real files where given."""

import datetime as dt
import os

import pytest
from helpers import rows
from pyspark.sql import functions as F

from aerolith.operators import reports
from aerolith.plans import bronze, live, silver
from aerolith.plans.flight_history import flight_spec
from aerolith.plans.pipeline import run_batch
from aerolith.schemas import AIRLINE_COLUMNS, AIRPORT_COLUMNS, FLIGHT_COLUMNS
from aerolith.sources.readers import stamp_load

STAMP = dt.datetime(2025, 11, 26, 1, 23)

AIRLINES = [("ua ", " United Air Lines Inc. "), ("B6", "JetBlue Airways"), ("XXX", "long-haul air")]
AIRPORTS = [
    ("DFW", "Dallas/Fort Worth International", "DALLAS-FORT WORTH", "tx", "usa", "32.89595", "-97.0372"),
    ("SFO", "San Francisco International", "San Francisco", "CA", "USA", "37.619", "-122.37484"),
    ("UST", "Northeast Florida", "St. Augustine", "FL", "USA", "", ""),
    ("", "No code", "Nowhere", "NV", "USA", "1", "2"),
]


def flight(**given):
    base = dict(
        year="2015", month="1", day="1", day_of_week="4", airline="UA", flight_number="1", tail_number="N1",
        origin_airport="SFO", destination_airport="DFW", scheduled_departure="0005", departure_time="0004",
        departure_delay="-1", arrival_delay="0", distance="1464", diverted="0", cancelled="0",
    )
    row = base | given
    return tuple(row.get(name, "") for name in FLIGHT_COLUMNS)


HISTORY = [
    flight(),
    flight(flight_number="2", airline="b6", departure_delay="10", arrival_delay="6", weather_delay="31", distance="499"),
    flight(flight_number="3", departure_delay="", arrival_delay="", departure_time="", cancelled="1", cancellation_reason="A"),
    flight(flight_number="4", airline="ZZ", arrival_delay="62", destination_airport="XYZ", diverted="1", distance="1501"),
    flight(flight_number="5", origin_airport=""),
]
LATEST = [flight(month="4", day="10", day_of_week="7", departure_delay="5", arrival_delay="10", weather_delay="1")]


def write_csv(path, columns, data):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/part.csv", "w") as file:
        file.write(",".join(name.upper() for name in columns) + "\n")
        for row in data:
            file.write(",".join(row) + "\n")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    raw = tmp_path_factory.mktemp("raw")
    for name, columns, data in [
        ("airlines", [c.upper() for c in AIRLINE_COLUMNS], AIRLINES), ("airports", AIRPORT_COLUMNS, AIRPORTS),
        ("flights_history", FLIGHT_COLUMNS, HISTORY), ("flights_latest", FLIGHT_COLUMNS, LATEST),
    ]:
        write_csv(f"{raw}/{name}", columns, data)
    return run_batch(spark, {name: f"{raw}/{name}" for name in bronze.DATASETS}, str(tmp_path_factory.mktemp("out")), STAMP)


def test_airlines(tables):
    assert rows(tables.dim_airlines, "iata_code", "airline_name", "airline_category", "code_validation", "record_date") == [
        ("B6", "Jetblue Airways", "LOW_COST", "VALID", STAMP.date()),
        ("UA", "United Airlines", "MAJOR", "VALID", STAMP.date()),
        ("XXX", "Long-Haul Air", "REGIONAL", "INVALID", STAMP.date())]


def test_airports(tables):
    assert rows(tables.dim_airports, "iata_code", "city", "state", "country", "latitude", "region",
                "airport_size_category", "location_validation", "record_year") == [
        ("DFW", "Dallas-Fort Worth", "TX", "USA", 32.89595, "SOUTH", "MEDIUM", "VALID", 2025),
        ("SFO", "San Francisco", "CA", "USA", 37.619, "WEST", "LARGE", "VALID", 2025),
        ("UST", "St. Augustine", "FL", "USA", None, "SOUTH", "MEDIUM", "INVALID", 2025)]


def test_flights(tables):
    assert rows(tables.flights, "flight_number", "month", "airline", "total_delay", "delay_category",
                "distance_category", "day_type", "flight_status", "weather_impact", "on_time_flag",
                "cancellation_reason", "scheduled_departure") == [
        ("1", 1, "UA", -1, "NO_DELAY", "MEDIUM_HAUL", "WEEKDAY", "COMPLETED", "NO_WEATHER_IMPACT", 1, "NONE", "0005"),
        ("1", 4, "UA", 15, "SHORT", "MEDIUM_HAUL", "WEEKEND", "COMPLETED", "WEATHER_LOW", 0, "NONE", "0005"),
        ("2", 1, "B6", 16, "MEDIUM", "SHORT_HAUL", "WEEKDAY", "COMPLETED", "WEATHER_HIGH", 0, "NONE", "0005"),
        ("3", 1, "UA", None, "LONG", "MEDIUM_HAUL", "WEEKDAY", "CANCELLED", "NO_WEATHER_IMPACT", 0, "A", "0005"),
        ("4", 1, "ZZ", 61, "LONG", "LONG_HAUL", "WEEKDAY", "DIVERTED", "NO_WEATHER_IMPACT", 0, "NONE", "0005")]


def test_fact_keeps_every_flight(tables):
    fact = tables.fact_flights
    assert fact.count() == tables.flights.count() == 5
    assert fact.filter("airline_sk IS NULL").count() == 1
    assert fact.filter("destination_airport_sk IS NULL").count() == 1
    assert fact.filter("date_sk IS NULL OR origin_airport_sk IS NULL").isEmpty()
    assert rows(fact.select("flight_date").distinct()) == [(dt.date(2015, 1, 1),), (dt.date(2015, 4, 10),)]


def test_fact_carries_the_key_of_its_version(tables):
    fact, versions = tables.fact_flights, tables.dim_flights
    assert fact.filter("dim_flight_id IS NULL").isEmpty()
    assert fact.join(versions.filter("is_current = 'Y'"), "dim_flight_id").count() == 5
    assert rows(versions.filter("is_current = 'Y'"), "airline", "flight_number") == [("B6", "2"), ("UA", "1"), ("UA", "3"), ("ZZ", "4")]


def test_a_second_run_adds_to_the_history(spark, tables, tmp_path):
    for name, columns, data in [
        ("airlines", AIRLINE_COLUMNS, AIRLINES), ("airports", AIRPORT_COLUMNS, AIRPORTS), ("flights_history", FLIGHT_COLUMNS, HISTORY),
    ]:
        write_csv(f"{tmp_path}/raw/{name}", columns, data)
    raw = {name: f"{tmp_path}/raw/{name}" for name in bronze.DATASETS}
    later = STAMP + dt.timedelta(days=1)
    for stamp, delay in ((STAMP, "5"), (later, "50")):
        changed = [{**dict(zip(FLIGHT_COLUMNS, row)), "departure_delay": delay} for row in LATEST]
        write_csv(f"{tmp_path}/raw/flights_latest", FLIGHT_COLUMNS, [tuple(row.values()) for row in changed])
        run = run_batch(spark, raw, f"{tmp_path}/out", stamp, buckets=2)
    closed = run.dim_flights.filter("is_current = 'N' AND effective_end > effective_start")
    assert not closed.isEmpty() and rows(closed.select("effective_end").distinct()) == [(later,)]
    assert run.fact_flights.join(run.dim_flights.filter("is_current = 'Y'"), "dim_flight_id").count() == run.fact_flights.count()


def test_metrics(tables):
    assert rows(tables.daily, "metric_date", "total_delayed_flights", "total_cancelled_flights", "avg_delay", "quarter") == [
        (dt.date(2015, 1, 1), 2, 1, 68 / 3, "Q1"), (dt.date(2015, 4, 10), 1, 0, 10.0, "Q2")]
    assert rows(tables.monthly, "month_date", "total_flights") == [(dt.date(2015, 1, 1), 4), (dt.date(2015, 4, 1), 1)]
    assert rows(tables.quarterly, "metric_quarter", "total_flights") == [("2015-Q1", 4), ("2015-Q2", 1)]


def test_audit_counts(tables):
    got = rows(tables.audit.filter("process_name = 'SPARK'"), "dataset_name", "row_count_before", "row_count_after")
    assert got == [("clean/airlines", 3, 3), ("clean/airports", 4, 3), ("clean/flights", 6, 5)]
    assert tables.audit.filter("process_name = 'MODEL' AND row_count_before IS NULL").count() == 5


def test_quality(tables):
    failed = rows(tables.quality().filter("status = 'FAIL'"), "table_name", "check_name", "columns", "failures")
    assert failed == [
        ("silver_flights", "not_null", "arrival_delay", 1), ("silver_flights", "not_null", "departure_delay", 1),
        ("silver_flights", "not_null", "total_delay", 1), ("silver_flights", "relationship", "airline", 1),
        ("silver_flights", "relationship", "destination_airport", 1)]


def test_fact_is_written_by_month(tables, spark):
    files = tables.fact_flights.inputFiles()
    assert {part for file in files for part in file.split("/") if part.startswith("month=")} == {"month=1", "month=4"}


def test_text_numbers_that_do_not_parse_become_null(spark):
    raw = spark.createDataFrame([flight(departure_delay="x", air_system_delay="")], ", ".join(f"{c} string" for c in FLIGHT_COLUMNS))
    got = silver.clean_flights(bronze.bronze(raw, "flights_history"), STAMP).first()
    assert (got.departure_delay, got.air_system_delay, got.total_delay, got.taxi_out) == (None, 0, None, None)


GOLDEN = os.environ.get("AEROLITH_GOLDEN_DIR")


@pytest.mark.skipif(not GOLDEN, reason="AEROLITH_GOLDEN_DIR names no folder with the raw files")
def test_published_figures(spark, folder):
    """Figures of 2015-01-01 and 2015-01-10; the folder holds one sub-folder per dataset."""
    t = run_batch(spark, {name: f"{GOLDEN}/{name}" for name in bronze.DATASETS}, folder, STAMP)
    daily = t.daily.select("metric_date", "total_delayed_flights", "total_cancelled_flights", F.round("avg_delay", 6).alias("a"))
    assert rows(daily) == [(dt.date(2015, 1, 1), 70, 9, 2.075269), (dt.date(2015, 1, 10), 35, 1, -0.795918)]
    by = {r[0]: r[1] for r in rows(t.flights.groupBy("delay_category").count())}
    assert by == {"NO_DELAY": 183, "SHORT": 44, "MEDIUM": 29, "LONG": 38}
    assert rows(reports.key_figures(t.fact_flights)) == [(294, 105, 10, 1.08)]
    worst = rows(reports.worst_routes(t.fact_flights, t.dim_airports), "arrival_delay")
    assert [r[0] for r in worst] == [58.5, 60.0, 69.0, 78.0, 85.0, 89.0, 102.0, 116.0, 128.0, 226.0]
    minutes = {r[0]: r[1] for r in rows(reports.delay_reasons(t.fact_flights))}
    assert minutes == {"air_system_delay": 358, "security_delay": 0, "airline_delay": 919,
                       "late_aircraft_delay": 292, "weather_delay": 670}
    failures = t.quality().filter("columns = 'arrival_delay' AND check_name = 'not_null'").first()["failures"]
    assert failures == 10


def test_latest_feed_streams_into_silver_and_history(spark, folder):
    text = ", ".join(f"{c} string" for c in FLIGHT_COLUMNS)
    spec = flight_spec(["airline", "flight_number"])

    def land(stamp, **given):
        df = stamp_load(spark.createDataFrame([flight(**given)], text), stamp)
        df.coalesce(1).write.mode("append").parquet(f"{folder}/landing")

    def run(stamp):
        live.load_latest(spark, f"{folder}/landing", f"{folder}/silver", f"{folder}/c1", stamp).awaitTermination()
        silver_table = spark.read.parquet(f"{folder}/silver")
        live.track_flights(spark, f"{folder}/silver", silver_table.schema, f"{folder}/history", f"{folder}/c2",
                           spec).awaitTermination()
        return silver_table, live.flight_history(spark, silver_table, f"{folder}/history", spec)

    first, second = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)
    land(first, departure_time="1410")
    run(first)
    land(second, departure_time="1500", departure_delay="60")
    land(second, flight_number="8", airline="b6")
    silver_table, history = run(second)
    assert silver_table.count() == 3
    again, history = run(second)
    assert again.count() == 3
    assert rows(history, "airline", "flight_number", "departure_time", "total_delay", "effective_end", "is_current") == [
        ("B6", "8", 4, -1, None, "Y"), ("UA", "1", 1410, -1, second, "N"), ("UA", "1", 1500, 60, None, "Y")]
