import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.functions import dates, numbers, rules, text
from aerolith.functions.keys import auto_number, calendar_key, surrogate_key

lit = F.lit


@pytest.mark.parametrize("given, expected", [
    ("dallas-fort worth", "Dallas-Fort Worth"), ("ARCATA/EUREKA", "Arcata/Eureka"), ("McAllen", "Mcallen"),
    ("coeur d'alene", "Coeur D'alene"), ("são paulo", "São Paulo"), ("st. louis  (mo)", "St. Louis  (Mo)"),
    ("a_b&c\\d[e]{f}", "A_B&C\\D[E]{F}"), ("", ""), (None, None),
])
def test_initcap_words(one, given, expected):
    assert one(text.initcap_words(lit(given).cast("string"))) == expected


def test_names_follow_the_first_pattern(spark):
    names = ["american airlines inc.", "American Eagle", "united/DELTA", "DELTA air", "US Airways Inc.", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(text.normalise_name(F.col("n"), rules.AIRLINE_NAME_PATTERNS)).collect()]
    assert got == ["American Airlines", "American Eagle", "United Airlines", "Delta Airlines", "Us Airways Inc.", None]


def test_place_label_nulls(one):
    city, code, none = lit("Buffalo"), lit("BUF"), lit(None).cast("string")
    assert one(text.place_label(city, lit("NY"), code)) == "Buffalo, NY (BUF)"
    assert one(text.place_label(city, lit("NY"))) == "Buffalo, NY"
    assert one(text.place_label(city, none, code)) is None
    assert one(text.place_label(city, none, code, missing_state="")) == "Buffalo,  (BUF)"
    assert one(text.place_label(none, lit("NY"), code, missing_state="")) is None


@pytest.mark.parametrize("raw, expected", [("0005", 5), ("-11", -11), ("", None), ("x", None), (None, None), (" 7 ", 7)])
def test_to_int(one, raw, expected):
    assert one(numbers.to_int(lit(raw).cast("string"))) == expected


def test_defaults_keep_the_type(spark):
    df = spark.createDataFrame([("4",), (None,), ("",)], "d string")
    out = df.select(numbers.or_default(F.col("d"), 0).alias("i"), numbers.or_default(F.col("d"), "NONE").alias("s"))
    assert dict(out.dtypes) == {"i": "int", "s": "string"}
    assert [tuple(r) for r in out.collect()] == [(4, "4"), (0, "NONE"), (0, "")]


def test_round_even_equals_numpy(spark):
    values = [2.345, 1.015, 1.005, -0.125, 0.125, 2.675, 1e9 + 0.005, -7.5, 0.0, 1.0844999, 33.335]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(numbers.round_even(F.col("v"))).collect()] == list(np.round(values, 2))


def test_dates(one):
    day = lit(dt.date(2015, 11, 30))
    assert one(dates.date_from_parts(lit(2015), lit(1), lit(9))) == dt.date(2015, 1, 9)
    assert one(dates.date_from_parts(lit(2015), lit(13), lit(1))) is None
    assert one(dates.date_from_parts(lit(2015), lit(2), lit(29))) is None
    assert one(dates.date_from_parts(lit(2015), lit(None).cast("int"), lit(1))) is None
    assert one(dates.month_start(day), dates.quarter_start(day)) == (dt.date(2015, 11, 1), dt.date(2015, 10, 1))
    assert one(dates.quarter_name(day), dates.year_quarter_name(day)) == ("Q4", "2015-Q4")
    assert one(dates.rough_quarter_date(day)) == dt.date(2015, 9, 28)
    assert one(dates.day_text(day)) == "2015-11-30"


def test_micros_agree_between_time_types(spark):
    stamp = "2024-02-29 23:59:59.123457"
    df = spark.sql(f"SELECT TIMESTAMP_NTZ '{stamp}' AS n, TIMESTAMP '{stamp}' AS z")
    got = df.select(dates.micros(F.col("n"), "timestamp_ntz"), dates.micros(F.col("z"), "timestamp")).first()
    assert got[0] == got[1] == 1709251199123457


def test_sequence_makes_equal_times_distinct(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), i) for i in range(3)], "ts timestamp_ntz, seq long")
    got = [r[0] for r in df.select(dates.later_by_micros(F.col("ts"), F.col("seq"))).collect()]
    assert got == [dt.datetime(2024, 1, 1, 0, 0, 0, i) for i in range(3)]


def test_surrogate_keys(one):
    assert one(surrogate_key(lit("UA"))) == "3943d8795e03e8e3307b5b71eac1b669"
    assert one(surrogate_key(lit(2015), lit(1), lit(1))) == one(F.md5(lit("2015|1|1")))
    assert one(surrogate_key(lit("a"), lit(None).cast("string"))) is None
    assert one(surrogate_key(lit("a|b"), lit("c"))) == one(F.md5(lit("a|b|c")))
    assert one(calendar_key(lit(dt.date(2015, 1, 1)))) == "7eb78036004e735c5fd01175d35ece0a"


def test_auto_number_is_unique_and_above(spark):
    df = auto_number(spark.range(1000).repartition(5), "no", after=820)
    got = [r["no"] for r in df.collect()]
    assert len(set(got)) == 1000 and min(got) == 821


@pytest.mark.parametrize("total, label, on_time", [
    (-5, "NO_DELAY", 1), (0, "NO_DELAY", 1), (1, "SHORT", 0), (15, "SHORT", 0), (16, "MEDIUM", 0), (60, "MEDIUM", 0),
    (61, "LONG", 0), (None, "LONG", 0),
])
def test_delay_rules(one, total, label, on_time):
    value = lit(total).cast("int")
    assert one(rules.delay_category(value), rules.on_time_flag(value)) == (label, on_time)


def test_delay_parameters(one):
    assert one(rules.delay_category(lit(20), threshold=25)) == "SHORT"
    assert one(rules.delay_category(lit(None).cast("int"), null_label="UNKNOWN")) == "UNKNOWN"
    assert one(rules.delay_category(lit(0), null_label="UNKNOWN")) == "NO_DELAY"


@pytest.mark.parametrize("miles, label", [
    (499, "SHORT_HAUL"), (500, "MEDIUM_HAUL"), (1500, "MEDIUM_HAUL"), (1501, "LONG_HAUL"), (None, "LONG_HAUL"),
])
def test_distance(one, miles, label):
    assert one(rules.distance_category(lit(miles).cast("int"))) == label


@pytest.mark.parametrize("minutes, label", [
    (31, "WEATHER_HIGH"), (30, "WEATHER_LOW"), (1, "WEATHER_LOW"), (0, "NO_WEATHER_IMPACT"), (None, "NO_WEATHER_IMPACT"),
])
def test_weather(one, minutes, label):
    assert one(rules.weather_impact(lit(minutes).cast("int"))) == label


def test_day_type_codes(one):
    assert [one(rules.day_type(lit(c))) for c in (1, 6, 7)] == ["WEEKEND", "WEEKDAY", "WEEKEND"]
    assert [one(rules.day_type(lit(c), (6, 7))) for c in (1, 6, 7)] == ["WEEKDAY", "WEEKEND", "WEEKEND"]


@pytest.mark.parametrize("cancelled, diverted, status", [
    (1, 1, "CANCELLED"), (0, 1, "DIVERTED"), (None, 1, "DIVERTED"), (0, 0, "COMPLETED"), (None, None, "COMPLETED"),
])
def test_status(one, cancelled, diverted, status):
    assert one(rules.flight_status(lit(cancelled).cast("int"), lit(diverted).cast("int"))) == status


@pytest.mark.parametrize("state, country, size, region", [
    ("CA", "USA", "LARGE", "WEST"), ("TX", "USA", "MEDIUM", "SOUTH"), ("NJ", "USA", "REGIONAL", "NORTHEAST"),
    ("IL", "USA", "MEDIUM", "MIDWEST"), ("HI", "USA", "REGIONAL", "INTERNATIONAL"),
    ("ON", "CAN", "INTERNATIONAL", "INTERNATIONAL"), (None, None, "REGIONAL", "INTERNATIONAL"),
])
def test_airport_groups(one, state, country, size, region):
    s, c = lit(state).cast("string"), lit(country).cast("string")
    assert one(rules.airport_size(s, c), rules.airport_region(s)) == (size, region)


def test_other_groups(one):
    assert [one(rules.airport_continent(lit(c).cast("string"))) for c in ("USA", "MEX", "JPN", "NLD", "BRA", None)] == [
        "NORTH_AMERICA", "NORTH_AMERICA", "ASIA", "EUROPE", "OTHER", "OTHER"]
    assert [one(rules.airline_category(lit(c))) for c in ("WN", "VX", "HA")] == ["MAJOR", "LOW_COST", "REGIONAL"]
    assert [one(rules.code_validation(lit(c).cast("string"))) for c in ("UA", "UAL", None)] == ["VALID", "INVALID", "INVALID"]


@pytest.mark.parametrize("lat, lon, city, expected", [
    (90.0, -180.0, "X", "VALID"), (90.1, 0.0, "X", "INVALID"), (0.0, 181.0, "X", "INVALID"),
    (None, 0.0, "X", "INVALID"), (0.0, 0.0, None, "INVALID"),
])
def test_location(one, lat, lon, city, expected):
    assert one(rules.location_validation(
        lit(lat).cast("double"), lit(lon).cast("double"), lit(city).cast("string"))) == expected
