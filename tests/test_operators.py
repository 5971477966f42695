import datetime as dt

import pytest
from helpers import at, rows
from pyspark.sql import functions as F

from aerolith.operators import asof, changes, filters, joins, periods, quality, reports
from aerolith.operators import rows as row_ops
from aerolith.plans.gold import days_between, dim_calendar, dim_date, year_calendar

DAY = dt.date

pytestmark = pytest.mark.usefixtures("interpreted")


def test_between_dates_includes_both_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, d, h),) for d in (1, 2, 3, 4) for h in (0, 23)], "t timestamp_ntz")
    got = filters.between_dates(df, "t", "2024-01-02", "2024-01-03")
    assert [r.t.day for r in got.collect()] == [2, 2, 3, 3]
    days = df.select(F.col("t").cast("date").alias("t"))
    assert filters.between_dates(days, "t", dt.date(2024, 1, 2), dt.date(2024, 1, 3)).count() == 4
    assert filters.between_dates(df, "t").count() == 8
    assert filters.between_dates(df, "t", last="2024-01-01").count() == 2


def test_membership_and_semi_join(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    assert filters.member_of(df, "v", []).count() == filters.member_of(df, "v", None).count() == 3
    assert rows(filters.member_of(df, "v", ["b", "z"])) == [(2, "b")]
    lookup = spark.createDataFrame([("a",), ("a",), (None,)], "code string")
    assert rows(filters.matching(df, "v", lookup, "code"), "k", "v") == [(1, "a")]


def test_keep_present_and_has_values(spark):
    df = spark.createDataFrame([(1, None), (None, "x"), (2, "y")], "a int, b string")
    assert rows(filters.keep_present(df, ["a", "b"])) == [(2, "y")]
    assert filters.has_values(df, "A") and not filters.has_values(df, "c")
    assert not filters.has_values(df.filter("a = 1"), "b")


def test_look_up_in_two_roles(spark):
    fact = spark.createDataFrame([("A", "B"), ("B", "Z"), (None, "A")], "origin string, destination string")
    dim = spark.createDataFrame([("A", "sa"), ("B", "sb")], "code string, sk string")
    out = joins.star_join(fact, [
        joins.Lookup(dim, {"origin": "code"}, {"origin_sk": "sk"}),
        joins.Lookup(dim, {"destination": "code"}, {"destination_sk": "sk"}),
    ])
    assert rows(out) == [(None, "A", None, "sa"), ("A", "B", "sa", "sb"), ("B", "Z", "sb", None)]


def test_look_up_by_composite_key_with_equal_names(spark):
    fact = spark.createDataFrame([(2015, 1), (2015, None)], "year int, month int")
    dim = spark.createDataFrame([(2015, 1, "k")], "year int, month int, sk string")
    out = joins.look_up(fact, joins.Lookup(dim, {"year": "year", "month": "month"}, {"sk": "sk"}))
    assert rows(out) == [(2015, None, None), (2015, 1, "k")]


def test_repeated_rows_of_dimensions_are_joined_once(spark):
    fact = spark.createDataFrame([(1, "A", "X"), (2, "B", "X"), (3, "Z", None), (4, "A", "Y")], "n int, origin string, destination string")
    codes = [("A", "sa")] * 7 + [("A", "other")] * 2 + [("B", "sb"), (None, "none")]
    dim = spark.createDataFrame(codes, "code string, sk string")
    places = spark.createDataFrame([("X", 1)] * 2 + [("Y", 2)], "code string, sk int")

    def joined(repeated):
        return joins.star_join(fact, [
            joins.Lookup(dim, {"origin": "code"}, {"origin_sk": "sk"}, repeated),
            joins.Lookup(places, {"destination": "code"}, {"destination_sk": "sk"}, repeated),
        ], ["n", "origin_sk", (F.col("destination_sk") + 1).alias("place")])

    out = joined(True)
    assert rows(out) == rows(joined(False)) and out.columns == ["n", "origin_sk", "place"]
    assert out.filter("n = 1 AND origin_sk = 'sa'").count() == 14 and out.count() == 30


def test_repeated_rows_lying_together_are_dealt_out_evenly(spark):
    fact = spark.range(0, 4000, 1, 4).selectExpr("id", "if(id < 1000, 'A', 'B') AS code", "map(id, 'x') AS notes")
    dim = spark.createDataFrame([("A", "sa")] * 50 + [("B", "sb")], "code string, sk string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        days = spark.range(4000).selectExpr("id AS day", "'d' AS day_sk")
        out = joins.star_join(fact, [
            joins.Lookup(dim, {"code": "code"}, {"sk": "sk"}, True), joins.Lookup(days, {"id": "day"}, {"day_sk": "day_sk"}),
        ])
        assert out.columns == ["id", "code", "notes", "sk", "day_sk"] and out.count() == 1000 * 50 + 3000 and out.filter("notes[id] = 'x'").count() == 53000
        most = max(row["n"] for row in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())
        assert most < 53000 / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_rows_without_a_value_to_hash(spark):
    fact = spark.createDataFrame([({"k": 1},)], "notes map<string,int>")
    dim = spark.createDataFrame([(1, "s")] * 3, "code int, sk string")
    out = joins.star_join(fact.withColumn("code", F.lit(1)), [joins.Lookup(dim, {"code": "code"}, {}, True)], ["notes"])
    assert rows(out) == [({"k": 1},)] * 3


def test_fill_date(spark):
    calendar = dim_date(spark.createDataFrame([(2015, 1, 9), (2015, 12, 31)], "year int, month int, day int"))
    keys = calendar.select("date_sk")
    expected = [(DAY(2015, 1, 9),), (DAY(2015, 12, 31),)]
    assert rows(joins.fill_date(keys, calendar, "flight_date", "date_sk"), "flight_date") == expected
    empty = keys.withColumn("flight_date", F.lit(None).cast("date"))
    assert rows(joins.fill_date(empty, calendar, "flight_date", "date_sk"), "flight_date") == expected
    given = keys.withColumn("flight_date", F.lit(DAY(2000, 1, 1)))
    assert rows(joins.fill_date(given, calendar, "flight_date", "date_sk"), "flight_date") == [(DAY(2000, 1, 1),)] * 2


def test_calendar(spark):
    year = year_calendar(spark, 2015)
    assert year.count() == 365
    assert year.filter("month = 1 AND day = 1").first()["date_sk"] == "7eb78036004e735c5fd01175d35ece0a"
    bounds = spark.sql("SELECT DATE '2016-02-28' AS a, DATE '2016-03-01' AS z")
    days = dim_calendar(days_between(bounds, "a", "z"), key_format="parts")
    assert rows(days, "month", "day") == [(2, 28), (2, 29), (3, 1)]
    parts = bounds.select(F.lit(2016).alias("year"), F.lit(2).alias("month"), F.lit(29).alias("day"))
    assert dim_date(parts).first()["date_sk"] in {r["date_sk"] for r in days.collect()}


FLIGHTS = [
    (DAY(2015, 12, 31), 10, 0), (DAY(2015, 12, 31), -4, 0), (DAY(2015, 12, 31), None, 1),
    (DAY(2016, 1, 1), 0, 0), (DAY(2016, 4, 2), None, 1),
]


def flights(spark, data=FLIGHTS):
    return spark.createDataFrame(data, "flight_date date, arrival_delay int, cancelled int")


def test_daily_metrics(spark):
    got = periods.period_metrics(flights(spark), periods.DAILY)
    assert rows(got) == [
        (DAY(2015, 12, 31), 12, 2015, "Q4", 1, 1, 3.0), (DAY(2016, 1, 1), 1, 2016, "Q1", 0, 0, 0.0),
        (DAY(2016, 4, 2), 4, 2016, "Q2", 0, 1, None)]


def test_monthly_and_quarterly_metrics(spark):
    got = periods.period_metrics(flights(spark), periods.MONTHLY)
    assert rows(got, "month_date", "total_flights", "avg_delay") == [
        (DAY(2015, 12, 1), 3, 3.0), (DAY(2016, 1, 1), 1, 0.0), (DAY(2016, 4, 1), 1, None)]
    got = periods.period_metrics(flights(spark), periods.QUARTERLY)
    assert rows(got, "metric_quarter", "year", "quarter", "total_cancelled_flights") == [
        ("2015-Q4", 2015, 4, 1), ("2016-Q1", 2016, 1, 0), ("2016-Q2", 2016, 2, 1)]


def test_incremental_equals_full_run_without_late_rows(spark):
    facts = flights(spark)
    for grain in (periods.DAILY, periods.MONTHLY, periods.QUARTERLY):
        full = rows(periods.period_metrics(facts, grain))
        nothing = periods.period_metrics(facts.limit(0), grain)
        assert rows(periods.add_new_periods(nothing, facts, grain), *nothing.columns) == full
        stored = periods.period_metrics(facts.filter("flight_date < '2016-01-01'"), grain)
        assert rows(periods.add_new_periods(stored, facts, grain), *nothing.columns) == full
        assert rows(periods.add_new_periods(periods.period_metrics(facts, grain), facts, grain), *nothing.columns) == full


def test_quarters_after_a_year_end_are_not_skipped(spark):
    """2016-Q2 comes after 2016-Q1 though a fourth quarter of 2015 is stored."""
    stored = periods.period_metrics(flights(spark).filter("flight_date < '2016-04-01'"), periods.QUARTERLY)
    got = periods.add_new_periods(stored, flights(spark), periods.QUARTERLY)
    assert [r[0] for r in rows(got, "metric_quarter")] == ["2015-Q4", "2016-Q1", "2016-Q2"]


def test_late_rows_are_ignored_or_recomputed(spark):
    late = flights(spark, [(DAY(2015, 12, 30), 50, 0), (DAY(2015, 12, 31), 50, 0)])
    facts = flights(spark).unionByName(late)
    stored = periods.period_metrics(flights(spark), periods.DAILY)
    assert rows(periods.add_new_periods(stored, facts, periods.DAILY)) == rows(stored)
    for grain in (periods.DAILY, periods.MONTHLY, periods.QUARTERLY):
        stored = periods.period_metrics(flights(spark), grain)
        full = periods.period_metrics(facts, grain)
        assert rows(periods.recompute_periods(stored, facts, late, grain), *full.columns) == rows(full)


def test_update_and_delete_treat_null_as_no(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, v string")
    updated = row_ops.update_rows(df, F.col("v") == "a", {"v": F.lit("Z"), "k": F.col("k") * 10})
    assert updated.schema == df.schema
    assert rows(updated) == [(2, None), (3, "b"), (10, "Z")]
    assert rows(row_ops.delete_rows(df, F.col("v") == "a")) == [(2, None), (3, "b")]


def test_clone_is_independent(spark, folder):
    df = spark.range(3)
    copy = row_ops.clone(df, f"{folder}/copy")
    row_ops.clone(row_ops.delete_rows(copy, F.col("id") == 1), f"{folder}/second")
    assert copy.count() == 3


def test_table_changes(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None)], "k int, v string")
    after = spark.createDataFrame([("A", 1), ("b", 2), (None, 3), ("n", 4)], "v string, k int")
    got = changes.table_changes(before, after)
    assert rows(got) == [(1, "A", "INSERT", 1), (1, "a", "DELETE", 1), (2, "b", "DELETE", 1), (4, "n", "INSERT", 1)]
    assert rows(changes.inserts(got), "k") == [(1,), (4,)]
    assert changes.table_changes(before, before).isEmpty()


def test_differs_is_null_safe(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 2), (None, None)], "a int, b int")
    assert [r[0] for r in df.select(changes.differs([F.col("a")], [F.col("b")])).collect()] == [False, True, True, False]


LOG = [
    (1, at(0), 1, "a", "INSERT"), (1, at(10), 2, "b", "INSERT"), (1, at(10), 3, "c", "INSERT"),
    (2, at(5), 4, "x", "INSERT"), (2, at(20), 5, None, "DELETE"), (3, at(30), 6, "z", "INSERT"),
]


def change_log(spark):
    return spark.createDataFrame(LOG, "k int, ts timestamp_ntz, seq long, v string, _action string")


def instant(minute):
    return F.lit(str(at(minute))).cast("timestamp_ntz")


def test_as_of(spark):
    log = change_log(spark)

    def state(minute=None):
        moment = asof.AT_END if minute is None else instant(minute)
        return rows(asof.as_of(log, ["k"], "ts", moment, "seq"), "k", "v")

    assert state(-1) == []
    assert state(5) == [(1, "a"), (2, "x")]
    assert state(10) == [(1, "c"), (2, "x")]
    assert state(25) == [(1, "c")]
    assert state() == [(1, "c"), (3, "z")]
    ago = asof.as_of(log, ["k"], "ts", asof.seconds_ago(instant(15), 600), "seq")
    assert rows(ago, "k", "v") == [(1, "a"), (2, "x")]


def test_as_of_diff_equals_the_difference_of_two_states(spark):
    log = change_log(spark)
    got = asof.as_of_diff(log, ["k"], "ts", instant(5), instant(40), ["v"], "seq")
    assert rows(got) == [(1, "a", "c"), (2, "x", None), (3, None, "z")]
    states = [asof.as_of(log, ["k"], "ts", instant(m), "seq") for m in (5, 40)]
    assert rows(asof.diff_states(*states, ["k"], ["v"])) == rows(got)
    assert asof.as_of_diff(log, ["k"], "ts", instant(11), instant(12), ["v"], "seq").isEmpty()


def test_update_can_be_read_back_as_it_was(spark):
    """A status edited now is still the old one in the state 600 seconds before."""
    log = spark.createDataFrame(
        [(10, at(0), 1, "COMPLETED"), (11, at(0), 2, "COMPLETED"), (10, at(30), 3, "DELAYED_DEMO_EDIT")],
        "id int, ts timestamp_ntz, seq long, flight_status string")
    now = asof.as_of(log, ["id"], "ts", seq="seq")
    before = asof.as_of(log, ["id"], "ts", asof.seconds_ago(instant(31), 600), "seq")
    assert rows(now.filter("id = 10"), "flight_status") == [("DELAYED_DEMO_EDIT",)]
    assert rows(before.filter("id = 10"), "flight_status") == [("COMPLETED",)]


def checked(spark, data, schema, checks):
    return {(r.check_name, r.columns): (r.failures, r.status)
            for r in quality.run_checks(spark.createDataFrame(data, schema), "t", checks).collect()}


def test_checks(spark):
    data = [(1, "NO_DELAY", 5, at(0), at(1)), (1, "SEVERE", -3, at(1), at(0)), (None, None, None, None, at(0)),
            (None, "LONG", 99, at(0), at(0))]
    schema = "k int, c string, d int, s timestamp_ntz, e timestamp_ntz"
    parent = spark.createDataFrame([("NO_DELAY",)], "name string")
    got = checked(spark, data, schema, [
        *quality.not_null("k", "c"), quality.unique("k"), quality.unique("k", "c"),
        quality.accepted_values("c", ["NO_DELAY", "LONG"]), quality.in_range("d", 0, 50), quality.in_order("s", "e"),
        quality.relationship(["c"], parent, ["name"]), quality.expression("even", ["d"], F.col("d") % 2 == 0),
    ])
    assert got == {
        ("not_null", "k"): (2, "FAIL"), ("not_null", "c"): (1, "FAIL"), ("unique", "k"): (1, "FAIL"),
        ("unique", "k, c"): (0, "PASS"), ("accepted_values", "c"): (1, "FAIL"), ("range", "d"): (2, "FAIL"),
        ("time_order", "s, e"): (1, "FAIL"), ("relationship", "c"): (2, "FAIL"), ("even", "d"): (3, "FAIL"),
    }


def test_checks_on_an_empty_table(spark):
    parent = spark.createDataFrame([("a",)], "name string")
    got = checked(spark, [], "c string", [
        *quality.not_null("c"), quality.unique("c"), quality.relationship(["c"], parent, ["name"])])
    assert set(got.values()) == {(0, "PASS")}


def test_rejects_and_kept_rows_add_up(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (-1, None), (5, None)], "n int, s string")
    kept, rejected = quality.split_rejects(df, {"n positive": F.col("n") > 0, "s present": F.col("s").isNotNull()})
    assert rows(kept) == [(1, "a")]
    assert rows(rejected) == [
        (None, "b", "n positive"), (-1, None, "n positive, s present"), (5, None, "s present")]


def test_reconcile(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "g string")
    b = spark.createDataFrame([("x",), ("x",), ("z",)], "g string")
    assert rows(quality.reconcile(a, b, ["g"])) == [
        (None, 1, 0, 1, "MISMATCH"), ("x", 2, 2, 0, "MATCH"), ("y", 1, 0, 1, "MISMATCH"), ("z", 0, 1, -1, "MISMATCH")]
    assert rows(quality.reconcile(a, b)) == [(4, 3, 1, "MISMATCH")]
    assert rows(quality.reconcile(a.limit(0), b.limit(0))) == [(0, 0, 0, "MATCH")]


def test_outliers(spark):
    data = [("a", 10.0)] * 20 + [("a", 100.0), ("b", 1.0), ("b", 1.0), ("c", 7.0), ("a", None), (None, 3.0)]
    got = quality.flag_outliers(spark.createDataFrame(data, "g string, v double"), "v", ["g"], 3)
    assert rows(got.filter("is_outlier = 1"), "g", "v") == [("a", 100.0)]
    assert got.count() == len(data)
    assert got.filter("g IN ('b', 'c') OR v IS NULL OR g IS NULL").filter("z_score IS NOT NULL").isEmpty()


FACT = "airline_sk string, origin_airport_sk string, destination_airport_sk string, arrival_delay int, cancelled int, " \
       "weather_delay int, flight_date date"


def star(spark):
    d1, d2 = DAY(2015, 1, 1), DAY(2015, 1, 10)
    fact = spark.createDataFrame([
        ("s1", "a", "b", 10, 0, None, d1), ("s1", "a", "b", 15, 0, None, d1), ("s2", "b", "a", -5, 0, 3, d2),
        ("s2", "b", "a", None, 1, 4, d2), ("s2", "c", "a", None, 1, None, d2), (None, None, "a", 99, 0, 9, None)], FACT)
    airlines = spark.createDataFrame([("s1", "One", "O1"), ("s2", "Two", "T2")],
                                     "airline_sk string, airline_name string, iata_code string")
    airports = spark.createDataFrame(
        [("a", "AAA", "Alpha", "AL"), ("b", "BBB", "Beta", None)],
        "airport_sk string, iata_code string, city string, state string")
    return fact, airlines, airports


def test_route_reports(spark):
    fact, _, airports = star(spark)
    assert rows(reports.busiest_routes(fact, airports, 2), "flight_count", "origin_code", "origin_name", "dest_code", "dest_name") == [
        (2, "AAA", "Alpha, AL (AAA)", "BBB", None), (2, "BBB", None, "AAA", "Alpha, AL (AAA)")]
    worst = reports.worst_routes(fact, airports)
    assert rows(worst, "arrival_delay", "origin", "destination") == [
        (None, None, "Alpha, AL (AAA)"), (-5.0, "Beta,  (BBB)", "Alpha, AL (AAA)"),
        (12.5, "Alpha, AL (AAA)", "Beta,  (BBB)")]
    assert rows(reports.worst_routes(fact, airports, 2), "arrival_delay") == [(-5.0,), (12.5,)]
    heat = rows(reports.route_heatmap(fact, airports))
    assert ("AAA", "BBB", 12.5, "Alpha, AL", None) in heat and len(heat) == 3


def test_airline_reports(spark):
    fact, airlines, _ = star(spark)
    assert rows(reports.airline_delay(fact, airlines), "airline_name", "avg_arrival_delay") == [("One", 12.5), ("Two", -5.0)]
    assert rows(reports.cancellations(fact, airlines), "airline_name", "cancelled") == [("One", 0), ("Two", 2)]
    assert rows(reports.weather_minutes(fact, airlines), "airline_name", "weather_delay") == [("One", 0), ("Two", 7)]


def test_key_figures_and_trend(spark):
    fact, airlines, _ = star(spark)
    assert rows(reports.key_figures(fact)) == [(6, 3, 2, 29.75)]
    assert rows(reports.key_figures(fact.limit(0))) == [(0, 0, 0, None)]
    assert rows(reports.delay_trend(fact)) == [("2015-01-01", 12.5), ("2015-01-10", -5.0)]
    assert rows(reports.delay_reasons(fact, ["weather_delay", "cancelled"])) == [("cancelled", 2), ("weather_delay", 16)]
    bounds, codes = reports.filter_choices(fact, airlines)
    assert rows(bounds) == [(DAY(2015, 1, 1), DAY(2015, 1, 10))] and rows(codes) == [("One", "O1"), ("Two", "T2")]


def test_flight_filter(spark):
    fact, airlines, _ = star(spark)
    assert reports.select_flights(fact).count() == 6
    assert reports.select_flights(fact, airlines, ["Two"]).count() == 3
    assert reports.select_flights(fact, airlines, ["Two"], "2015-01-01", "2015-01-09").count() == 0
    assert reports.select_flights(fact, first="2015-01-01", last="2015-01-10").count() == 5
    airports = star(spark)[2]
    assert reports.select_flights(fact, airports=airports, origins=["BBB"], destinations=["AAA"]).count() == 2
    assert reports.select_flights(fact, airports=airports, origins=[]).count() == 6


def test_outliers_far_from_zero_and_close_together(spark):
    for offset, step in ((1e9, 1.0), (0.0, 0.001)):
        data = [("g", offset + step * (n % 3)) for n in range(300)]
        found = quality.flag_outliers(spark.createDataFrame(data, "g string, v double"), "v", ["g"], 3)
        assert abs(max(row.z_score for row in found.collect()) - 1.2227) < 0.01
