import datetime as dt
import random

import pytest
from helpers import at, rows
from pyspark.sql import functions as F

from aerolith.operators import history as h
from aerolith.operators.changes import ACTION
from aerolith.operators.history import CURRENT, END, START, HistorySpec
from aerolith.operators.ordered import SLICE, HotKeys, slice_hot_keys
from aerolith.plans.flight_history import flight_spec, flight_states, with_version_id
from aerolith.sources.writers import settle

pytestmark = pytest.mark.usefixtures("interpreted")

SCHEMA = "k string, ts timestamp_ntz, seq long, v string, note string"
SPEC = HistorySpec(["k"], ["v"], "ts", "seq")
EAGER = HotKeys(share=0.0, min_rows=8, cuts=6)  # every key with more than eight rows is hot


def log(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


def versions(df, *extra):
    return rows(df, "k", "v", START, END, CURRENT, *extra)


def random_log(seed, n=120, keys=4, values=3, instants=40, hot=True):
    """Changes with ties in time; one key has about half of them, many at one instant."""
    pick = random.Random(seed)
    data = []
    for i in range(n):
        key = "hot" if hot and pick.random() < 0.5 else f"k{pick.randrange(keys)}"
        minute = 7 if key == "hot" and pick.random() < 0.3 else pick.randrange(instants)
        data.append((key, at(minute), i, pick.choice([None, *"abcdef"[:values]]), f"n{i}"))
    pick.shuffle(data)
    return data


def by_hand(data):
    """The history by a plain loop over the sorted changes."""
    result = []
    for key in {r[0] for r in data}:
        chain = []
        for _, ts, _, v, note in sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2])):
            if not chain or chain[-1][0] != v:
                chain.append((v, ts, note))
        for i, (v, ts, note) in enumerate(chain):
            end = chain[i + 1][1] if i + 1 < len(chain) else None
            result.append((key, v, ts, end, "N" if end else "Y", note))
    return sorted(result, key=str)


def as_tuples(df):
    return sorted((tuple(r) for r in df.select("k", "v", START, END, CURRENT, "note").collect()), key=str)


# Slices

def test_slices_follow_the_order_and_split_hot_keys(spark):
    data = log(spark, random_log(1))
    sliced = slice_hot_keys(data, SPEC.order, HotKeys(share=0.0, min_rows=8, cuts=6))
    assert sliced.has_hot
    last = {}
    for r in sorted(sliced.df.collect(), key=lambda r: (r.k, r.ts, r.seq)):
        assert r[SLICE] >= last.get(r.k, "")
        last[r.k] = r[SLICE]
    sizes = {tuple(r)[:2]: r["count"] for r in sliced.df.groupBy("k", SLICE).count().collect()}
    assert max(sizes.values()) <= 8 and sum(sizes.values()) == data.count()


def test_no_hot_key_leaves_rows_alone(spark):
    data = log(spark, random_log(2))
    sliced = slice_hot_keys(data, SPEC.order)
    assert not sliced.has_hot and rows(sliced.df.select(SLICE).distinct()) == [("",)]


def test_hot_instant_is_cut_by_sequence(spark):
    data = log(spark, [("a", at(5), i, "x", "") for i in range(50)] + [("a", at(0), 99, "x", ""), ("a", at(9), 0, "x", "")])
    sliced = slice_hot_keys(data, SPEC.order, HotKeys(share=0.0, min_rows=10, cuts=8))
    assert max(r["count"] for r in sliced.df.groupBy("k", SLICE).count().collect()) <= 10


def test_far_and_bunched_rows_are_cut_as_often_as_needed(spark):
    """One far-off time, and sequence numbers bunched far below another: many cuts, no overflow."""
    data = [("a", at(5), i, f"v{i}", "") for i in range(600)] + [("a", at(5), 2**62, "w", ""), ("a", dt.datetime(9000, 1, 1), 0, "x", "")]
    history = h.scd2_rebuild(log(spark, data), SPEC, HotKeys(share=0.0, min_rows=20))
    assert as_tuples(history) == by_hand(data)


@pytest.mark.parametrize("hot", [None, HotKeys(share=0.0, min_rows=5)])
def test_layout_does_not_decide_between_equal_times(spark, hot):
    spec = HistorySpec(["k"], ["v"], "ts")
    data = [("a", at(1), i, "abc"[i % 3] if i % 7 else None, f"n{i // 2}") for i in range(60)]
    found = []
    for parts in (1, 3, 8):
        random.Random(parts).shuffle(data)
        changes = log(spark, data).drop("seq").repartition(parts)
        found.append(as_tuples(h.scd2_rebuild(changes, spec, hot)))
        other = None if hot else HotKeys(share=0.0, min_rows=5)
        found.append(as_tuples(h.scd2_rebuild(changes, spec, other)))
    assert len(found[0]) > 3 and all(one == found[0] for one in found)


@pytest.mark.parametrize("seed", range(2))
def test_sliced_windows_equal_plain_ones(spark, seed):
    data = log(spark, random_log(seed))
    found = []
    for hot in (None, EAGER):
        sliced = slice_hot_keys(data, SPEC.order, hot)
        out = sliced.with_previous(F.struct("v", "seq"), "before").with_next(F.col("seq"), "after")
        out = out.with_latest(F.when(F.col("v") != "a", F.struct("v", "seq")), "latest", F.lit(0))
        found.append(sorted((str(tuple(r)) for r in out.df.drop(SLICE).collect())))
    assert found[0] == found[1]


# Rebuild

@pytest.mark.parametrize("hot", [None, HotKeys(), EAGER])
def test_rebuild_equals_a_loop(spark, hot):
    data = random_log(10)
    assert as_tuples(h.scd2_rebuild(log(spark, data), SPEC, hot)) == by_hand(data)


def test_rebuild_invariants(spark):
    history = h.scd2_rebuild(log(spark, random_log(12, n=300)), SPEC, EAGER)
    open_rows = h.current_versions(history).groupBy("k").count()
    assert rows(open_rows.select("count").distinct()) == [(1,)]
    assert history.filter(F.col(END) < F.col(START)).isEmpty()
    assert history.filter(F.col(END).isNull() != (F.col(CURRENT) == "Y")).isEmpty()


def test_null_keys_stay_apart(spark):
    data = [(None, at(0), 1, "a", ""), (None, at(1), 2, "b", ""), ("x", at(0), 3, "a", "")]
    got = versions(h.scd2_rebuild(log(spark, data), SPEC, EAGER))
    assert got == [(None, "a", at(0), None, "Y"), (None, "b", at(1), None, "Y"), ("x", "a", at(0), None, "Y")]


def test_changes_from_and_to_null_count(spark):
    data = [("x", at(i), i, v, "") for i, v in enumerate([None, None, "a", None])]
    assert [r[1] for r in versions(h.scd2_rebuild(log(spark, data), SPEC), )] == [None, None, "a"]


def test_many_copies_of_one_change(spark):
    copies = [("x", at(1), 1, "a", "n")] * 30 + [("x", at(0), 0, "b", "n"), ("x", at(2), 2, "b", "n")]
    got = versions(h.scd2_rebuild(log(spark, copies), SPEC, EAGER))
    assert got == [("x", "a", at(1), at(2), "N"), ("x", "b", at(0), at(1), "N"), ("x", "b", at(2), None, "Y")]


def test_deletes_close_only_on_request(spark):
    data = [("x", at(0), 0, "a", "", "INSERT"), ("x", at(1), 1, "a", "", "DELETE"), ("x", at(3), 3, "a", "", "INSERT")]
    changes = log(spark, data, SCHEMA + f", {ACTION} string")
    assert versions(h.scd2_rebuild(changes, SPEC)) == [("x", "a", at(0), None, "Y")]
    closing = HistorySpec(["k"], ["v"], "ts", "seq", close_on_delete=True)
    assert versions(h.scd2_rebuild(changes, closing)) == [
        ("x", "a", at(0), at(1), "N"), ("x", "a", at(3), None, "Y")]


# Merge

def fold(spark, batches, **options):
    history = h.scd2_rebuild(log(spark, batches[0]), SPEC, None)
    for batch in batches[1:]:
        history = settle(h.scd2_merge(settle(history, "fold"), log(spark, batch), SPEC, options.get("hot")), "fold")
    return history


def test_merge_closes_and_opens_in_one_pass(spark):
    first = [("60001", at(0), 1, "1410 1842 -3 COMPLETED", "")]
    second = [("60001", at(1), 2, "1500 1855 45 DELAYED", "")]
    history = fold(spark, [first, second, second])
    assert versions(history) == [
        ("60001", first[0][3], at(0), at(1), "N"), ("60001", second[0][3], at(1), None, "Y")]


@pytest.mark.parametrize("hot", [None, EAGER])
def test_folding_batches_equals_the_rebuild(spark, hot):
    data = sorted(random_log(20, n=90), key=lambda r: (r[1], r[2]))
    history = fold(spark, [data[:30], data[30:31], data[31:90]], hot=hot)
    assert as_tuples(history) == by_hand(data)


def test_merging_a_batch_again_changes_nothing(spark):
    data = sorted(random_log(21, n=60), key=lambda r: (r[1], r[2]))
    once = fold(spark, [data[:30], data[30:]])
    assert as_tuples(h.scd2_merge(once, log(spark, data[30:]), SPEC, None)) == as_tuples(once)
    assert as_tuples(h.scd2_merge(once, log(spark, data[:30]), SPEC, None)) == as_tuples(once)


def test_late_changes_find_their_place(spark):
    """Values that never repeat: no dropped repeat could be missing."""
    data = [(f"k{i % 3}", at(i), i, f"v{i}", f"n{i}") for i in range(30)]
    late = [data[i] for i in (4, 5, 11, 20)]
    timely = [r for r in data if r not in late]
    assert as_tuples(fold(spark, [timely[:10], timely[10:], late])) == by_hand(data)


def test_merge_with_new_and_null_keys_and_last_only(spark):
    history = h.scd2_rebuild(log(spark, [("x", at(0), 0, "a", "")]), SPEC)
    batch = log(spark, [("x", at(1), 1, "b", ""), ("x", at(2), 2, "c", ""), ("y", at(1), 3, "a", ""), (None, at(1), 4, "z", "")])
    assert versions(h.scd2_merge(history, batch, SPEC, last_only=True)) == [
        (None, "z", at(1), None, "Y"), ("x", "a", at(0), at(2), "N"), ("x", "c", at(2), None, "Y"),
        ("y", "a", at(1), None, "Y")]
    assert h.scd2_merge(history, batch.limit(0), SPEC).count() == 1


def test_merge_with_deletes(spark):
    closing = HistorySpec(["k"], ["v"], "ts", "seq", close_on_delete=True)
    history = h.scd2_rebuild(log(spark, [("x", at(0), 0, "a", "")]), closing)
    gone = log(spark, [("x", at(1), 1, "a", "", "DELETE")], SCHEMA + f", {ACTION} string")
    history = h.scd2_merge(history, gone, closing)
    assert versions(history) == [("x", "a", at(0), at(1), "N")]
    back = log(spark, [("x", at(5), 2, "a", "", "INSERT")], SCHEMA + f", {ACTION} string")
    assert versions(h.scd2_merge(history, back, closing)) == [
        ("x", "a", at(0), at(1), "N"), ("x", "a", at(5), None, "Y")]


def test_two_step_merge_leaves_a_gap(spark):
    first, second = [("60001", at(0), 1, "COMPLETED", "")], [("60001", at(0), 2, "DELAYED", "")]
    now = [F.lit(str(at(m))).cast("timestamp_ntz") for m in (1, 2, 3)]
    empty = h.open_versions(log(spark, []).drop("ts"), now[0])
    one = h.scd2_merge_two_step(empty, log(spark, first), SPEC, now[0])
    assert versions(one) == [("60001", "COMPLETED", at(1), None, "Y")]
    two = h.scd2_merge_two_step(one, log(spark, second), SPEC, now[1])
    assert versions(two) == [("60001", "COMPLETED", at(1), at(2), "N")]
    three = h.scd2_merge_two_step(two, log(spark, second), SPEC, now[2])
    assert versions(three) == [
        ("60001", "COMPLETED", at(1), at(2), "N"), ("60001", "DELAYED", at(3), None, "Y")]
    assert versions(h.scd2_merge_two_step(three, log(spark, second), SPEC, now[2])) == versions(three)


def test_initial_load_keeps_every_row(spark):
    start = F.lit(dt.datetime(2025, 11, 30)).cast("timestamp_ntz")
    got = h.open_versions(spark.createDataFrame([("7", "a"), ("7", "a")], "k string, v string"), start)
    assert versions(got) == [("7", "a", dt.datetime(2025, 11, 30), None, "Y")] * 2


def test_history_of_a_key_is_latest_first(spark):
    history = h.scd2_rebuild(log(spark, [("x", at(i), i, str(i), "") for i in range(3)] + [("y", at(0), 9, "q", "")]), SPEC)
    assert [r.v for r in h.history_of(history, ["k"], {"k": "x"}).collect()] == ["2", "1", "0"]
    assert [r.k for r in h.history_of(history, ["k"]).collect()] == ["x", "x", "x", "y"]


def test_replace_versions(spark):
    history = h.scd2_rebuild(log(spark, [("x", at(0), 0, "a", ""), ("x", at(1), 1, "b", "")]), SPEC)
    fixed = history.filter("v = 'a'").withColumn("note", F.lit("fixed"))
    assert rows(h.replace_versions(history, fixed, SPEC), "v", "note") == [("a", "fixed"), ("b", "")]


# Point-in-time join

@pytest.mark.parametrize("hot", [None, HotKeys(), EAGER])
def test_point_in_time_join_equals_an_interval_search(spark, hot):
    data = random_log(30, n=80)
    versions_of = [r for r in by_hand(data)]
    pick = random.Random(31)
    facts = [(i, pick.choice(["hot", "hot", "k0", "k1", "none", None]), pick.choice([None, at(pick.randrange(-3, 45))]))
             for i in range(100)]
    history = h.scd2_rebuild(log(spark, data), SPEC, None)
    got = h.valid_at(spark.createDataFrame(facts, "id int, k string, ts timestamp_ntz"), history, ["k"], "ts",
                     {"v": "v", "since": START}, hot)
    expected = []
    for i, k, ts in facts:
        hits = [x for x in versions_of if k and ts and x[0] == k and x[2] <= ts and (x[3] is None or ts < x[3])]
        assert len(hits) < 2
        expected.append((i, k, ts, hits[0][1] if hits else None, hits[0][2] if hits else None))
    assert sorted(tuple(r) for r in got.select("id", "k", "ts", "v", "since").collect()) == sorted(expected)


def test_point_in_time_join_with_facts_at_one_instant(spark):
    history = h.scd2_rebuild(log(spark, [("x", at(0), 0, "a", ""), ("x", at(5), 1, "b", "")]), SPEC)
    facts = spark.createDataFrame([("x", at(5), 1)] * 40 + [("x", at(4), 2)], "k string, ts timestamp_ntz, n int")
    got = h.valid_at(facts, history, ["k"], "ts", {"state": "v"}, EAGER)
    assert rows(got.groupBy("n", "state").count()) == [(1, "b", 40), (2, "a", 1)]


def test_facts_in_a_gap_match_nothing(spark):
    history = spark.createDataFrame(
        [("x", "a", at(0), at(2), "N"), ("x", "b", at(4), None, "Y")],
        f"k string, v string, {START} timestamp_ntz, {END} timestamp_ntz, {CURRENT} string")
    facts = spark.createDataFrame([("x", at(m)) for m in (-1, 0, 2, 3, 4)], "k string, ts timestamp_ntz")
    assert [r[2] for r in rows(h.valid_at(facts, history, ["k"], "ts", {"state": "v"}))] == [None, "a", None, None, "b"]


# Flights

def test_flight_history(spark):
    data = [("60001", "T", "SFO", "ORD", "1410", "1842", -3, "COMPLETED", at(0)),
            ("60001", "T", "SFO", "ORD", "1500", "1855", 45, "DELAYED", at(1)),
            ("60001", "T9", "SFO", "ORD", "1500", "1855", 45, "DELAYED", at(2)),
            ("7", "T", "SFO", "ORD", "", None, None, "CANCELLED", at(0))]
    silver = spark.createDataFrame(
        data, "flight_number string, tail_number string, origin_airport string, destination_airport string, "
              "departure_time string, arrival_time string, total_delay int, flight_status string, "
              "load_timestamp timestamp")
    spec = flight_spec()
    history = with_version_id(h.scd2_rebuild(flight_states(silver, spec), spec), spec)
    assert rows(history, "flight_number", "departure_time", "tail_number", CURRENT) == [
        ("60001", 1410, "T", "N"), ("60001", 1500, "T", "Y"), ("7", None, "T", "Y")]
    assert history.select("dim_flight_id").distinct().count() == 3
