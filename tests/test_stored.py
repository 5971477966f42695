"""Stored tables: versions, feeds, KPI states, fact versions, snapshots, numbers and key indexes."""

import datetime as dt
import random

import pytest
from helpers import at, rows
from pyspark.sql import functions as F

from aerolith.operators.changes import ACTION, net_changes, table_changes
from aerolith.operators.fact_versions import FactVersions, changed_spans
from aerolith.operators.history import HistorySpec, scd2_rebuild, valid_at
from aerolith.operators.key_index import KEYS, KeyIndex
from aerolith.operators.numbering import append_numbered, dense_numbers
from aerolith.operators.periods import DAILY, MONTHLY, StoredPeriods, keep_up, period_metrics
from aerolith.operators.snapshots import SNAPSHOT, SnapshotLog
from aerolith.sources.state_feed import StateFeed
from aerolith.sources.versioned import ConcurrentWrite, Folder, VersionedTable, merged_tail
from aerolith.sources.writers import overwrite_bucketed
from aerolith.streaming.ingest import delivered_once, file_stream, ingest_available

pytestmark = pytest.mark.usefixtures("interpreted")


def paths(df):
    return sorted(df.inputFiles())


def table(spark, folder, n=40, buckets=4):
    stored = VersionedTable(spark, f"{folder}/t", ["id"], buckets)
    stored.overwrite(spark.range(n).withColumn("v", F.lit("a")))
    return stored


# Versions -----------------------------------------------------------------------------------


def test_merges_and_appends_on_a_stored_table(spark, folder):
    stored = table(spark, folder)
    stored.upsert(spark.createDataFrame([(3, "b"), (50, "c")], "id long, v string"))
    stored.append(spark.createDataFrame([(60, "d")], "id long, v string"))
    stored.upsert(spark.createDataFrame([(60, "e"), (60, "f")], "id long, v string"), latest_by=["v"])
    stored.insert_select(spark.createDataFrame([(70,)], "key long"), {"id": F.col("key")})
    kept = [(i, "a") for i in range(40) if i != 3]
    assert rows(stored.read()) == sorted([*kept, (3, "b"), (50, "c"), (60, "f"), (70, None)], key=lambda r: r[0])
    assert rows(stored.read(1)) == [(i, "a") for i in range(40)]
    stored.rewrite(F.col("id") == 50, lambda df: df.filter("id <> 50"))
    assert stored.read().filter("id = 50").isEmpty() and stored.read().count() == 42


def test_untouched_parts_keep_their_files(spark, folder):
    stored = table(spark, folder)
    before = stored.files.latest()
    change = spark.createDataFrame([(3, "b")], "id long, v string")
    touched = stored.parts_of(change)
    stored.upsert(change)
    after = stored.files.latest()
    assert len(touched) == 1
    assert {name for name in after.folders if after.folders[name] != before.folders[name]} == {f"rows/{touched[0]}"}
    others = [part for part in after.parts("rows") if part not in touched]
    assert paths(stored.read(parts=others)) == paths(stored.read(1, parts=others))


def test_a_killed_write_leaves_the_old_version(spark, folder):
    stored = table(spark, folder)
    stored.files.write(spark.createDataFrame([(1, "x", "rows", "0")], "id long, v string, _kind string, _part string"))
    assert stored.version == 1 and rows(stored.read()) == [(i, "a") for i in range(40)]
    stored.append(spark.createDataFrame([(99, "z")], "id long, v string"))
    assert stored.version == 2 and stored.read().count() == 41
    stored.drop_old()
    assert stored.read().count() == 41  # the dead write's folder is gone, the table is not


def test_the_second_of_two_writers_is_refused(spark, folder):
    stored = table(spark, folder)
    base = stored.files.latest()
    stored.append(spark.createDataFrame([(99, "z")], "id long, v string"))
    with pytest.raises(ConcurrentWrite):
        stored.files.commit(base, {})
    assert stored.read().count() == 41


def test_folders_of_appends_are_merged(spark, folder):
    stored = table(spark, folder, n=1, buckets=1)
    for n in range(1, 20):
        stored.append(spark.createDataFrame([(n, "b")], "id long, v string"))
    assert max(len(found) for found in stored.files.latest().folders.values()) <= 6
    assert rows(stored.read().select("id")) == [(n,) for n in range(20)]
    assert merged_tail([Folder("a")] * 2) == 0
    assert merged_tail([Folder("a")] * 3) == 3
    assert merged_tail([Folder("a", 4)] * 3 + [Folder("a")] * 3) == 6


def test_changes_between_versions_read_new_folders_only(spark, folder):
    stored = table(spark, folder)
    before = set(paths(stored.read()))
    stored.append(spark.createDataFrame([(99, "z")], "id long, v string"))
    changes = stored.changes(1)
    assert not before & set(paths(changes))
    assert rows(changes, "id", "v", ACTION) == [(99, "z", "INSERT")]
    stored.upsert(spark.createDataFrame([(99, "y")], "id long, v string"))
    assert rows(stored.changes(2), "id", "v", ACTION) == [(99, "y", "INSERT"), (99, "z", "DELETE")]
    assert rows(net_changes(stored.changes(1, 2).unionByName(stored.changes(2))), "id", "v") == [(99, "y")]
    assert stored.changes(3).isEmpty()


def test_empty_tables_and_null_keys(spark, folder):
    stored = VersionedTable(spark, f"{folder}/t", ["id"], 4)
    nothing = spark.createDataFrame([], "id long, v string")
    stored.overwrite(nothing)
    assert stored.read().isEmpty()
    stored.upsert(nothing)
    stored.upsert(spark.createDataFrame([(None, "a"), (None, "a"), (1, "b")], "id long, v string"))
    stored.upsert(spark.createDataFrame([(None, "c"), (1, "d")], "id long, v string"))
    assert rows(stored.read()) == [(None, "a"), (None, "a"), (None, "c"), (1, "d")]


# Feeds --------------------------------------------------------------------------------------


def test_a_feed_compares_changed_buckets_only(spark, folder):
    feed = StateFeed(spark, f"{folder}/f", ["id"], 8)
    one = spark.range(100).withColumn("v", F.lit("a"))
    assert feed.put(one) == 1 and feed.put(one) == 1  # an equal state is no news
    changes, until = feed.changes("reader")
    assert changes.count() == 100
    feed.done("reader", until)
    two = one.withColumn("v", F.when(F.col("id") == 7, "b").otherwise(F.col("v"))).unionByName(
        spark.createDataFrame([(7, "b")], "id long, v string"))
    feed.put(two)
    changes, until = feed.changes("reader")
    bucket = feed.table.parts_of(spark.createDataFrame([(7,)], "id long"))[0]
    assert {path.split("_part=")[1].split("/")[0] for path in paths(changes)} == {bucket}
    assert rows(changes) == [(7, "a", "DELETE", 1), (7, "b", "INSERT", 2)]
    assert rows(feed.changes("reader")[0]) == rows(changes)  # not done yet, so handed out again
    feed.done("reader", until)
    assert feed.changes("reader")[0].isEmpty()
    feed.drop_old()
    feed.put(two.filter("id <> 7"))
    assert rows(feed.changes("reader")[0]) == [(7, "b", "DELETE", 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_feeds_add_up_to_the_states(spark, folder, seed):
    pick = random.Random(seed)
    feed = StateFeed(spark, f"{folder}/f", ["k"], 3)
    before = []
    for _ in range(3):
        after = [(pick.randrange(6), pick.choice(["a", None])) for _ in range(pick.randrange(12))]
        old, new = (spark.createDataFrame(data, "k long, v string") for data in (before, after))
        feed.put(new)
        changes, until = feed.changes("c")
        assert rows(changes) == rows(table_changes(old, new))
        feed.done("c", until)
        before = after


# KPI states ---------------------------------------------------------------------------------

FACTS = "id long, flight_date date, arrival_delay int, cancelled int"


def random_facts(pick, ids):
    start = dt.date(2023, 11, 20)
    return {i: (i, start + dt.timedelta(days=pick.randrange(90)), pick.choice([None, -5, 0, 3, 20]), pick.randrange(2)) for i in ids}


@pytest.mark.parametrize("grain", [DAILY, MONTHLY], ids=["daily", "monthly"])
def test_signed_changes_equal_a_rebuild(spark, folder, grain):
    pick = random.Random(3)
    stored = StoredPeriods(spark, f"{folder}/kpi", grain)
    facts = random_facts(pick, range(30))
    stored.apply(spark.createDataFrame(list(facts.values()), FACTS))
    for step in range(3):
        gone = pick.sample(sorted(facts), 6)
        new = random_facts(pick, [*gone[:3], *range(100 * step + 100, 100 * step + 104)])
        changes = [(*facts.pop(i), "DELETE") for i in gone] + [(*row, "INSERT") for row in new.values()]
        facts |= new
        stored.apply(spark.createDataFrame(changes, FACTS + f", {ACTION} string"))
        wanted = period_metrics(spark.createDataFrame(list(facts.values()), FACTS), grain)
        assert rows(stored.read()) == rows(wanted)


def test_a_period_without_flights_goes_and_other_years_stay(spark, folder):
    stored = StoredPeriods(spark, f"{folder}/kpi", MONTHLY)
    old, new = (1, dt.date(2020, 5, 5), 1, 0), (2, dt.date(2023, 5, 5), 1, 0)
    stored.apply(spark.createDataFrame([old, new], FACTS))
    before = stored.table.files.latest().folders["rows/2020"]
    stored.apply(spark.createDataFrame([(*new, "DELETE")], FACTS + f", {ACTION} string"))
    assert rows(stored.read(), "year") == [(2020,)]
    assert stored.table.files.latest().folders["rows/2020"] == before


def test_keep_up_commits_new_periods(spark, folder):
    facts = spark.createDataFrame([(1, dt.date(2023, 1, 5), 1, 0), (2, dt.date(2023, 2, 5), 5, 0)], FACTS)
    stored = VersionedTable(spark, f"{folder}/k", MONTHLY.key, part=F.year("month_date"))
    stored.overwrite(period_metrics(facts.filter("id = 1"), MONTHLY))
    keep_up(stored, facts, MONTHLY)
    assert rows(stored.read(), "month_date", "total_flights") == [(dt.date(2023, 1, 1), 1), (dt.date(2023, 2, 1), 1)]


# Fact versions ------------------------------------------------------------------------------

SPEC = HistorySpec(["k"], ["v"], "ts", "seq")
LOG = "k string, ts timestamp, seq long, v string"


def history(spark, data):
    return scd2_rebuild(spark.createDataFrame(data, LOG), SPEC, None)


@pytest.mark.parametrize("seed", [1, 2])
def test_fact_versions_follow_late_changes(spark, folder, seed):
    pick = random.Random(seed)
    data = [(f"k{pick.randrange(4)}", at(pick.randrange(40)), n, pick.choice("abc")) for n in range(36)]
    facts = spark.createDataFrame([(n, f"k{n % 5}" if n else None, at(pick.randrange(45))) for n in range(30)], "id long, k string, at timestamp")
    take = {"since": "effective_start", "value": "v"}
    keys = FactVersions(spark, f"{folder}/m", ["id"], ["k"], "at", take, 3, hot=None)
    before = history(spark, data[:12])
    keys.add(facts.filter("id < 15"), before)
    for end in (24, 36):
        after = history(spark, data[:end])
        keys.remap(table_changes(before, after), after)
        if end == 24:
            keys.add(facts.filter("id >= 15"), after)
        before = after
    assert rows(keys.read()) == rows(valid_at(facts, before, ["k"], "at", take, None))


def test_only_facts_in_changed_spans_are_mapped_again(spark, folder):
    data = [(k, at(m), n, f"v{m}") for n, (k, m) in enumerate([("x", 0), ("x", 10), ("x", 20), ("y", 0)])]
    facts = spark.createDataFrame([(n, k, at(m)) for n, (k, m) in enumerate([("x", 5), ("x", 15), ("x", 25), ("y", 5)])], "id long, k string, at timestamp")
    keys = FactVersions(spark, f"{folder}/m", ["id"], ["k"], "at", {"value": "v"}, 8, hot=None)
    before = history(spark, data)
    keys.add(facts, before)
    untouched = keys.table.files.latest().folders[f"rows/{keys.table.parts_of(facts.filter("k = 'y'"))[0]}"]
    after = history(spark, [*data, ("x", at(12), 9, "late")])
    spans = changed_spans(table_changes(before, after), ["k"], ["v"])
    assert rows(spans) == [("x", at(12), at(20))]
    assert rows(keys.inside(spans), "id") == [(1,)]
    keys.remap(table_changes(before, after), after)
    assert rows(keys.read(), "id", "value") == [(0, "v0"), (1, "late"), (2, "v20"), (3, "v0")]
    assert keys.table.files.latest().folders[f"rows/{keys.table.parts_of(facts.filter("k = 'y'"))[0]}"] == untouched
    version = keys.table.version
    keys.remap(table_changes(after, after), after)
    assert keys.table.version == version


# Snapshots ----------------------------------------------------------------------------------


def test_an_as_of_read_scans_one_snapshot_and_the_later_log(spark, folder):
    log = [("x", at(60 * 24 * d), d, f"v{d}") for d in range(6)] + [("y", at(0), 9, "y")]
    stored = SnapshotLog(spark, f"{folder}/s", ["k"], "ts", "seq")
    stored.append(spark.createDataFrame(log, LOG))
    middle = dt.datetime(2024, 1, 3, 12)
    stored.take(dt.datetime(2024, 1, 2, 12))
    stored.take(middle)
    assert stored.snapshots() == [dt.datetime(2024, 1, 2, 12), middle]
    read = stored.as_of(dt.datetime(2024, 1, 4, 12))
    assert rows(read, "k", "v") == [("x", "v3"), ("y", "y")]
    folders = {path.split("_kind=")[1].rsplit("/", 1)[0] for path in read.inputFiles()}
    assert folders == {"log/_part=2024-01-03", "log/_part=2024-01-04", "snapshot/_part=20240103T120000000000"}
    assert rows(stored.as_of(dt.datetime(2023, 12, 31))) == []
    changed = stored.diff(dt.datetime(2024, 1, 3, 13), dt.datetime(2024, 1, 5, 13), ["v"])
    assert rows(changed) == [("x", "v2", "v4")]
    assert not any("2024-01-01" in path or "2024-01-02" in path for path in changed.inputFiles())

    stored.append(spark.createDataFrame([("y", at(60 * 24 * 2), 10, "late")], LOG))
    assert stored.files.latest().parts(SNAPSHOT) == {"20240102T120000000000"}  # the other one is stale
    assert rows(stored.as_of(middle), "k", "v") == [("x", "v2"), ("y", "late")]


def test_deleted_keys_stay_deleted_after_a_snapshot(spark, folder):
    log = [("x", at(0), 0, "a", "INSERT"), ("x", at(5), 1, "a", "DELETE"), ("y", at(1), 2, "b", "INSERT")]
    stored = SnapshotLog(spark, f"{folder}/s", ["k"], "ts", "seq")
    stored.append(spark.createDataFrame(log, LOG + f", {ACTION} string"))
    stored.take(at(3))
    assert rows(stored.as_of(at(4)), "k") == [("x",), ("y",)]
    assert rows(stored.as_of(at(6)), "k") == [("y",)]
    stored.take(at(7))
    assert rows(stored.as_of(at(8)), "k") == [("y",)]


# Numbers and keys ---------------------------------------------------------------------------


def test_numbers_are_dense_over_two_loads(spark, folder):
    stored = VersionedTable(spark, f"{folder}/n", ["id"], 2)
    append_numbered(stored, spark.range(0, 1000, numPartitions=7), "number")
    append_numbered(stored, spark.range(1000, 1300, numPartitions=3), "number")
    assert rows(stored.read(), "number") == [(n,) for n in range(1, 1301)]
    assert {r.number for r in stored.read().filter("id >= 1000").collect()} == set(range(1001, 1301))


def test_numbers_follow_an_order_without_one_big_task(spark):
    df = spark.range(0, 500, numPartitions=5).select((500 - F.col("id")).alias("v"))
    numbered = dense_numbers(df, "n", ["v"], after=10)
    assert rows(numbered) == [(n + 10, n) for n in range(1, 501)]
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[0]  # only the counts of the partitions meet in one task
    assert rows(dense_numbers(df.limit(0), "n")) == []


def test_key_index_equals_the_full_test(spark, folder):
    pick = random.Random(5)
    index = KeyIndex(spark, f"{folder}/i", ["a", "b"], 4, size=18)
    seen = []
    for _ in range(3):
        data = [(pick.randrange(40), pick.choice(["x", "y", None])) for _ in range(30)]
        batch = spark.createDataFrame(data, "a long, b string")
        seen += data
        whole = [row for row in seen if None not in row]
        wanted = sorted({(*row, whole.count(row)) for row in data if None not in row and whole.count(row) > 1})
        assert rows(index.check(batch)) == wanted
        index.add(batch)


def test_new_keys_read_no_stored_key(spark, folder):
    index = KeyIndex(spark, f"{folder}/i", ["id"], 8, size=20)
    index.add(spark.range(200))
    assert index.likely(spark.range(10_000, 10_050).withColumn("occurrences", F.lit(1))).count() <= 1
    hits = index.check(spark.createDataFrame([(3,), (777,)], "id long"))
    assert rows(hits) == [(3, 2)]
    assert len([path for path in hits.inputFiles() if f"_kind={KEYS}" in path]) <= 1


# Streams and catalog tables -----------------------------------------------------------------


def test_a_file_under_two_names_counts_once(spark, folder):
    def deliver(df):
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = delivered_once(file_stream(spark, f"{folder}/in", df.schema), ["id"])
        return ingest_available(stream, f"{folder}/out", f"{folder}/state")

    first = spark.range(5).withColumn("ts", F.lit(at(100)))
    deliver(first)
    deliver(first)
    late = spark.range(4, 8).withColumn("ts", F.lit(at(0)))  # older rows, of which one has come before
    assert rows(deliver(late), "id") == [(n,) for n in range(8)]


def test_bucketed_tables_join_without_a_shuffle(spark, folder):
    left = overwrite_bucketed(spark.range(50), "stored_left", ["id"], 3, f"{folder}/l")
    right = overwrite_bucketed(spark.range(0, 50, 2).select("id", F.lit(1).alias("x")), "stored_right", ["id"], 3, f"{folder}/r")
    joined = left.join(right.hint("merge"), "id").groupBy("id").agg(F.sum("x").alias("x"))
    assert joined.count() == 25
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    overwrite_bucketed(spark.range(3), "stored_left", ["id"], 3, f"{folder}/l2")
    assert spark.table("stored_left").count() == 3
