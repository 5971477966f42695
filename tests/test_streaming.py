import random

import pytest
from helpers import at, rows
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from test_history import SCHEMA, SPEC, as_tuples, by_hand, log, random_log

from aerolith.operators.changes import ACTION
from aerolith.operators.history import HistorySpec, scd2_rebuild
from aerolith.session import list_names
from aerolith.sources.versioned import VersionedFolder
from aerolith.streaming import history as live
from aerolith.streaming.ingest import file_stream, ingest_available, start_ingest

pytestmark = pytest.mark.usefixtures("interpreted")


def land(df, folder):
    df.coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_each_file_is_loaded_once(spark, folder):
    land(spark.range(5), folder)
    stream = file_stream(spark, f"{folder}/in", spark.range(1).schema)
    table = ingest_available(stream, f"{folder}/out", f"{folder}/state")
    assert table.count() == 5
    assert ingest_available(stream, f"{folder}/out", f"{folder}/state").count() == 5
    land(spark.range(100, 103), folder)
    table = ingest_available(stream, f"{folder}/out", f"{folder}/state", lambda df: df.withColumn("x", F.lit(1)))
    assert rows(table) == [(i, None) for i in range(5)] + [(i, 1) for i in range(100, 103)]


def test_ingest_keeps_running(spark, folder):
    land(spark.range(2), folder)
    query = start_ingest(
        file_stream(spark, f"{folder}/in", spark.range(1).schema, files_per_batch=1), f"{folder}/out",
        f"{folder}/state", every="1 second")
    try:
        query.processAllAvailable()
        land(spark.range(3), folder)
        query.processAllAvailable()
        assert spark.read.parquet(f"{folder}/out").count() == 5
    finally:
        query.stop()


def run(spark, folder, spec=SPEC, schema=SCHEMA):
    stream = file_stream(spark, f"{folder}/in", log(spark, [], schema).schema, files_per_batch=1)
    live.start_history(stream, f"{folder}/history", f"{folder}/state", spec, hot=None, buckets=3).awaitTermination()
    return live.read_history(spark, f"{folder}/history", log(spark, [], schema).schema, spec)


def test_streamed_history_equals_the_rebuild(spark, folder):
    data = sorted(random_log(40, n=60), key=lambda r: (r[1], r[2]))
    assert run_empty(spark, folder).isEmpty()
    for part in (data[:20], data[20:45]):
        land(log(spark, part), folder)
        history = run(spark, folder)
    assert as_tuples(history) == by_hand(data[:45])
    land(log(spark, data[45:]), folder)
    assert as_tuples(run(spark, folder)) == by_hand(data)
    versions = list_names(spark, f"{folder}/history/versions")
    assert as_tuples(run(spark, folder)) == by_hand(data)
    assert list_names(spark, f"{folder}/history/versions") == versions  # no new file, no batch

    assert as_tuples(run(spark, folder)) == by_hand(data)
    current = live.read_current(spark, f"{folder}/history", log(spark, []).schema, SPEC)
    assert as_tuples(current) == [r for r in by_hand(data) if r[4] == "Y"]


def run_empty(spark, folder):
    return live.read_history(spark, f"{folder}/history", log(spark, []).schema, SPEC)


def test_a_new_checkpoint_is_refused(spark, folder):
    data = sorted(random_log(41, n=20), key=lambda r: (r[1], r[2]))
    land(log(spark, data), folder)
    assert as_tuples(run(spark, folder)) == by_hand(data)
    stream = file_stream(spark, f"{folder}/in", log(spark, []).schema)
    with pytest.raises(StreamingQueryException, match="another checkpoint"):
        live.start_history(stream, f"{folder}/history", f"{folder}/state-2", SPEC, hot=None).awaitTermination()
    assert as_tuples(run(spark, folder)) == by_hand(data)


def test_late_changes_are_kept_and_placed(spark, folder):
    data = [(f"k{i % 3}", at(i), i, f"v{i}", f"n{i}") for i in range(24)]
    for part in (data[9:], data[:4], data[4:9] + data[9:11]):
        land(log(spark, part), folder)
        history = run(spark, folder)
    assert as_tuples(history) == by_hand(data)


def test_null_keys_and_deletes_in_a_stream(spark, folder):
    schema = SCHEMA + f", {ACTION} string"
    spec = HistorySpec(["k"], ["v"], "ts", "seq", close_on_delete=True)
    land(log(spark, [("x", at(0), 0, "a", "", "INSERT"), (None, at(0), 1, "z", "", "INSERT")], schema), folder)
    run(spark, folder, spec, schema)
    land(log(spark, [("x", at(2), 2, "a", "", "DELETE"), (None, at(1), 3, "z", "", "INSERT")], schema), folder)
    history = run(spark, folder, spec, schema)
    assert rows(history, "k", "v", "effective_start", "effective_end", "is_current") == [
        (None, "z", at(0), None, "Y"), (None, "z", at(1), None, "Y"), ("x", "a", at(0), at(2), "N")]


def test_a_repeated_or_broken_batch_does_not_count_twice(spark, folder):
    root = f"{folder}/h"
    first, second = log(spark, [("x", at(0), 0, "a", "")]), log(spark, [("x", at(1), 1, "b", "")])
    live.apply_batch(first, 0, root, SPEC, None, 3)
    live.apply_batch(first, 0, root, SPEC, None, 3)
    spark.range(1).write.parquet(f"{root}/data/dead/_kind=open/_part=1")  # what a batch that died leaves: no version names it
    assert live.last_finished(spark, root) == 0
    live.apply_batch(second, 1, root, SPEC, None)
    live.apply_batch(second, 1, root, SPEC, None)
    got = live.read_history(spark, root, first.schema, SPEC)
    assert rows(got, "v", "effective_end") == [("a", at(1)), ("b", None)]


def state_of(spark, root):
    return VersionedFolder(spark, root).latest()


def test_a_batch_of_one_key_rewrites_one_bucket(spark, folder):
    root = f"{folder}/h"
    keys = [f"k{n}" for n in range(60)]
    live.apply_batch(log(spark, [(k, at(0), n, "a", "") for n, k in enumerate(keys)]), 0, root, SPEC, None, 8)
    before = state_of(spark, root)
    live.apply_batch(log(spark, [("k7", at(5), 100, "b", "")]), 1, root, SPEC, None, 8)
    after = state_of(spark, root)
    changed = {name for name in after.folders if after.folders[name] != before.folders.get(name)}
    assert len({name.split("/")[1] for name in changed}) == 1
    assert {name.split("/")[0] for name in changed} == {"open", "closed", "log"}
    assert len(after.folders[next(name for name in changed if name.startswith("open/"))]) == 1


def test_folders_do_not_grow_with_batches(spark, folder):
    root = f"{folder}/h"
    most = 0
    for n in range(13):
        live.apply_batch(log(spark, [("x", at(n), n, f"v{n}", "")]), n, root, SPEC, None, 2)
        most = max(most, *[len(found) for found in state_of(spark, root).folders.values()])
    assert most <= 6
    assert len(list_names(spark, f"{root}/versions")) <= 4  # two versions and their checksums
    history = live.read_history(spark, root, log(spark, []).schema, SPEC)
    assert history.count() == 13 and history.filter("is_current = 'Y'").count() == 1
    folders = {f.path.split("/")[1] for found in state_of(spark, root).folders.values() for f in found}
    assert len(list_names(spark, f"{root}/data")) <= len(folders) + 3  # those of the version before


@pytest.mark.parametrize("seed", [1, 2])
def test_late_rows_repeats_and_deletes_equal_the_rebuild(spark, folder, seed):
    schema = SCHEMA + f", {ACTION} string"
    spec = HistorySpec(["k"], ["v"], "ts", "seq", close_on_delete=True)
    pick = random.Random(seed)
    data = [(f"k{pick.randrange(5)}", at(pick.randrange(30)), n, pick.choice("ab"), "", pick.choice(["INSERT", "INSERT", "DELETE"]))
            for n in range(45)]
    root = f"{folder}/h"
    for n in range(3):
        live.apply_batch(log(spark, data[n * 15:n * 15 + 15], schema), n, root, spec, None, 3)
        history = live.read_history(spark, root, log(spark, [], schema).schema, spec)
        wanted = scd2_rebuild(log(spark, data[:n * 15 + 15], schema), spec, None)
        assert rows(history.select(*wanted.columns)) == rows(wanted)
    current = live.read_current(spark, root, log(spark, [], schema).schema, spec)
    assert rows(current.select(*wanted.columns)) == rows(wanted.filter("is_current = 'Y'"))
