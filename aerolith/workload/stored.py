"""Stored tables: commits, feeds of changes, history in batches, snapshots, numbers and key indexes."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.operators.changes import ACTION
from aerolith.operators.fact_versions import FactVersions
from aerolith.operators.history import HistorySpec
from aerolith.operators.key_index import KeyIndex
from aerolith.operators.numbering import append_numbered
from aerolith.operators.snapshots import SnapshotLog
from aerolith.plans.flight_history import with_version_id
from aerolith.session import scratch_dir
from aerolith.sources.readers import read_table
from aerolith.sources.state_feed import StateFeed
from aerolith.sources.versioned import VersionedTable
from aerolith.sources.writers import overwrite_bucketed
from aerolith.streaming import history as live
from aerolith.streaming.ingest import delivered_once, file_stream, ingest_available
from aerolith.workload.history import _state_sql
from aerolith.workload.registry import query, table

KEEPS = ["user_id", "event_id", "event_type", "value", "ts"]


@query("""WITH a AS (
            SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'X' WHEN 'F' THEN 'Y' ELSE o_orderstatus END AS o_orderstatus, o_totalprice
            FROM orders
            UNION ALL SELECT o_orderkey + 1000000000, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O'
            UNION ALL SELECT o_orderkey + 2000000000, 'Z', NULL FROM orders WHERE o_orderstatus = 'P'
            UNION ALL SELECT -o_orderkey - 1, 'Y', o_totalprice FROM orders WHERE o_orderstatus = 'P')
          SELECT * FROM a WHERE o_totalprice IS NULL OR o_totalprice >= 2000""")
def table_commit(spark, sf_dir):
    """Two merges, two appends and a deletion, each a version of one stored table."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    stored = VersionedTable(spark, scratch_dir(spark, "commit"), ["o_orderkey"], 8)
    stored.overwrite(orders)
    partial = orders.filter("o_orderstatus = 'P'")
    stored.upsert(partial.withColumn("o_orderstatus", F.lit("X")))
    stored.append(orders.filter("o_orderstatus = 'O'").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000))
    new = partial.withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    stored.upsert(orders.filter("o_orderstatus = 'F'").unionByName(new).withColumn("o_orderstatus", F.lit("Y")))
    stored.insert_select(partial, {"o_orderkey": F.col("o_orderkey") + 2_000_000_000, "o_orderstatus": F.lit("Z")})
    cheap = F.col("o_totalprice") < 2000
    stored.rewrite(cheap, lambda rows: rows.filter(~F.coalesce(cheap, F.lit(False))))
    return stored.read()


_STATES = """one AS (SELECT o_orderkey, o_orderstatus FROM orders),
  two AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders
          WHERE o_orderpriority <> '5-LOW'
          UNION ALL SELECT -o_orderkey - 1, o_orderstatus FROM orders WHERE o_orderstatus = 'O'),
  three AS (SELECT * FROM two WHERE o_orderkey >= 0)"""


def _step(number: int, before: str, after: str) -> str:
    return f"""SELECT *, 'INSERT' AS _action, CAST(1 AS BIGINT) AS _copies, {number} AS state FROM ({after} EXCEPT ALL {before})
               UNION ALL SELECT *, 'DELETE', CAST(1 AS BIGINT), {number} FROM ({before} EXCEPT ALL {after})"""


@query(f"""WITH {_STATES}, none AS (SELECT * FROM one WHERE false)
           {_step(1, 'SELECT * FROM none', 'SELECT * FROM one')} UNION ALL
           {_step(2, 'SELECT * FROM one', 'SELECT * FROM two')} UNION ALL
           {_step(3, 'SELECT * FROM two', 'SELECT * FROM three')}""")
def change_feed(spark, sf_dir):
    """Three states of the orders, taken in one after the other by a consumer with an offset."""
    orders = table(spark, sf_dir, "orders")
    one = orders.select("o_orderkey", "o_orderstatus")
    status = F.when(F.col("o_orderstatus") == "P", F.lit("F")).otherwise(F.col("o_orderstatus"))
    new = one.filter("o_orderstatus = 'O'").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    two = orders.filter("o_orderpriority <> '5-LOW'").select("o_orderkey", status.alias("o_orderstatus")).unionByName(new)
    feed = StateFeed(spark, scratch_dir(spark, "feed"), ["o_orderkey"], 8)
    taken = []
    for state in (one, two, two.filter("o_orderkey >= 0")):
        feed.put(state)
        changes, until = feed.changes("reader")
        taken.append(changes.withColumn("state", F.lit(until)))
        feed.done("reader", until)
    return reduce(DataFrame.unionByName, taken)


# History ------------------------------------------------------------------------------------

DELETES = HistorySpec(keys=["user_id"], tracked=["event_type"], ts="ts", seq="event_id", close_on_delete=True)


def _history_sql(log: str, gone: str = "event_type = 'error'") -> str:
    """CTEs that end in ``history``, for a log in which some changes delete."""
    return f"""chained AS (
        SELECT *, {gone} AS gone, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM {log}
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      opened AS (SELECT * FROM chained WHERE n = 1 OR event_type IS DISTINCT FROM before),
      dated AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM opened),
      history AS (SELECT user_id, event_id, event_type, value, ts AS effective_start, until AS effective_end,
                         CASE WHEN until IS NULL THEN 'Y' ELSE 'N' END AS is_current FROM dated WHERE NOT gone)"""


def _actions(spark, sf_dir):
    """The log in which errors delete."""
    action = F.when(F.col("event_type") == "error", F.lit("DELETE")).otherwise(F.lit("INSERT"))
    return table(spark, sf_dir, "events").select(*KEEPS).withColumn(ACTION, action)


def _thirds(log: DataFrame) -> list[DataFrame]:
    """The log in three deliveries, the end of every day first, so that all but the first are late."""
    hour = F.hour("ts")
    return [log.filter(hour >= 16), log.filter((hour >= 8) & (hour < 16)), log.filter(hour < 8)]


@query(f"WITH {_history_sql('events')} SELECT * FROM history")
def stream_scd2_late(spark, sf_dir):
    """Three files in three runs, with late changes and deletes, folded into a stored history."""
    root = scratch_dir(spark, "late-history")
    log = _actions(spark, sf_dir)
    for delivery in _thirds(log):
        delivery.write.mode("append").parquet(f"{root}/in")
        stream = file_stream(spark, f"{root}/in", log.schema)
        live.start_history(stream, f"{root}/history", f"{root}/checkpoint", DELETES, buckets=4).awaitTermination()
    return live.read_history(spark, f"{root}/history", log.schema, DELETES)


@query(f"""WITH daily AS (SELECT user_id, event_id, event_type, value, date_trunc('day', ts) AS ts FROM events), {_history_sql('daily')}
           SELECT * FROM history""")
def scd2_merge_ties(spark, sf_dir):
    """Batches whose changes are late, tied in time with stored ones, or deletes; the last comes twice."""
    root = scratch_dir(spark, "tied-history")
    log = _actions(spark, sf_dir)
    schema = log.schema
    deliveries = [part.withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz")) for part in _thirds(log)]
    for number, delivery in enumerate([*deliveries, deliveries[-1]]):
        live.apply_batch(delivery, number, root, DELETES, buckets=4)
    return live.read_history(spark, root, schema, DELETES)


@query(f"""WITH states AS (SELECT * FROM events WHERE event_type <> 'purchase'), {_history_sql('states')},
           versions AS (SELECT *, md5(user_id || '|' || strftime(effective_start, '%Y-%m-%d %H:%M:%S.%f') || '|' || event_id) AS dim_flight_id FROM history)
           SELECT p.event_id, p.user_id, p.ts, v.dim_flight_id, v.event_type AS state
           FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN versions v
             ON p.user_id = v.user_id AND p.ts >= v.effective_start AND (v.effective_end IS NULL OR p.ts < v.effective_end)""")
def fact_version_key(spark, sf_dir):
    """The version key of every purchase, kept while two batches of changes come, the second late."""
    root = scratch_dir(spark, "version-keys")
    log = _actions(spark, sf_dir)
    purchases = log.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    changes = log.filter("event_type <> 'purchase'")
    take = {"dim_flight_id": "dim_flight_id", "state": "event_type"}
    keys = FactVersions(spark, f"{root}/keys", ["event_id"], ["user_id"], "ts", take, buckets=4)
    late, late_facts = F.hour("ts") < 12, F.dayofmonth("ts") > 20
    for number, (batch, facts) in enumerate([(~late, ~late_facts), (late, late_facts)]):
        before = live.stored_state(spark, f"{root}/history")
        live.apply_batch(changes.filter(batch), number, f"{root}/history", DELETES, buckets=4)
        history = with_version_id(live.read_history(spark, f"{root}/history", log.schema, DELETES), DELETES)
        changed = live.version_changes(spark, f"{root}/history", log.schema, DELETES, before)
        if number:
            keys.remap(with_version_id(changed, DELETES), history)
        keys.add(purchases.filter(facts), history)
    return keys.read()


# As-of reads --------------------------------------------------------------------------------


def _snapshot_log(spark, sf_dir):
    """A stored log with a snapshot that late changes make stale, and later ones that hold."""
    stored = SnapshotLog(spark, scratch_dir(spark, "snapshots"), ["user_id"], "ts", "event_id")
    log = _actions(spark, sf_dir)
    stored.append(log.filter(F.hour("ts") >= 6))
    stored.take(dt.datetime(2024, 1, 12))
    stored.append(log.filter(F.hour("ts") < 6))
    stored.take(dt.datetime(2024, 1, 8))
    stored.take(dt.datetime(2024, 1, 14))
    return stored


@query(f"SELECT user_id, event_id, event_type, value, ts FROM {_state_sql("TIMESTAMP '2024-01-15 23:50:00'")}")
def as_of_snapshot(spark, sf_dir):
    return _snapshot_log(spark, sf_dir).as_of(dt.datetime(2024, 1, 15, 23, 50))


@query(f"""SELECT COALESCE(a.user_id, b.user_id) AS user_id, a.event_type AS before_event_type,
                  a.value AS before_value, b.event_type AS after_event_type, b.value AS after_value
           FROM {_state_sql("TIMESTAMP '2024-01-10'")} a FULL JOIN {_state_sql("TIMESTAMP '2024-01-16'")} b
             ON a.user_id = b.user_id
           WHERE a.event_type IS DISTINCT FROM b.event_type OR a.value IS DISTINCT FROM b.value""")
def as_of_snapshot_diff(spark, sf_dir):
    return _snapshot_log(spark, sf_dir).diff(dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 16), ["event_type", "value"])


# Numbers and keys ---------------------------------------------------------------------------


@query("""SELECT row_number() OVER (ORDER BY c_acctbal < 0, c_custkey) AS customer_id, c_custkey, c_nationkey FROM customer""")
def dense_ids(spark, sf_dir):
    """Customers numbered in two loads, the second going on where the first ended."""
    customers = table(spark, sf_dir, "customer")
    stored = VersionedTable(spark, scratch_dir(spark, "numbered"), ["c_custkey"], 4)
    for load in ("c_acctbal >= 0", "c_acctbal < 0"):
        append_numbered(stored, customers.filter(load).select("c_custkey", "c_nationkey"), "customer_id", ["c_custkey"])
    return stored.read()


@query("""SELECT l_orderkey, l_suppkey, count(*) AS occurrences FROM lineitem
          GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1 AND bool_or(l_shipdate >= '2000-01-01')""")
def dq_unique_increment(spark, sf_dir):
    """Which keys of a batch repeat, in it or in what was loaded before."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    index = KeyIndex(spark, scratch_dir(spark, "key-index"), ["l_orderkey", "l_suppkey"], 8, size=24)
    index.add(lines.filter("l_shipdate < '1998-01-01'"))
    index.add(lines.filter("l_shipdate >= '1998-01-01' AND l_shipdate < '2000-01-01'"))
    return index.check(lines.filter("l_shipdate >= '2000-01-01'"))


# Streams and catalog tables -----------------------------------------------------------------


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_delivered_once(spark, sf_dir):
    """Every file comes twice under two names, the second time in a later run."""
    root = scratch_dir(spark, "delivered")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    for _ in range(2):
        events.write.mode("append").parquet(f"{root}/in")
        stream = delivered_once(file_stream(spark, f"{root}/in", events.schema), ["event_id"])
        loaded = ingest_available(stream, f"{root}/out", f"{root}/checkpoint")
    return loaded


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_backfill(spark, sf_dir):
    """Three files in three runs, the later ones with older rows."""
    root = scratch_dir(spark, "backfill")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    for delivery in _thirds(events):
        delivery.write.mode("append").parquet(f"{root}/in")
        stream = file_stream(spark, f"{root}/in", events.schema, files_per_batch=1)
        loaded = ingest_available(stream, f"{root}/out", f"{root}/checkpoint")
    return loaded


@query("SELECT p_partkey, p_name, p_retailprice * 2 AS p_retailprice FROM part WHERE p_size > 5")
def table_overwrite(spark, sf_dir):
    """A named table, overwritten and read by its name."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", "p_size")
    root = scratch_dir(spark, "named")
    overwrite_bucketed(parts, "aerolith_parts", ["p_partkey"], 4, f"{root}/one")
    doubled = parts.filter("p_size > 5").withColumn("p_retailprice", F.col("p_retailprice") * 2).drop("p_size")
    overwrite_bucketed(doubled, "aerolith_parts", ["p_partkey"], 4, f"{root}/two")
    return read_table(spark, "aerolith_parts")


def bucketed_tables(spark, sf_dir):
    """Line items and orders as named tables in equal buckets of the order."""
    root = scratch_dir(spark, "bucketed")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    overwrite_bucketed(lines, "aerolith_lines", ["l_orderkey"], 8, f"{root}/lines")
    overwrite_bucketed(orders, "aerolith_orders", ["o_orderkey"], 8, f"{root}/orders")
    return read_table(spark, "aerolith_lines"), read_table(spark, "aerolith_orders")


@query("""SELECT o_orderkey, o_custkey, count(*) AS lines, sum(l_quantity) AS quantity
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey""")
def bucketed_fact_join(spark, sf_dir):
    lines, orders = bucketed_tables(spark, sf_dir)
    joined = orders.join(lines.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey", "o_custkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))
