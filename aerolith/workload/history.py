"""Type-2 history, point-in-time reads and their streams, over the events as a change log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from aerolith.operators import history as scd2
from aerolith.operators.asof import as_of, as_of_diff, seconds_ago
from aerolith.operators.changes import ACTION
from aerolith.operators.history import HistorySpec
from aerolith.operators.ordered import HotKeys
from aerolith.session import scratch_dir
from aerolith.sources.writers import settle
from aerolith.streaming.history import read_history, start_history
from aerolith.streaming.ingest import file_stream
from aerolith.workload.registry import query, table

SPEC = HistorySpec(keys=["user_id"], tracked=["event_type"], ts="ts", seq="event_id")
COLUMNS = ["user_id", "event_id", "event_type", "value"]


def _at(*day: int):
    """Midnight as a literal of the log's own type, so it reaches the scan as a filter."""
    return F.lit(dt.datetime(*day).isoformat(sep=" ")).cast("timestamp_ntz")


CUT = (2024, 1, 16)
NOW = (2024, 2, 1)


def rebuild_sql(log: str = "events", prefix: str = "") -> str:
    """CTEs that end in ``<prefix>history``."""
    return f"""{prefix}chained AS (
        SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM {log}
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      {prefix}opened AS (SELECT * FROM {prefix}chained WHERE n = 1 OR event_type IS DISTINCT FROM before),
      {prefix}history AS (
        SELECT user_id, event_id, event_type, value, ts AS effective_start,
               lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS effective_end,
               CASE WHEN lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 'Y' ELSE 'N' END
                 AS is_current
        FROM {prefix}opened)"""


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(*COLUMNS, "ts")


@query("""SELECT c_custkey, c_nationkey, c_mktsegment, TIMESTAMP '2024-02-01' AS effective_start,
                 CAST(NULL AS TIMESTAMP) AS effective_end, 'Y' AS is_current FROM customer""")
def scd2_initial(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return scd2.open_versions(customers, _at(*NOW))


@query(f"WITH {rebuild_sql()} SELECT * FROM history")
def scd2_rebuild(spark, sf_dir):
    return scd2.scd2_rebuild(_log(spark, sf_dir), SPEC)


@query(f"WITH {rebuild_sql()} SELECT * FROM history")
def scd2_merge(spark, sf_dir):
    log = _log(spark, sf_dir)
    before = settle(scd2.scd2_rebuild(log.filter(F.col("ts") < _at(*CUT)), SPEC), "history")
    return scd2.scd2_merge(before, log.filter(F.col("ts") >= _at(*CUT)), SPEC)


@query(f"""WITH early AS (SELECT * FROM events WHERE ts < '2024-01-16'), {rebuild_sql('early')},
           batch AS (SELECT * FROM events WHERE ts >= '2024-01-16'
                     QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
           SELECT h.user_id, h.event_id, h.event_type, h.value, h.effective_start,
                  CASE WHEN is_current = 'Y' AND b.user_id IS NOT NULL AND b.event_type IS DISTINCT FROM h.event_type
                       THEN TIMESTAMP '2024-02-01' ELSE h.effective_end END AS effective_end,
                  CASE WHEN is_current = 'Y' AND b.user_id IS NOT NULL AND b.event_type IS DISTINCT FROM h.event_type
                       THEN 'N' ELSE is_current END AS is_current
           FROM history h LEFT JOIN batch b ON h.user_id = b.user_id
           UNION ALL
           SELECT user_id, event_id, event_type, value, TIMESTAMP '2024-02-01', NULL, 'Y' FROM batch
           WHERE user_id NOT IN (SELECT user_id FROM history WHERE is_current = 'Y')""")
def scd2_merge_two_step(spark, sf_dir):
    log = _log(spark, sf_dir)
    before = settle(scd2.scd2_rebuild(log.filter(F.col("ts") < _at(*CUT)), SPEC), "history")
    changes = log.filter(F.col("ts") >= _at(*CUT))
    return scd2.scd2_merge_two_step(before, changes, SPEC, _at(*NOW))


@query(f"WITH {rebuild_sql()} SELECT * FROM history")
def scd2_history(spark, sf_dir):
    return scd2.history_of(scd2.scd2_rebuild(_log(spark, sf_dir), SPEC), ["user_id"])


@query(f"WITH {rebuild_sql()} SELECT * FROM history WHERE is_current = 'Y'")
def scd2_current(spark, sf_dir):
    return scd2.current_versions(scd2.scd2_rebuild(_log(spark, sf_dir), SPEC))


@query(f"""WITH states AS (SELECT * FROM events WHERE event_type <> 'purchase'), {rebuild_sql('states')}
           SELECT p.event_id, p.user_id, p.ts, p.value, h.event_type AS state, h.effective_start AS since
           FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN history h
             ON p.user_id = h.user_id AND p.ts >= h.effective_start
            AND (h.effective_end IS NULL OR p.ts < h.effective_end)""")
def scd2_point_in_time_join(spark, sf_dir):
    log = _log(spark, sf_dir)
    versions = settle(scd2.scd2_rebuild(log.filter("event_type <> 'purchase'"), SPEC), "history")
    purchases = log.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    return scd2.valid_at(purchases, versions, ["user_id"], "ts", {"state": "event_type", "since": "effective_start"})


#: Cuts keys also on small tables.
SMALL = HotKeys(share=0.001, min_rows=50, cuts=16)
_HOT_SQL = """hot AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, event_id, event_type, value,
    date_trunc('day', ts) AS ts FROM events)"""


def _hot_log(spark, sf_dir):
    """The log with a third of its rows on one user, and many rows at each time."""
    user = F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id"))
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return _log(spark, sf_dir).withColumns({"user_id": user.cast("long"), "ts": day})


@query(f"WITH {_HOT_SQL}, {rebuild_sql('hot')} SELECT * FROM history")
def scd2_rebuild_hot(spark, sf_dir):
    return scd2.scd2_rebuild(_hot_log(spark, sf_dir), SPEC, SMALL)


@query(f"""WITH {_HOT_SQL}, states AS (SELECT * FROM hot WHERE event_type <> 'purchase'), {rebuild_sql('states')}
           SELECT p.event_id, p.user_id, p.ts, p.value, h.event_type AS state, h.effective_start AS since
           FROM (SELECT * FROM hot WHERE event_type = 'purchase') p LEFT JOIN history h
             ON p.user_id = h.user_id AND p.ts >= h.effective_start
            AND (h.effective_end IS NULL OR p.ts < h.effective_end)""")
def scd2_point_in_time_hot(spark, sf_dir):
    log = _hot_log(spark, sf_dir)
    versions = settle(scd2.scd2_rebuild(log.filter("event_type <> 'purchase'"), SPEC, SMALL), "history")
    purchases = log.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    return scd2.valid_at(purchases, versions, ["user_id"], "ts", {"state": "event_type", "since": "effective_start"}, SMALL)


@query(f"WITH {rebuild_sql()} SELECT * FROM history")
def stream_scd2(spark, sf_dir):
    schema = _log(spark, sf_dir).schema
    root = scratch_dir(spark, "stream-history")
    stream = file_stream(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    changes = stream.select(*COLUMNS, "ts")
    start_history(changes, f"{root}/history", f"{root}/checkpoint", SPEC).awaitTermination()
    return read_history(spark, f"{root}/history", schema, SPEC)


def _action_log(spark, sf_dir):
    """Errors delete the user's row; every other event replaces it."""
    action = F.when(F.col("event_type") == "error", F.lit("DELETE")).otherwise(F.lit("INSERT"))
    return _log(spark, sf_dir).withColumn(ACTION, action)


def _state_sql(at: str) -> str:
    return f"""(SELECT * FROM (SELECT * FROM events WHERE ts <= {at}
                QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
                WHERE event_type <> 'error')"""


@query(f"""SELECT user_id, event_id, event_type, value, ts
           FROM {_state_sql("TIMESTAMP '2024-01-16' - INTERVAL 600 SECOND")}""")
def as_of_read(spark, sf_dir):
    at = seconds_ago(_at(*CUT), 600)
    return as_of(_action_log(spark, sf_dir), ["user_id"], "ts", at, "event_id")


@query(f"""SELECT COALESCE(a.user_id, b.user_id) AS user_id, a.event_type AS before_event_type,
                  a.value AS before_value, b.event_type AS after_event_type, b.value AS after_value
           FROM {_state_sql("TIMESTAMP '2024-01-10'")} a FULL JOIN {_state_sql("TIMESTAMP '2024-01-16'")} b
             ON a.user_id = b.user_id
           WHERE a.event_type IS DISTINCT FROM b.event_type OR a.value IS DISTINCT FROM b.value""")
def as_of_diff_(spark, sf_dir):
    return as_of_diff(
        _action_log(spark, sf_dir), ["user_id"], "ts", _at(2024, 1, 10), _at(*CUT), ["event_type", "value"], "event_id")
