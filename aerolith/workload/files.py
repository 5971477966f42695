"""Sources, sinks, loads and change records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.operators.changes import inserts, table_changes
from aerolith.operators.filters import keep_present
from aerolith.operators.rows import clone, delete_rows, update_rows
from aerolith.session import scratch_dir
from aerolith.sources.audit import audited_overwrite
from aerolith.sources.readers import load_by_name, read_csv, stamp_load
from aerolith.sources.versioned import VersionedTable
from aerolith.sources.writers import overwrite_parquet, union_feeds
from aerolith.streaming.ingest import file_stream, ingest_available
from aerolith.workload.registry import query, table

STAMP = dt.datetime(2025, 11, 26, 1, 23, 14)


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey
          FROM nation""")
def src_csv_roundtrip(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    path = scratch_dir(spark, "csv") + "/nation"
    nation.write.option("header", True).csv(path)
    return read_csv(spark, path, nation.columns)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def src_parquet_scan(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("""SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, s_acctbal, CAST(NULL AS VARCHAR) AS s_comment
          FROM supplier""")
def load_by_name_(spark, sf_dir):
    staged = table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").cast("string").alias("S_ACCTBAL"), F.col("s_name").alias("S_Name"),
        F.col("s_suppkey").cast("string").alias("S_SUPPKEY"), F.col("s_nationkey").alias("EXTRA"),
    )
    return load_by_name(staged, T.StructType([
        T.StructField("s_suppkey", T.IntegerType()), T.StructField("s_name", T.StringType()),
        T.StructField("s_acctbal", T.DoubleType()), T.StructField("s_comment", T.StringType()),
    ]))


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_file_ingest(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    root = scratch_dir(spark, "ingest")
    stream = file_stream(spark, f"{sf_dir}/events.parquet", schema)
    return ingest_available(
        stream, f"{root}/target", f"{root}/checkpoint",
        lambda df: df.select("event_id", "ts", "user_id", "event_type", "value"),
    )


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 10")
def sink_parquet_overwrite(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    path = scratch_dir(spark, "overwrite") + "/part"
    overwrite_parquet(part, path)
    return overwrite_parquet(part.filter("p_size > 10"), path)


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
          UNION ALL
          SELECT o_orderkey + 1000000000, 'N', NULL FROM orders WHERE o_orderstatus = 'O'""")
def sink_append(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    target = VersionedTable(spark, scratch_dir(spark, "append"), ["o_orderkey"], 8)
    target.overwrite(orders.select("o_orderkey", "o_orderstatus", "o_totalprice"))
    target.insert_select(orders.filter("o_orderstatus = 'O'"), {
        "o_orderkey": F.col("o_orderkey") + 1_000_000_000, "o_orderstatus": F.lit("N"),
    })
    return target.read()


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P'
          UNION ALL SELECT o_orderkey, 'X', o_totalprice FROM orders WHERE o_orderstatus = 'P'
          UNION ALL SELECT -o_orderkey - 1, 'X', o_totalprice FROM orders WHERE o_orderstatus = 'P'""")
def upsert_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    target = VersionedTable(spark, scratch_dir(spark, "upsert"), ["o_orderkey"], 8)
    target.overwrite(orders)
    known = orders.filter("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("X"))
    new = known.withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    target.upsert(known.unionByName(new))
    return target.read()


@query("""SELECT TIMESTAMP '2025-11-26 01:23:14' AS log_time, 'SPARK' AS process_name, 'CLEANING' AS step_name,
                 'ORDERS' AS dataset_name, count(*) AS row_count_before,
                 count(*) FILTER (WHERE o_orderpriority <> '5-LOW') AS row_count_after,
                 'orders without priority removed' AS message, 'SUCCESS' AS status FROM orders
          UNION ALL
          SELECT TIMESTAMP '2025-11-26 01:23:14', 'MODEL', 'BUSINESS LOGIC', 'ORDERS', NULL,
                 count(*) FILTER (WHERE o_orderpriority <> '5-LOW'), 'Applied rules', 'SUCCESS' FROM orders""")
def audit_counts(spark, sf_dir):
    root = scratch_dir(spark, "audit")
    raw = table(spark, sf_dir, "orders").withColumn(
        "o_orderpriority", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    )
    cleaned = audited_overwrite(
        raw, lambda df: keep_present(df, ["o_orderpriority"]), f"{root}/clean", f"{root}/log",
        process="SPARK", step="CLEANING", dataset="ORDERS", message="orders without priority removed", at=STAMP,
    )
    audited_overwrite(
        cleaned, lambda df: df.withColumn("is_urgent", F.col("o_orderpriority") == "1-URGENT"),
        f"{root}/model", f"{root}/log", process="MODEL", step="BUSINESS LOGIC", dataset="ORDERS",
        message="Applied rules", count_before=False, at=STAMP,
    )
    return spark.read.parquet(f"{root}/log").withColumn("log_time", F.col("log_time").cast("timestamp_ntz"))


_AFTER = """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus
            FROM orders WHERE o_orderpriority <> '5-LOW'
            UNION ALL SELECT -o_orderkey - 1, o_orderstatus FROM orders WHERE o_orderstatus = 'O'"""


@query(f"""WITH before AS (SELECT o_orderkey, o_orderstatus FROM orders), after AS ({_AFTER})
           SELECT *, 'DELETE' AS _action, CAST(1 AS BIGINT) AS _copies
           FROM (SELECT * FROM before EXCEPT ALL SELECT * FROM after)
           UNION ALL
           SELECT *, 'INSERT', CAST(1 AS BIGINT) FROM (SELECT * FROM after EXCEPT ALL SELECT * FROM before)""")
def table_changes_(spark, sf_dir):
    return table_changes(*_two_states(spark, sf_dir))


@query(f"""WITH before AS (SELECT o_orderkey, o_orderstatus FROM orders), after AS ({_AFTER})
           SELECT * FROM after EXCEPT ALL SELECT * FROM before""")
def change_inserts(spark, sf_dir):
    return inserts(table_changes(*_two_states(spark, sf_dir))).select("o_orderkey", "o_orderstatus")


def _two_states(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    before = orders.select("o_orderkey", "o_orderstatus")
    status = F.when(F.col("o_orderstatus") == "P", F.lit("F")).otherwise(F.col("o_orderstatus"))
    kept = orders.filter("o_orderpriority <> '5-LOW'").select("o_orderkey", status.alias("o_orderstatus"))
    new = before.filter("o_orderstatus = 'O'").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return before, kept.unionByName(new)


@query("SELECT *, TIMESTAMP '2025-11-26 01:23:14' AS load_timestamp FROM nation")
def ingest_stamp(spark, sf_dir):
    stamped = stamp_load(table(spark, sf_dir, "nation"), STAMP)
    return stamped.withColumn("load_timestamp", F.col("load_timestamp").cast("timestamp_ntz"))


@query("""SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders WHERE o_orderdate < '1999-01-01'
          UNION ALL SELECT o_orderkey, o_orderdate, o_totalprice, NULL FROM orders WHERE o_orderdate >= '1999-01-01'""")
def union_history_latest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    history = orders.filter("o_orderdate < '1999-01-01'").select(
        "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    latest = orders.filter("o_orderdate >= '1999-01-01'").select("o_orderdate", "o_totalprice", "o_orderkey")
    return union_feeds(history, latest)


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'EDITED' ELSE o_orderstatus END AS o_orderstatus,
                 o_totalprice FROM orders""")
def row_update(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return update_rows(orders, F.col("o_orderpriority") == "1-URGENT", {"o_orderstatus": F.lit("EDITED")}).drop(
        "o_orderpriority")


@query("""SELECT o_orderkey, NULLIF(o_orderstatus, 'O') AS o_orderstatus FROM orders
          WHERE NULLIF(o_orderstatus, 'O') IS NULL OR NULLIF(o_orderstatus, 'O') <> 'P'""")
def row_delete(spark, sf_dir):
    status = F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("o_orderstatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", status)
    return delete_rows(orders, F.col("o_orderstatus") == "P")


@query("SELECT n_nationkey, n_name FROM nation")
def table_clone(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return clone(nation, scratch_dir(spark, "clone") + "/nation")

