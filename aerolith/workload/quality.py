"""Column tests, rejected rows, reconciliation and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.operators import quality as q
from aerolith.workload.registry import query, table


def _result(table_name: str, check: str, columns: str, failures: str) -> str:
    return (f"SELECT '{table_name}' AS table_name, '{check}' AS check_name, '{columns}' AS columns, failures, "
            f"CASE WHEN failures = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({failures})")


def _counted(source: str, bad: str) -> str:
    return f"SELECT count(*) AS failures FROM {source} WHERE {bad}"


_HOLES = "(SELECT event_id, NULLIF(event_type, 'error') AS event_type, NULLIF(user_id, 3) AS user_id FROM events)"


@query(" UNION ALL ".join(
    _result("events", "not_null", c, _counted(_HOLES, f"{c} IS NULL")) for c in ("event_id", "event_type", "user_id")))
def dq_not_null(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"),
        F.nullif(F.col("user_id"), F.lit(3)).alias("user_id"))
    return q.run_checks(events, "events", q.not_null("event_id", "event_type", "user_id"))


def _repeats(source: str, columns: str) -> str:
    return f"SELECT count(*) AS failures FROM (SELECT {columns} FROM {source} GROUP BY {columns} HAVING count(*) > 1)"


@query(_result("orders", "unique", "o_orderkey", _repeats("orders", "o_orderkey")) + " UNION ALL "
       + _result("orders", "unique", "o_custkey", _repeats("orders", "o_custkey")))
def dq_unique(spark, sf_dir):
    return q.run_checks(table(spark, sf_dir, "orders"), "orders", [q.unique("o_orderkey"), q.unique("o_custkey")])


@query(_result("orders", "accepted_values", "o_orderstatus", _counted("orders", "o_orderstatus NOT IN ('F', 'O')")))
def dq_accepted_values(spark, sf_dir):
    return q.run_checks(table(spark, sf_dir, "orders"), "orders", [q.accepted_values("o_orderstatus", ["F", "O"])])


@query("SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dq_unique_combo(spark, sf_dir):
    return q.repeated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(_result("lineitem", "range", "l_quantity", _counted("lineitem", "NOT l_quantity BETWEEN 5 AND 45")) + " UNION ALL "
       + _result("lineitem", "range", "l_discount", _counted("lineitem", "NOT l_discount BETWEEN 0 AND 1")))
def dq_range(spark, sf_dir):
    checks = [q.in_range("l_quantity", 5, 45), q.in_range("l_discount", 0, 1)]
    return q.run_checks(table(spark, sf_dir, "lineitem"), "lineitem", checks)


_STRAYS = "(SELECT CASE l_linenumber WHEN 7 THEN -l_orderkey - 1 ELSE l_orderkey END AS l_orderkey FROM lineitem)"


@query(_result("lineitem", "relationship", "l_orderkey", _counted(_STRAYS, "l_orderkey NOT IN (SELECT o_orderkey FROM orders)")))
def dq_relationships(spark, sf_dir):
    key = F.when(F.col("l_linenumber") == 7, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey"))  # no such order
    lines = table(spark, sf_dir, "lineitem").withColumn("l_orderkey", key)
    return q.run_checks(lines, "lineitem", [q.relationship(["l_orderkey"], table(spark, sf_dir, "orders"), ["o_orderkey"])])


_SHIPPED = "(SELECT o_orderdate, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(_result("shipments", "time_order", "o_orderdate, l_shipdate", _counted(_SHIPPED, "l_shipdate < o_orderdate")))
def dq_time_order(spark, sf_dir):
    shipments = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return q.run_checks(shipments, "shipments", [q.in_order("o_orderdate", "l_shipdate")])


@query(" UNION ALL ".join([
    _result("lineitem", "not_null", "l_orderkey", _counted("lineitem", "l_orderkey IS NULL")),
    _result("lineitem", "not_null", "l_shipdate", _counted("lineitem", "l_shipdate IS NULL")),
    _result("lineitem", "accepted_values", "l_returnflag", _counted("lineitem", "l_returnflag NOT IN ('A', 'N')")),
    _result("lineitem", "range", "l_quantity", _counted("lineitem", "NOT l_quantity BETWEEN 5 AND 45")),
    _result("lineitem", "priced", "l_extendedprice, l_discount",
            _counted("lineitem", "NOT (l_extendedprice * (1 - l_discount) > 1000)")),
    _result("lineitem", "unique", "l_orderkey, l_linenumber", _repeats("lineitem", "l_orderkey, l_linenumber")),
    _result("lineitem", "relationship", "l_suppkey",
            _counted("(SELECT CASE l_returnflag WHEN 'R' THEN -l_suppkey - 1 ELSE l_suppkey END AS l_suppkey FROM lineitem)",
                     "l_suppkey NOT IN (SELECT s_suppkey FROM supplier)")),
]))
def dq_report(spark, sf_dir):
    key = F.when(F.col("l_returnflag") == "R", -F.col("l_suppkey") - 1).otherwise(F.col("l_suppkey"))  # no such supplier
    priced = F.col("l_extendedprice") * (1 - F.col("l_discount")) > 1000
    return q.run_checks(table(spark, sf_dir, "lineitem").withColumn("l_suppkey", key), "lineitem", [
        *q.not_null("l_orderkey", "l_shipdate"),
        q.accepted_values("l_returnflag", ["A", "N"]),
        q.in_range("l_quantity", 5, 45),
        q.expression("priced", ["l_extendedprice", "l_discount"], priced),
        q.unique("l_orderkey", "l_linenumber"),
        q.relationship(["l_suppkey"], table(spark, sf_dir, "supplier"), ["s_suppkey"]),
    ])


@query("""WITH r AS (SELECT event_id, event_type, value,
                 concat_ws(', ', CASE WHEN event_type IS NULL THEN 'event_type present' END,
                                 CASE WHEN NOT (value >= 5) THEN 'value in range' END) AS reject_reason
                     FROM (SELECT event_id, NULLIF(event_type, 'error') AS event_type, value FROM events))
          SELECT * FROM r WHERE reject_reason <> ''""")
def dq_rejects(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"), "value")
    rules = {"event_type present": F.col("event_type").isNotNull(), "value in range": F.col("value") >= 5}
    return q.split_rejects(events, rules)[1]


@query("""SELECT year, COALESCE(s, 0) AS source_rows, COALESCE(t, 0) AS target_rows,
                 COALESCE(s, 0) - COALESCE(t, 0) AS difference,
                 CASE WHEN COALESCE(s, 0) = COALESCE(t, 0) THEN 'MATCH' ELSE 'MISMATCH' END AS status
          FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS s FROM orders GROUP BY 1)
          FULL JOIN (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS t FROM lineitem
                     GROUP BY 1) USING (year)""")
def dq_reconcile(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"))
    lines = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"))
    return q.reconcile(orders, lines, ["year"])


@query("""WITH x AS (SELECT event_id, event_type, value, value + 1e9 AS far FROM events),
          s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS d, avg(far - 1e9) AS fm, stddev_samp(far - 1e9) AS fd
                FROM x GROUP BY event_type),
          z AS (SELECT event_id, event_type, value, round((value - m) / d, 4) + 0.0 AS z_score,
                       round((far - 1e9 - fm) / fd, 2) + 0.0 AS far_z_score FROM x JOIN s USING (event_type))
          SELECT *, CASE WHEN abs(z_score) > 3 THEN 1 ELSE 0 END AS is_outlier FROM z""")
def anomaly_zscore(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    near = q.flag_outliers(events, "value", ["event_type"], 3)
    far = q.flag_outliers(near.withColumnRenamed("z_score", "near").withColumn("far", F.col("value") + 1e9).drop("is_outlier"),
                          "far", ["event_type"], 3)
    return far.select("event_id", "event_type", "value", (F.round("near", 4) + 0.0).alias("z_score"),
                      (F.round("z_score", 2) + 0.0).alias("far_z_score"), F.when(F.abs("near") > 3, 1).otherwise(0).alias("is_outlier"))
