"""What the plans must and must not hold, read from their text."""

import contextlib
import io
import os

import pytest

from aerolith.operators.periods import MONTHLY, newer_than_stored, period_metrics
from aerolith.sources.writers import settle
from aerolith.workload import QUERIES
from aerolith.workload.star import order_flights
from test_workload import SF_DIR

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def query_plan(spark, name):
    return plan(QUERIES[name](spark, SF_DIR))


HEAVY = [
    "fact_build", "join_role_playing", "kpi_daily", "scd2_rebuild", "scd2_merge", "scd2_point_in_time_join",
    "as_of_read", "as_of_diff", "table_changes", "upsert_merge", "incremental_monthly", "dq_report",
    "report_worst_routes", "anomaly_zscore",
]


@pytest.mark.parametrize("name", HEAVY)
def test_no_pairs_and_no_python(spark, name):
    text = query_plan(spark, name)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert word not in text


def test_history_shuffles_once(spark):
    text = query_plan(spark, "scd2_rebuild")
    assert text.count("hashpartitioning") == 1 and "SinglePartition" not in text


def test_as_of_combines_before_the_shuffle(spark):
    text = query_plan(spark, "as_of_read")
    assert "partial_max_by" in text and "Window" not in text
    assert "LessThanOrEqual(ts" in text


def test_incremental_run_skips_stored_days_in_the_scan(spark):
    rows = order_flights(spark, SF_DIR)
    stored = settle(period_metrics(rows.filter("flight_date < '1998-06-01'"), MONTHLY), "metrics")
    assert "GreaterThanOrEqual(o_orderdate,ScalarSubquery" in plan(newer_than_stored(rows, stored, MONTHLY, "flight_date"))


def test_date_filter_reaches_the_scan(spark):
    text = query_plan(spark, "filter_date_range")
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text


def test_reports_read_only_their_columns(spark):
    text = query_plan(spark, "report_weather")
    scan = next(line for line in text.splitlines() if "ReadSchema" in line and "l_tax" in line)
    assert scan.strip() == "ReadSchema: struct<l_suppkey:bigint,l_tax:double>"


def test_top_k_sorts_no_whole_table(spark):
    assert "TakeOrderedAndProject" in query_plan(spark, "sort_limit")
    assert "TakeOrderedAndProject" in query_plan(spark, "report_busiest_routes")


def test_a_dimension_over_the_bound_is_not_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = query_plan(spark, "fact_build")
        assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_flights_of_repeated_codes_are_written_out_after_all_joins(spark):
    text = query_plan(spark, "layer_fact_flights")
    assert "Generate (" in text and text.index("Generate (") < text.index("Exchange (") < text.index("Join")


def test_flights_are_read_once_and_dealt_without_a_sort(spark):
    text = query_plan(spark, "layer_fact_flights")
    assert text.count("/lineitem.parquet]") == 1
    assert "REBALANCE_PARTITIONS_BY_COL" in text and "RoundRobinPartitioning" not in text and "Sort (" not in text


def test_row_checks_share_one_scan(spark):
    from aerolith.operators.quality import in_range, not_null, run_checks
    df = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    text = plan(run_checks(df, "t", [*not_null("l_orderkey", "l_partkey"), in_range("l_quantity", 1, 2)]))
    assert text.count("ReadSchema") == 1
