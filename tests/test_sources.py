import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.schemas import AUDIT
from aerolith.session import list_names, shared_root, ship_package
from aerolith.sources import audit, readers, writers

pytestmark = pytest.mark.usefixtures("interpreted")


def write_text(folder, name, content):
    path = f"{folder.removeprefix('file:')}/{name}"
    with open(path, "w") as file:
        file.write(content)
    return path


def test_csv_is_text_with_nulls(spark, folder):
    path = write_text(folder, "a.csv", "code,name\nUA,United\nAS,\n0005,\"a, b\"\n")
    df = readers.read_csv(spark, path, ["code", "name"])
    assert df.dtypes == [("code", "string"), ("name", "string")]
    assert rows(df) == [("0005", "a, b"), ("AS", None), ("UA", "United")]


def test_csv_with_other_header_fails(spark, folder):
    path = write_text(folder, "b.csv", "name,code\nUnited,UA\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, path, ["code", "name"]).collect()


def test_load_by_name(spark):
    df = spark.createDataFrame([("1", "x", 2.5), ("bad", "y", 3.5)], "ID string, Other string, Val double")
    target = T.StructType([
        T.StructField("val", T.DoubleType()), T.StructField("id", T.IntegerType()), T.StructField("gone", T.DateType())])
    out = readers.load_by_name(df, target)
    assert out.schema == target
    assert rows(out) == [(2.5, 1, None), (3.5, None, None)]


def test_load_by_name_refuses_ambiguous_columns(spark):
    df = spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("A"))
    with pytest.raises(ValueError):
        readers.load_by_name(df, T.StructType([T.StructField("a", T.IntegerType())]))


def test_stamp(spark):
    stamp = dt.datetime(2025, 1, 2, 3, 4, 5)
    assert readers.stamp_load(spark.range(1), stamp).first()["load_timestamp"] == stamp
    assert readers.stamp_load(spark.range(2)).select("load_timestamp").distinct().count() == 1


def test_overwrite_and_append(spark, folder):
    path = f"{folder}/t"
    writers.overwrite_parquet(spark.range(5), path)
    assert writers.overwrite_parquet(spark.range(2), path).count() == 2
    assert writers.append_parquet(spark.range(3), path).count() == 5


def test_table_overwrite(spark):
    spark.sql("DROP TABLE IF EXISTS saved_numbers")
    try:
        writers.overwrite_table(spark.range(4), "saved_numbers")
        assert writers.overwrite_table(spark.range(3), "saved_numbers").count() == 3
        assert readers.read_table(spark, "saved_numbers").count() == 3
    finally:
        spark.sql("DROP TABLE IF EXISTS saved_numbers")


def test_insert_select(spark):
    target = spark.createDataFrame([(1, "a", 1.0)], "id long, name string, v double")
    query = spark.createDataFrame([(2, 7)], "k int, v int")
    out = writers.insert_select(target, query, {"id": F.col("k"), "v": F.col("v")})
    assert out.schema == target.schema
    assert rows(out) == [(1, "a", 1.0), (2, None, 7.0)]
    assert rows(writers.insert_select(target, query)) == [(None, None, 7.0), (1, "a", 1.0)]
    with pytest.raises(ValueError):
        writers.insert_select(target, query, {"nope": F.col("k")})


def test_union_feeds_fills_absent_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([(2.0, 2)], "b double, id int")
    assert rows(writers.union_feeds(a, b), "id", "a", "b") == [(1, "x", None), (2, None, 2.0)]


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    changes = spark.createDataFrame([(2, "B"), (3, "C"), (None, "m")], "k int, v string")
    assert rows(writers.upsert(target, changes, ["k"])) == [(None, "m"), (None, "n"), (1, "a"), (2, "B"), (3, "C")]
    assert rows(writers.upsert(target.limit(0), changes, ["k"])) == rows(changes)
    assert rows(writers.upsert(target, changes.limit(0), ["k"])) == rows(target)


def test_upsert_takes_the_latest_change(spark):
    target = spark.createDataFrame([(1, "a", 0)], "k int, v string, n int")
    changes = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "p", 1), (None, "q", 2)], target.schema)
    out = writers.upsert(target, changes, ["k"], latest_by=["n"])
    assert rows(out) == [(None, "p", 1), (None, "q", 2), (1, "y", 2)]


def test_audited_overwrite_counts_once(spark, folder):
    source = spark.range(10).withColumn("v", F.when(F.col("id") % 3 > 0, F.col("id")))
    stamp = dt.datetime(2025, 1, 1)
    out = audit.audited_overwrite(
        source, lambda df: df.na.drop(), f"{folder}/out", f"{folder}/log",
        process="SPARK", step="CLEANING", dataset="NUMBERS", message="m", at=stamp)
    audit.audited_overwrite(
        out, lambda df: df, f"{folder}/model", f"{folder}/log", process="MODEL", step="RULES", dataset="NUMBERS",
        message="m", count_before=False, at=stamp)
    log = spark.read.parquet(f"{folder}/log")
    assert log.schema == AUDIT
    assert rows(log, "process_name", "row_count_before", "row_count_after", "status", "log_time") == [
        ("MODEL", None, 6, "SUCCESS", stamp), ("SPARK", 10, 6, "SUCCESS", stamp)]
    assert out.count() == 6


def test_scratch_lies_under_the_configured_folder(spark, folder):
    assert folder.startswith(shared_root(spark)) and spark.conf.get("spark.checkpoint.dir")
    assert list_names(spark, folder + "/missing") == []


def test_workers_get_the_package_once(spark):
    ship_package(spark)
    shipped = [path for path in spark.sparkContext.listFiles if path.endswith("/aerolith.zip")]
    assert len(shipped) == 1
