from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.session import scratch_dir


def overwrite_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Replaces the folder and returns a scan of it.

    ``df`` must not read the folder itself: it is emptied before the rows are read.
    To rewrite a table from its own rows, write a new folder (see ``operators.rows``).
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def settle(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table written to the shared folder.

    The planner then knows its real size when it chooses between a broadcast and a
    shuffle, and nothing that reads it repeats the work behind it.
    """
    return overwrite_parquet(df, f"{scratch_dir(df.sparkSession, label)}/table")


def overwrite_table(df: DataFrame, name: str) -> DataFrame:
    df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def append_parquet(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def append_rows(spark: SparkSession, rows: list[dict], schema, path: str) -> DataFrame:
    """Appends literal rows, such as one audit record."""
    values = [tuple(row.get(field.name) for field in schema) for row in rows]
    return append_parquet(spark.createDataFrame(values, schema), path)


def insert_select(target: DataFrame, query: DataFrame, columns: dict[str, Column] | None = None) -> DataFrame:
    """``target`` plus the projected query; target columns not named become null.

    ``columns`` maps a target column to an expression over the query; without it
    columns are taken by name.
    """
    given = columns or {name: F.col(name) for name in query.columns if name in target.columns}
    unknown = set(given) - set(target.columns)
    if unknown:
        raise ValueError(f"not in the target: {sorted(unknown)}")
    projected = query.select(*[
        (given[field.name] if field.name in given else F.lit(None)).cast(field.dataType).alias(field.name)
        for field in target.schema
    ])
    return target.unionByName(projected)


def union_feeds(history: DataFrame, latest: DataFrame) -> DataFrame:
    """History and latest feed as one table; a column only one of them has is null."""
    return history.unionByName(latest, allowMissingColumns=True)


def upsert(target: DataFrame, changes: DataFrame, keys: list[str],
           latest_by: list[str] | None = None) -> DataFrame:
    """Target with the changes put in: known keys replaced, new keys added.

    ``changes`` must hold one row per key; with ``latest_by`` the last row by these
    columns is taken.  That is an aggregate, so a hot key is combined before the
    shuffle.  Rows whose key is null never match and are always added.
    """
    if latest_by:
        changes = latest_per_key(changes, keys, latest_by)
    kept = target.join(changes.select(*keys), keys, "left_anti")
    return kept.unionByName(changes)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; rows with a null key stay as they are."""
    whole = F.struct(*[F.col(name) for name in df.columns])
    has_key = F.lit(True)
    for key in keys:
        has_key = has_key & F.col(key).isNotNull()
    last = (
        df.filter(has_key)
        .groupBy(*keys)
        .agg(F.max_by(whole, F.struct(*order)).alias("_row"))
        .select("_row.*")
    )
    return last.unionByName(df.filter(~has_key))


def overwrite_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, path: str) -> DataFrame:
    """A catalog table whose rows lie in sorted buckets of their keys; replaces the one of that name.

    Tables with equal keys and buckets join and aggregate on these keys without a shuffle.  All
    rows of one key are in one bucket, so take keys that no third of the rows shares.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
