from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.schemas import text_schema


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Header CSV, one file or a folder, all columns as text; empty fields are null.

    With the columns declared there is no inference pass, and enforceSchema=false
    checks the header, so a file with other columns fails instead of shifting.
    """
    return (
        spark.read.schema(text_schema(columns))
        .option("header", True)
        .option("enforceSchema", False)
        .csv(path)
    )


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def load_by_name(df: DataFrame, target: T.StructType) -> DataFrame:
    """Fits ``df`` to the target schema, matching columns by name in any case.

    Columns the target lacks are dropped and absent ones are null; text that does
    not parse as the target type is null.
    """
    found: dict[str, str] = {}
    for name in df.columns:
        if name.lower() in found:
            raise ValueError(f"columns {found[name.lower()]!r} and {name!r} differ only in case")
        found[name.lower()] = name
    columns = []
    for field in target:
        source = found.get(field.name.lower())
        if source is None:
            value = F.lit(None).cast(field.dataType)
        elif df.schema[source].dataType == field.dataType:
            value = F.col(f"`{source}`")
        else:
            value = F.col(f"`{source}`").try_cast(field.dataType)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def stamp_load(df: DataFrame, at=None, name: str = "load_timestamp") -> DataFrame:
    """Adds the load time: now, or a given time when runs must be repeatable."""
    return df.withColumn(name, F.current_timestamp() if at is None else F.lit(at))
