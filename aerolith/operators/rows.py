"""UPDATE, DELETE and CLONE as new states: a written Parquet table is never changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.sources.writers import overwrite_parquet


def update_rows(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Sets columns where the predicate is true."""
    return df.withColumns({
        name: F.when(where, value).otherwise(F.col(name)).cast(df.schema[name].dataType)
        for name, value in values.items()
    })


def delete_rows(df: DataFrame, where: Column) -> DataFrame:
    """Keeps rows for which the predicate is false or null."""
    return df.filter(~F.coalesce(where, F.lit(False)))


def clone(df: DataFrame, path: str) -> DataFrame:
    """An independent copy of a state at a new path."""
    return overwrite_parquet(df, path)
