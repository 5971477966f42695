from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_present(columns: Iterable[str]) -> Column:
    return reduce(and_, [F.col(name).isNotNull() for name in columns])


def keep_present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drops rows in which any of the columns is null."""
    return df.na.drop(how="any", subset=columns)


def between_dates(df: DataFrame, column: str, first=None, last=None) -> DataFrame:
    """Keeps first <= column <= last by calendar day; an open bound does not filter.

    A timestamp column is compared with the start of the day after ``last`` and is
    not cast, so the bounds reach the Parquet scan.
    """
    data_type = df.schema[column].dataType
    is_day = data_type.typeName() == "date"
    c = F.col(column)
    if first is not None:
        df = df.filter(c >= _as(F.lit(first), data_type))
    if last is not None:
        if is_day:
            df = df.filter(c <= F.lit(last).cast("date"))
        else:
            df = df.filter(c < _as(F.date_add(F.lit(last).cast("date"), 1), data_type))
    return df


def _as(value: Column, data_type) -> Column:
    return value.cast("date").cast(data_type)


def member_of(df: DataFrame, column: str, values: Iterable | None) -> DataFrame:
    """Keeps listed values; an empty choice means no filter."""
    values = list(values or [])
    return df.filter(F.col(column).isin(values)) if values else df


def matching(df: DataFrame, column: str, lookup: DataFrame, key: str) -> DataFrame:
    """Semi join: rows whose value occurs as ``key`` in the lookup."""
    wanted = lookup.select(F.col(key).alias(column))
    return df.join(wanted, column, "left_semi")


def has_values(df: DataFrame, column: str) -> bool:
    """True when the column exists and some row fills it.

    One value is enough, so a filled column is decided after the first row found.
    """
    if column.lower() not in {name.lower() for name in df.columns}:
        return False
    return not df.select(column).filter(F.col(column).isNotNull()).isEmpty()
