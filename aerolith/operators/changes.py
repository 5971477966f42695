"""Change records: what differs between two states of a table."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTION = "_action"
COPIES = "_copies"


def table_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that came and went, with an action and the number of equal copies.

    An update shows as a DELETE of the old and an INSERT of the new row.  Rows are
    counted, not joined on a key: equal rows are combined before the shuffle, and
    keys that repeat cannot multiply.
    """
    columns = before.columns
    signed = before.withColumn(COPIES, F.lit(-1)).unionByName(
        after.select(*columns).withColumn(COPIES, F.lit(1))
    )
    return _net(signed, columns)


def net_changes(changes: DataFrame) -> DataFrame:
    """Change records of which those that cancel each other out are gone."""
    columns = [name for name in changes.columns if name not in {ACTION, COPIES}]
    copies = F.when(F.col(ACTION) == "DELETE", -F.col(COPIES)).otherwise(F.col(COPIES))
    return _net(changes.withColumn(COPIES, copies), columns)


def _net(signed: DataFrame, columns: list[str]) -> DataFrame:
    net = signed.groupBy(*columns).agg(F.sum(COPIES).alias(COPIES)).filter(F.col(COPIES) != 0)
    return net.select(
        *columns,
        F.when(F.col(COPIES) > 0, F.lit("INSERT")).otherwise(F.lit("DELETE")).alias(ACTION),
        F.abs(COPIES).alias(COPIES),
    )


def inserts(changes: DataFrame) -> DataFrame:
    """The new images only."""
    return changes.filter(F.col(ACTION) == "INSERT")


def differs(left: list[Column], right: list[Column]) -> Column:
    """True when any pair differs; null equals null and differs from every value."""
    return reduce(or_, [~a.eqNullSafe(b) for a, b in zip(left, right, strict=True)])
