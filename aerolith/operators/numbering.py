"""Running numbers without gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.sources.versioned import VersionedTable
from aerolith.sources.writers import settle

_AT = "_at"
#: Spark's increasing ids hold the partition above these bits and the row's place in it below.
_PLACE_BITS = 33


def dense_numbers(df: DataFrame, name: str, order: list | None = None, after: int = 0) -> DataFrame:
    """Numbers the rows ``after + 1``, ``after + 2``, ... in two passes.

    The first pass writes every row with its partition and its place there, so that both stay
    as they are; the second counts rows per partition, adds these counts up (one row
    per partition) and gives place + offset.  No task holds more than one partition.  With
    ``order`` the numbers follow it over the whole table, by a range shuffle; rows equal in it are
    numbered in any order, and spread by a hash so that they never fill one task.
    """
    hashed = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    rows = df.orderBy(*order, F.xxhash64(*hashed)) if order else df
    placed = settle(rows.withColumn(_AT, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(_AT, _PLACE_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).select(
        "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    place = F.col(_AT).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # one row per partition
    return numbered.select((F.col("_offset") + place + F.lit(after + 1)).alias(name), *[F.col(f"`{c}`") for c in df.columns])


def append_numbered(table: VersionedTable, rows: DataFrame, name: str, order: list | None = None) -> int:
    """Appends rows whose numbers go on after the last one the table has given.

    That number is part of the version, so of two writers only one can use it; an append that
    failed gives none away.
    """
    after = table.files.latest().notes.get(f"last {name}", 0)
    numbered = settle(dense_numbers(rows, name, order, after), "numbers")
    return table.append(numbered, {f"last {name}": after + numbered.count()})
