"""Point-in-time state of a table kept as a log of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.operators.changes import ACTION, differs

AT_END = None


def _ordinal(ts: str, seq: str | None) -> Column:
    return F.struct(ts, seq) if seq else F.struct(ts)


def _alive(row: str, deletes: bool) -> Column:
    """A key is in the state when its last change exists and is no delete."""
    exists = F.col(row).isNotNull()
    if not deletes:
        return exists
    return exists & ~F.coalesce(F.col(f"{row}.{ACTION}") == "DELETE", F.lit(False))


def as_of(log: DataFrame, keys: list[str], ts: str, at=AT_END, seq: str | None = None) -> DataFrame:
    """Last change of each key at or before ``at``, without deleted keys.

    max_by is a partial aggregate: each task sends one row per key, so a hot key
    costs no more than any other.
    """
    if at is not AT_END:
        log = log.filter(F.col(ts) <= at)
    values = F.struct(*[name for name in log.columns if name not in keys])
    last = log.groupBy(*keys).agg(F.max_by(values, _ordinal(ts, seq)).alias("_row"))
    state = last.filter(_alive("_row", ACTION in log.columns))
    kept = [name for name in log.columns if name != ACTION]
    return state.select(*[
        F.col(name) if name in keys else F.col(f"_row.{name}").alias(name) for name in kept
    ])


def seconds_ago(now: Column, seconds: int) -> Column:
    """The instant ``seconds`` before ``now``."""
    return F.timestamp_add("SECOND", F.lit(-seconds), now)


def as_of_diff(log: DataFrame, keys: list[str], ts: str, earlier: Column, later: Column,
               columns: list[str], seq: str | None = None) -> DataFrame:
    """Keys whose state differs between two instants: ``before_*`` and ``after_*``.

    Both states come from one scan and one shuffle: an aggregate per instant.
    """
    deletes = ACTION in log.columns
    values = F.struct(*columns, *([ACTION] if deletes else []))
    order = _ordinal(ts, seq)
    both = (
        log.filter(F.col(ts) <= F.greatest(earlier, later))
        .groupBy(*keys)
        .agg(
            F.max_by(values, F.when(F.col(ts) <= earlier, order)).alias("_before"),
            F.max_by(values, F.when(F.col(ts) <= later, order)).alias("_after"),
        )
        .withColumn("_was", _alive("_before", deletes))
        .withColumn("_is", _alive("_after", deletes))
    )
    before = [F.when(F.col("_was"), F.col(f"_before.{c}")) for c in columns]
    after = [F.when(F.col("_is"), F.col(f"_after.{c}")) for c in columns]
    changed = both.filter((F.col("_was") != F.col("_is")) | differs(before, after))
    return changed.select(
        *keys,
        *[value.alias(f"before_{c}") for c, value in zip(columns, before)],
        *[value.alias(f"after_{c}") for c, value in zip(columns, after)],
    )


def diff_states(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The same comparison for two given states, each with one row per key."""
    left = before.select(*keys, F.lit(True).alias("_was"), *[F.col(c).alias(f"before_{c}") for c in columns])
    right = after.select(*keys, F.lit(True).alias("_is"), *[F.col(c).alias(f"after_{c}") for c in columns])
    joined = left.join(right, keys, "full_outer")
    changed = differs(
        [F.col("_was")] + [F.col(f"before_{c}") for c in columns],
        [F.col("_is")] + [F.col(f"after_{c}") for c in columns],
    )
    return joined.filter(changed).drop("_was", "_is")
