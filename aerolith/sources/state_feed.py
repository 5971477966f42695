"""Changes of a table that arrives as whole states, for consumers that each keep an offset."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.session import list_names, put_text, read_text
from aerolith.sources.versioned import PART, ROWS, VersionedTable


class StateFeed:
    """Stores the states of a table in buckets of its keys and hands out what changed.

    A new state is digested bucket by bucket in one scan (number of rows and two sums of
    their hashes, 128 bits together); only buckets whose digest differs are compared with
    anything, stored or read again.  Rows must not hold maps, which have no hash.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        self.table = VersionedTable(spark, f"{self.root}/states", keys, buckets)

    def _digests(self, state: DataFrame) -> dict[str, list[str]]:
        filled = [c for name in state.columns for c in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())]
        rows = state.select(
            self.table.part.cast("string").alias(PART), F.xxhash64(*filled).alias("one"), F.xxhash64(F.lit(1), *reversed(filled)).alias("two"))
        exact = [F.sum(F.col(name).cast("decimal(38,0)")).cast("string").alias(name) for name in ("one", "two")]
        found = rows.groupBy(PART).agg(F.count(F.lit(1)).cast("string").alias("n"), *exact)
        return {row[PART]: [row.n, row.one, row.two] for row in found.collect()}  # one row per bucket

    def put(self, state: DataFrame) -> int:
        """Takes a new state and returns its number; an unchanged one gets the number of the last."""
        files = self.table.files
        base = files.latest()
        digests, known = self._digests(state), base.notes.get("digests", {})
        differing = sorted(part for part in digests.keys() | known.keys() if digests.get(part) != known.get(part))
        if not differing and ROWS in base.schemas:
            return base.number
        changed = state.filter(self.table.part.cast("string").isin(differing))
        return self.table.replace_parts(changed, differing, state.schema, {"digests": digests})

    def _offset_path(self, consumer: str) -> str:
        return f"{self.root}/offsets/{consumer}.json"

    def offset(self, consumer: str) -> int:
        """The last state that the consumer has taken in; 0 at first."""
        if f"{consumer}.json" not in list_names(self.spark, f"{self.root}/offsets"):
            return 0
        return json.loads(read_text(self.spark, self._offset_path(consumer)))["state"]

    def changes(self, consumer: str) -> tuple[DataFrame, int]:
        """Changes since the consumer's offset, and the state up to which they go.

        The offset stays until ``done``, so what a consumer lost is handed out again.
        """
        until = self.table.version
        return self.table.changes(self.offset(consumer), until), until

    def done(self, consumer: str, state: int) -> None:
        put_text(self.spark, self._offset_path(consumer), json.dumps({"state": state}), replace=True)

    def drop_old(self) -> None:
        """Removes states that every consumer has passed."""
        names = [name[:-5] for name in list_names(self.spark, f"{self.root}/offsets") if name.endswith(".json") and not name.startswith(".")]
        behind = min([self.offset(name) for name in names], default=0)
        self.table.drop_old(max(self.table.version - behind + 1, 1))
