"""Which version of its key each fact belongs to, kept as history changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.operators.changes import ACTION
from aerolith.operators.history import END, START, HotKeys, valid_at
from aerolith.operators.ordered import split_by_key
from aerolith.sources.versioned import VersionedTable
from aerolith.sources.writers import settle


def changed_spans(changes: DataFrame, keys: list[str], take: list[str]) -> DataFrame:
    """Per key the span of time in which another version, or none, is valid: ``_from`` and ``_to`` (null: open).

    ``changes`` are versions that came and went, with their action.  One that only ends at
    another time than before changes nothing up to the earlier of its ends.
    """
    whole, _ = split_by_key(changes, keys)
    far = F.lit("9999-12-31 23:59:59.999999").cast(changes.schema[END].dataType)
    end = F.coalesce(END, far)
    each = whole.groupBy(*dict.fromkeys([*keys, START, *take])).agg(
        F.count_distinct(ACTION).alias("_actions"), F.min(end).alias("_least"), F.max(end).alias("_most"))
    start = F.when(F.col("_actions") > 1, F.col("_least")).otherwise(F.col(START))
    return each.groupBy(*keys).agg(F.min(start).alias("_from"), F.nullif(F.max("_most"), far).alias("_to"))


class FactVersions:
    """A stored map from facts to the versions valid at their time.

    ``take`` maps result names to history columns, ``id`` names the columns that tell facts
    apart.  The map lies in buckets of the history's keys.  New facts are appended; when versions
    come or go, only facts inside the spans of these versions are looked up again, and only
    buckets that hold such facts are rewritten.
    """

    def __init__(self, spark: SparkSession, root: str, id: list[str], keys: list[str], ts: str, take: dict[str, str], buckets: int = 64,
                 hot: HotKeys | None = HotKeys()):
        self.id, self.keys, self.ts, self.take, self.hot = id, keys, ts, take, hot
        self.table = VersionedTable(spark, root, keys, buckets)

    def _mapped(self, facts: DataFrame, history: DataFrame) -> DataFrame:
        # A version of a key without facts here can be left out before anything is sorted.
        near = history.join(facts.select(*self.keys).distinct(), self.keys, "left_semi")
        return valid_at(facts, near, self.keys, self.ts, self.take, self.hot)

    def add(self, facts: DataFrame, history: DataFrame) -> int:
        """Maps new facts; of a fact its id, keys and time are kept."""
        new = settle(facts.select(*dict.fromkeys([*self.id, *self.keys, self.ts])), "new-facts")
        return self.table.append(self._mapped(new, history))

    def inside(self, spans: DataFrame) -> DataFrame:
        """Stored facts in the given spans, one of which there is per key."""
        stored = self.table.read(parts=self.table.parts_of(spans))
        dated = stored.join(spans, self.keys)
        within = (F.col(self.ts) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(self.ts) < F.col("_to")))
        return dated.filter(within).select(*stored.columns)

    def remap(self, changes: DataFrame, history: DataFrame) -> int:
        """Brings the map up to ``history``, which differs by ``changes`` from the one it was made with."""
        spans = settle(changed_spans(changes, self.keys, list(self.take.values())), "changed-spans")
        if spans.isEmpty():
            return self.table.version
        facts = settle(self.inside(spans).drop(*self.take), "facts-to-remap")
        if facts.isEmpty():
            return self.table.version

        def replaced(stored: DataFrame, mapped: DataFrame) -> DataFrame:
            return stored.join(facts.select(*self.id), self.id, "left_anti").unionByName(mapped)

        return self.table.merge(self._mapped(facts, history), replaced)

    def read(self) -> DataFrame:
        return self.table.read()
