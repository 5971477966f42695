"""Stored tables that change by versions.

A write puts its rows into a new data folder, split by kind and part, and nothing that is there is
ever changed.  What counts is named by a small file per version, put in place last and by
renaming: a writer that dies before leaves the last version as it was, and readers of an older
version go on reading it.  Parts that a write does not touch keep their folders, so its cost
follows the touched parts and not the table.  Of two writers that start from one version the
second is refused.

``VersionedFolder`` keeps several kinds of rows under one version (see ``streaming.history``),
``VersionedTable`` is a table of one kind with keys.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aerolith.operators.changes import table_changes
from aerolith.session import list_names, put_text, read_text, remove_dir
from aerolith.sources.writers import insert_select, settle, upsert

KIND, PART = "_kind", "_part"
ROWS = "rows"
#: As many folders of one size, counted in appends, are merged into one by the next append.
FAN = 4


class ConcurrentWrite(RuntimeError):
    """Another writer has put its version in place first."""


@dataclass(frozen=True)
class Folder:
    """Rows of one part that one write left; ``appends`` counts the appends in it."""

    path: str
    appends: int = 1


@dataclass(frozen=True)
class Version:
    """Which folders hold each part, named ``kind/part``, at one time; oldest folder first."""

    number: int = 0
    folders: dict[str, list[Folder]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)

    def parts(self, kind: str) -> set[str]:
        return {name.split("/", 1)[1] for name in self.folders if name.split("/", 1)[0] == kind}

    def written(self) -> str:
        folders = {name: [[f.path, f.appends] for f in found] for name, found in self.folders.items()}
        return json.dumps({"folders": folders, "schemas": self.schemas, "notes": self.notes})

    @classmethod
    def parsed(cls, number: int, text: str) -> Version:
        given = json.loads(text)
        folders = {name: [Folder(*entry) for entry in found] for name, found in given["folders"].items()}
        return cls(number, folders, given["schemas"], given["notes"])


def merged_tail(folders: list[Folder], fan: int = FAN) -> int:
    """How many of the last folders an append takes in, so that their number stays logarithmic."""
    taken, size = 0, 1
    while len(folders) - taken >= fan - 1 and all(f.appends <= size for f in folders[len(folders) - taken - fan + 1:len(folders) - taken]):
        taken, size = taken + fan - 1, size * fan
    return taken


class VersionedFolder:
    """Versions of rows by kind and part under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def numbers(self) -> list[int]:
        names = list_names(self.spark, f"{self.root}/versions")
        return sorted(int(name[:-5]) for name in names if re.fullmatch(r"\d+\.json", name))

    def latest(self) -> Version:
        """The last version; an empty one, number 0, before the first write."""
        numbers = self.numbers()
        return self.at(numbers[-1]) if numbers else Version()

    def at(self, number: int) -> Version:
        if number == 0:
            return Version()
        return Version.parsed(number, read_text(self.spark, f"{self.root}/versions/{number:010d}.json"))

    def schema(self, version: Version, kind: str = ROWS) -> StructType:
        return StructType.fromJson(json.loads(version.schemas[kind]))

    def read(self, version: Version, kind: str = ROWS, parts: Iterable[str] | None = None, schema: StructType | None = None) -> DataFrame:
        """Rows of a kind, of the named parts only if given; only the folders of those are listed."""
        wanted = version.parts(kind) if parts is None else set(parts)
        return self.read_folders([f for part in sorted(wanted) for f in version.folders.get(f"{kind}/{part}", [])],
                                 schema or self.schema(version, kind))

    def read_folders(self, folders: list[Folder], schema: StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f.path}" for f in folders])

    def changes(self, before: Version, after: Version, kind: str = ROWS, schema: StructType | None = None) -> DataFrame:
        """Rows of a kind that came and went.  Folders that both versions name cancel out and are not read."""
        schema = schema or self.schema(after, kind)
        old, new = ({f.path: f for part in version.parts(kind) for f in version.folders[f"{kind}/{part}"]} for version in (before, after))
        return table_changes(
            self.read_folders([f for path, f in old.items() if path not in new], schema),
            self.read_folders([f for path, f in new.items() if path not in old], schema))

    def write(self, rows: DataFrame) -> dict[str, str]:
        """Stores rows by their ``_kind`` and ``_part`` (digits, letters, ``-``); returns the folder of each.

        A part that is too full for one task is written by several: that is Spark's rebalancing.
        """
        own = f"data/{uuid.uuid4().hex}"
        rows.hint("rebalance", KIND, PART).write.partitionBy(KIND, PART).parquet(f"{self.root}/{own}")
        found = {}
        for kind in list_names(self.spark, f"{self.root}/{own}"):
            if kind.startswith(f"{KIND}="):
                for part in list_names(self.spark, f"{self.root}/{own}/{kind}"):
                    found[f"{kind.split('=')[1]}/{part.split('=')[1]}"] = f"{own}/{kind}/{part}"
        return found

    def commit(self, base: Version, folders: dict[str, list[Folder]], schemas: dict[str, StructType] | None = None,
               notes: dict | None = None) -> Version:
        """Puts the next version in place: ``base`` with the folders of the given parts, empty lists removed."""
        both = {name: found for name, found in {**base.folders, **folders}.items() if found}
        texts = {kind: json.dumps(schema.jsonValue()) for kind, schema in (schemas or {}).items()}
        version = Version(base.number + 1, both, {**base.schemas, **texts}, {**base.notes, **(notes or {})})
        if not put_text(self.spark, f"{self.root}/versions/{version.number:010d}.json", version.written()):
            raise ConcurrentWrite(f"version {version.number} of {self.root} is there already")
        return version

    def drop_old(self, keep: int = 1) -> None:
        """Removes all but the last ``keep`` (one or more) versions, and data folders that none of those names.

        Data of a write that has not put its version in place yet goes as well: call it
        between writes.
        """
        numbers = self.numbers()
        kept = [self.at(number) for number in numbers[-keep:]]
        for number in numbers[:-keep]:
            remove_dir(self.spark, f"{self.root}/versions/{number:010d}.json")
        used = {f.path for version in kept for found in version.folders.values() for f in found}
        writes = {path.split("/")[1] for path in used}
        for write in list_names(self.spark, f"{self.root}/data"):
            if write not in writes:
                remove_dir(self.spark, f"{self.root}/data/{write}")
                continue
            for kind in list_names(self.spark, f"{self.root}/data/{write}"):
                if kind.startswith(f"{KIND}="):
                    for part in list_names(self.spark, f"{self.root}/data/{write}/{kind}"):
                        if f"data/{write}/{kind}/{part}" not in used:
                            remove_dir(self.spark, f"{self.root}/data/{write}/{kind}/{part}")


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(key) for key in keys]), F.lit(buckets)).cast("int")


class VersionedTable:
    """A stored table with appends, merges by key, corrections and reads of older versions.

    ``part`` says which part a row belongs to, as a whole number or a date; it must depend on
    the keys alone and is a bucket of them by default.  The parts of a table are listed in
    every version file, so keep them to some thousands.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 64, part: Column | None = None):
        self.files, self.keys = VersionedFolder(spark, root), keys
        self.part = bucket(keys, buckets) if part is None else part

    @property
    def version(self) -> int:
        return self.files.latest().number

    def read(self, version: int | None = None, parts: Iterable[str] | None = None) -> DataFrame:
        return self.files.read(self.files.latest() if version is None else self.files.at(version), parts=parts)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({KIND: F.lit(ROWS), PART: F.coalesce(self.part.cast("string"), F.lit("none"))})

    def parts_of(self, rows: DataFrame) -> list[str]:
        """Parts that rows belong to: as many as the table has at most."""
        return [row[0] for row in self._placed(rows).select(PART).distinct().collect()]

    def replace_parts(self, rows: DataFrame, parts: Iterable[str], schema: StructType | None = None, notes: dict | None = None) -> int:
        """Puts ``rows``, all of them in the named parts, in place of what these parts hold."""
        base = self.files.latest()
        return self._replace(base, rows, parts, schema or self.files.schema(base), notes)

    def _replace(self, base: Version, rows: DataFrame, parts: Iterable[str], schema: StructType, notes: dict | None) -> int:
        written = self.files.write(self._placed(rows))
        folders = {f"{ROWS}/{part}": [] for part in parts}
        folders |= {name: [Folder(path)] for name, path in written.items()}
        return self.files.commit(base, folders, {ROWS: schema}, notes).number

    def overwrite(self, rows: DataFrame, notes: dict | None = None) -> int:
        base = self.files.latest()
        return self._replace(base, rows, base.parts(ROWS), rows.schema, notes)

    def append(self, rows: DataFrame, notes: dict | None = None) -> int:
        """Adds rows as they are; parts with many small folders are merged on the way."""
        base = self.files.latest()
        schema = self.files.schema(base) if ROWS in base.schemas else rows.schema
        written = self.files.write(self._placed(rows.select(*schema.names)))
        folders = {name: [*base.folders.get(name, []), Folder(path)] for name, path in written.items()}
        return self._merged(self.files.commit(base, folders, {ROWS: schema}, notes)).number

    def insert_select(self, query: DataFrame, columns: dict[str, Column] | None = None) -> int:
        """Appends a projected query; table columns not named become null."""
        nothing = self.files.spark.createDataFrame([], self.files.schema(self.files.latest()))
        return self.append(insert_select(nothing, query, columns))

    def _merged(self, version: Version) -> Version:
        """Merges the folders of appends that have gathered in a part."""
        tails = {name: merged_tail(found[:-1]) for name, found in version.folders.items()}
        tails = {name: n + 1 for name, n in tails.items() if n}
        if not tails:
            return version
        together = [f for name, n in tails.items() for f in version.folders[name][-n:]]
        written = self.files.write(self._placed(self.files.read_folders(together, self.files.schema(version))))
        folders = {
            name: [*version.folders[name][:-n], Folder(written[name], sum(f.appends for f in version.folders[name][-n:]))]
            for name, n in tails.items()
        }
        return self.files.commit(version, folders)

    def merge(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], schema: StructType | None = None,
              notes: dict | None = None) -> int:
        """Puts ``combine(stored, changes)`` in place of the parts that the changes belong to.

        ``stored`` holds these parts alone; ``schema`` is that of the table, for the first write.
        """
        base = self.files.latest()
        schema = self.files.schema(base) if ROWS in base.schemas else schema or changes.schema
        changes = settle(changes, "changes")
        touched = self.parts_of(changes)
        combined = combine(self.files.read(base, parts=touched, schema=schema), changes).select(*schema.names)
        return self._replace(base, combined, touched, schema, notes)

    def upsert(self, changes: DataFrame, latest_by: list[str] | None = None, notes: dict | None = None) -> int:
        """Replaces known keys and adds new ones, rewriting the parts of the changed keys only."""
        return self.merge(changes, lambda stored, new: upsert(stored, new, self.keys, latest_by), notes=notes)

    def rewrite(self, where: Column, change: Callable[[DataFrame], DataFrame], notes: dict | None = None) -> int:
        """Applies ``change`` to the parts that hold a row for which ``where`` is true; others keep their files."""
        base = self.files.latest()
        touched = self.parts_of(self.files.read(base).filter(where))
        changed = change(self.files.read(base, parts=touched))
        return self._replace(base, changed, touched, self.files.schema(base), notes)

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """Rows that came and went between two versions, read from the folders that only one of them names."""
        before, after = self.files.at(since), self.files.latest() if until is None else self.files.at(until)
        return self.files.changes(before, after)

    def drop_old(self, keep: int = 1) -> None:
        self.files.drop_old(keep)
