"""A stored change log with snapshots, for reads of the state at an instant."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.operators.asof import as_of, as_of_diff
from aerolith.operators.changes import ACTION
from aerolith.sources.versioned import KIND, PART, Folder, Version, VersionedFolder

LOG, SNAPSHOT = "log", "snapshot"
_INSTANT = "%Y%m%dT%H%M%S%f"


class SnapshotLog:
    """Changes by day of their time, and states at chosen instants.

    The state at an instant is read from the last snapshot before it and the days of the
    log after that snapshot; earlier days are not even listed.  Changes that arrive dated before
    a snapshot make it stale: it is dropped in the version that takes them in, so no
    read can meet it.  Times have no zone, or the session's.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], ts: str, seq: str | None = None):
        self.files, self.keys, self.ts, self.seq = VersionedFolder(spark, root), keys, ts, seq

    def append(self, changes: DataFrame) -> int:
        """Stores changes and drops the snapshots that are not older than all of them."""
        base = self.files.latest()
        schema = self.files.schema(base, LOG) if LOG in base.schemas else changes.schema
        day = F.coalesce(F.date_format(self.ts, "yyyy-MM-dd"), F.lit("none"))
        written = self.files.write(changes.select(*schema.names).withColumns({KIND: F.lit(LOG), PART: day}))
        folders = {name: [*base.folders.get(name, []), Folder(path)] for name, path in written.items()}
        days = sorted(name.split("/")[1] for name in written if not name.endswith("/none"))
        if days:
            first = self._at(self.files.read_folders([Folder(written[f"{LOG}/{days[0]}"])], schema).agg(F.min(self.ts)).first()[0])
            folders |= {f"{SNAPSHOT}/{name}": [] for name in base.parts(SNAPSHOT) if name >= first}
        return self.files.commit(base, folders, {LOG: schema, SNAPSHOT: schema}).number

    @staticmethod
    def _at(instant: dt.datetime) -> str:
        return instant.strftime(_INSTANT)

    def _literal(self, instant: dt.datetime) -> Column:
        return F.lit(instant.isoformat(sep=" ")).cast(self.files.schema(self.files.latest(), LOG)[self.ts].dataType)

    def snapshots(self) -> list[dt.datetime]:
        return [dt.datetime.strptime(name, _INSTANT) for name in sorted(self.files.latest().parts(SNAPSHOT))]

    def _changes(self, version: Version, since: dt.datetime, until: dt.datetime) -> DataFrame:
        """The last snapshot up to ``since``, and the log from there through ``until``."""
        taken = max((name for name in version.parts(SNAPSHOT) if name <= self._at(since)), default=None)
        start = dt.datetime.strptime(taken, _INSTANT) if taken else None
        days = [day for day in version.parts(LOG) if day != "none" and day <= until.strftime("%Y-%m-%d")
                and (start is None or day >= start.strftime("%Y-%m-%d"))]
        log = self.files.read(version, LOG, days).filter(F.col(self.ts) <= self._literal(until))
        if start is None:
            return log
        return log.filter(F.col(self.ts) > self._literal(start)).unionByName(self.files.read(version, SNAPSHOT, [taken]))

    def take(self, at: dt.datetime) -> int:
        """Stores the state at ``at``: of every key that exists then its last change."""
        base = self.files.latest()
        log = self._changes(base, at, at)
        state = as_of(log, self.keys, self.ts, seq=self.seq)
        if ACTION in log.columns:
            state = state.withColumn(ACTION, F.lit("INSERT"))
        written = self.files.write(state.select(*log.columns).withColumns({KIND: F.lit(SNAPSHOT), PART: F.lit(self._at(at))}))
        return self.files.commit(base, {name: [Folder(path)] for name, path in written.items()}).number

    def as_of(self, at: dt.datetime) -> DataFrame:
        """The state at an instant."""
        return as_of(self._changes(self.files.latest(), at, at), self.keys, self.ts, seq=self.seq)

    def diff(self, earlier: dt.datetime, later: dt.datetime, columns: list[str]) -> DataFrame:
        """Keys whose state differs between two instants, from one snapshot and one stretch of log."""
        changes = self._changes(self.files.latest(), earlier, later)
        return as_of_diff(changes, self.keys, self.ts, self._literal(earlier), self._literal(later), columns, self.seq)
