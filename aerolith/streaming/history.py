"""Type-2 history maintained in micro-batches, in hash buckets of the keys.

A versioned folder (``sources.versioned``) holds three kinds of rows per bucket:

- ``open``: of every key its current version and the place of the last change seen of it; a key
  whose last change deleted it is kept with that place alone,
- ``closed``: versions that have ended,
- ``log``: all changes.

A batch touches the buckets of its keys only.  A key whose changes all come after the last one
seen goes on from its current version: its bucket of ``open`` is rewritten, ``closed`` and ``log``
are appended to.  A key with a late change is built anew from its log, repeats and deletes
included, so the history always equals a rebuild from all changes; for that the bucket's log and
closed versions are read, and the closed ones rewritten.  Appended folders are merged as they
gather, so the folders of a bucket grow with the logarithm of the number of batches.

The version file that ends a batch also holds the batch's number: a batch that died half-way is
not seen, and one that is repeated is skipped.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from aerolith.operators.changes import ACTION, net_changes
from aerolith.operators.history import CURRENT, END, START, HistorySpec, HotKeys, as_log, scd2_rebuild
from aerolith.operators.ordered import split_by_key
from aerolith.session import remove_dir, scratch_dir
from aerolith.sources.versioned import KIND, PART, Folder, Version, VersionedFolder, bucket, merged_tail
from aerolith.sources.writers import overwrite_parquet

OPEN, CLOSED, LOG = "open", "closed", "log"
SEEN, GONE = "_seen", "_gone"
#: Versions without a whole key match nothing and lie in a bucket of their own.
LOOSE = "loose"


def history_schema(changes: T.StructType, spec: HistorySpec) -> T.StructType:
    kind = changes[spec.ts].dataType
    kept = [field for field in changes if field.name not in {spec.ts, ACTION}]
    return T.StructType([
        *kept, T.StructField(START, kind), T.StructField(END, kind), T.StructField(CURRENT, T.StringType()),
    ])


def _schemas(changes: T.StructType, spec: HistorySpec) -> dict[str, T.StructType]:
    versions = history_schema(changes, spec)
    place = T.StructType([T.StructField(name, changes[name].dataType) for name in (spec.ts, spec.seq) if name])
    log = T.StructType([field for field in changes if field.name != ACTION]).add(ACTION, "string")
    return {OPEN: T.StructType([*versions, T.StructField(SEEN, place), T.StructField(GONE, T.BooleanType())]), CLOSED: versions, LOG: log}


def last_finished(spark: SparkSession, root: str) -> int | None:
    """Number of the last batch that is part of the history."""
    return VersionedFolder(spark, root).latest().notes.get("batch")


def _place(spec: HistorySpec) -> Column:
    return F.struct(*[name for name in (spec.ts, spec.seq) if name])


def apply_batch(changes: DataFrame, batch_id: int, root: str, spec: HistorySpec, hot: HotKeys | None = HotKeys(),
                buckets: int = 64, writer: str | None = None) -> None:
    """Folds one micro-batch into the history under ``root``.

    ``writer`` names the checkpoint that numbers the batches; another one is refused, since its
    batches count from 0 again and would be taken for repeats.  The number of ``buckets`` is
    that of the first batch.
    """
    spark = changes.sparkSession
    files = VersionedFolder(spark, root)
    base = files.latest()
    known = base.notes.get("writer")
    if known and writer and known != writer:
        raise ValueError(f"the history in {root} belongs to another checkpoint; give that one, or a new folder")
    if base.notes.get("batch") is not None and base.notes["batch"] >= batch_id:
        return
    notes = {"batch": batch_id, "writer": known or writer, "buckets": base.notes.get("buckets", buckets)}
    if ACTION not in changes.columns:
        changes = changes.withColumn(ACTION, F.lit("INSERT"))
    if not spec.close_on_delete:
        changes = changes.filter(~F.coalesce(F.col(ACTION) == "DELETE", F.lit(False)))
    work = scratch_dir(spark, "history-batch")
    try:
        _fold(files, base, changes, spec, hot, notes, work)
    finally:
        remove_dir(spark, work)


def _fold(files: VersionedFolder, base: Version, changes: DataFrame, spec: HistorySpec, hot: HotKeys | None, notes: dict, work: str) -> None:
    schemas = _schemas(changes.schema, spec)
    part = bucket(spec.keys, notes["buckets"]).cast("string")
    changes = changes.select(*schemas[LOG].names).withColumn(PART, part)
    batch = overwrite_parquet(changes, f"{work}/batch")
    keyed, loose = split_by_key(batch, spec.keys)

    # Per changed key its bucket, the first and the last change, and whether any of them is late.
    place = _place(spec)
    per_key = keyed.groupBy(*spec.keys, PART).agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    touched = [row[0] for row in per_key.select(PART).distinct().collect()]  # at most as many as there are buckets
    before = files.read(base, OPEN, touched, schemas[OPEN])
    seen = before.select(*spec.keys, SEEN)
    late = F.coalesce(F.col("_first") <= F.col(SEEN), F.lit(False))
    keys = overwrite_parquet(
        per_key.join(seen, spec.keys, "left").withColumn("_late", late)
        .withColumn(SEEN, F.greatest("_last", SEEN)).drop("_first", "_last"), f"{work}/keys")
    behind = keys.filter("_late").select(*spec.keys)
    anew = {row[0] for row in keys.filter("_late").select(PART).distinct().collect()}

    going_on = before.filter(~F.col(GONE)).drop(SEEN, GONE).join(keys.filter(~F.col("_late")).select(*spec.keys), spec.keys, "left_semi")
    chain = keyed.select(*schemas[LOG].names).unionByName(as_log(going_on, spec).withColumn(ACTION, F.lit("INSERT")))
    if anew:
        chain = chain.unionByName(files.read(base, LOG, anew, schemas[LOG]).join(behind, spec.keys, "left_semi"))
    chain = overwrite_parquet(chain, f"{work}/chain")
    # Keys repeat without bound among the changes only, unless late ones bring their log.
    made = overwrite_parquet(scd2_rebuild(chain, spec, hot, counted=None if anew else keyed.select(*schemas[LOG].names)), f"{work}/made")

    current = made.filter(F.col(CURRENT) == "Y")
    states = keys.drop("_late", PART).join(current, spec.keys, "left").withColumn(GONE, F.col(CURRENT).isNull())
    states = states.select(*schemas[OPEN].names).unionByName(before.join(keys.select(*spec.keys), spec.keys, "left_anti"))
    ended = made.filter(F.col(CURRENT) != "Y")
    if anew:
        ended = ended.unionByName(files.read(base, CLOSED, anew, schemas[CLOSED]).join(behind, spec.keys, "left_anti"))

    # Folders of earlier appends that this batch takes in.
    tails = {}
    for kind, of in ((CLOSED, {*touched, LOOSE} - anew), (LOG, set(touched))):
        for one in of:
            found = base.folders.get(f"{kind}/{one}", [])
            if merged_tail(found):
                tails[f"{kind}/{one}"] = found[-merged_tail(found):]

    def taken_in(kind: str, loose: bool = False) -> DataFrame:
        names = [name for name in tails if name.startswith(f"{kind}/") and name.endswith(f"/{LOOSE}") == loose]
        return files.read_folders([f for name in names for f in tails[name]], schemas[kind])

    def of_kind(rows: DataFrame, kind: str, part: Column = part) -> DataFrame:
        return rows.withColumns({KIND: F.lit(kind), PART: part})

    alone = loose.filter(~F.coalesce(F.col(ACTION) == "DELETE", F.lit(False))).drop(ACTION, PART).withColumnRenamed(spec.ts, START)
    alone = alone.withColumns({END: F.lit(None).cast(schemas[CLOSED][END].dataType), CURRENT: F.lit("Y")})
    parts = [
        of_kind(states, OPEN),
        of_kind(ended.unionByName(taken_in(CLOSED)), CLOSED),
        of_kind(keyed.select(*schemas[LOG].names).unionByName(taken_in(LOG)), LOG),
        of_kind(alone.unionByName(taken_in(CLOSED, True)), CLOSED, F.lit(LOOSE)),
    ]
    written = files.write(reduce(partial(DataFrame.unionByName, allowMissingColumns=True), parts))

    folders: dict[str, list[Folder]] = {f"{OPEN}/{one}": [] for one in touched} | {f"{CLOSED}/{one}": [] for one in anew}
    for name, path in written.items():
        tail = tails.get(name, [])
        stored = folders[name] if name in folders else base.folders.get(name, [])
        kept = stored[:len(stored) - len(tail)] if tail else stored
        folders[name] = [*kept, Folder(path, 1 + sum(f.appends for f in tail))]
    files.commit(base, folders, schemas, notes)
    files.drop_old(keep=2)


def start_history(stream: DataFrame, root: str, checkpoint: str, spec: HistorySpec, every: str | None = None,
                  hot: HotKeys | None = HotKeys(), buckets: int = 64) -> StreamingQuery:
    """Keeps the history current: one fold per micro-batch, none without new data.

    ``every`` ("1 minute") sets the pace; without it what is waiting is folded in and the
    query ends.  A history goes on only with the checkpoint it began with: another one ends
    the query with an error, before any of its input counts as read.
    """
    def fold(changes: DataFrame, batch_id: int) -> None:
        writer = changes.sparkSession.read.text(f"{checkpoint}/metadata").first()[0]
        apply_batch(changes, batch_id, root, spec, hot, buckets, writer)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_current(spark: SparkSession, root: str, changes: T.StructType, spec: HistorySpec) -> DataFrame:
    """Current versions only, whatever the length of the history."""
    files = VersionedFolder(spark, root)
    version, schemas = files.latest(), _schemas(changes, spec)
    current = files.read(version, OPEN, schema=schemas[OPEN]).filter(~F.col(GONE)).drop(SEEN, GONE)
    return current.unionByName(files.read(version, CLOSED, [LOOSE], schemas[CLOSED]))


def read_history(spark: SparkSession, root: str, changes: T.StructType, spec: HistorySpec) -> DataFrame:
    """The whole history as of the last finished batch."""
    files = VersionedFolder(spark, root)
    version, schemas = files.latest(), _schemas(changes, spec)
    current = files.read(version, OPEN, schema=schemas[OPEN]).filter(~F.col(GONE)).drop(SEEN, GONE)
    return current.unionByName(files.read(version, CLOSED, schema=schemas[CLOSED]))


def version_changes(spark: SparkSession, root: str, changes: T.StructType, spec: HistorySpec, since: int, until: int | None = None) -> DataFrame:
    """Versions that came or went between two states of the stored history, as signed rows.

    Only folders that one of the two states does not name are read.  The history keeps its last
    two states, so ask after each batch.
    """
    files, schemas = VersionedFolder(spark, root), _schemas(changes, spec)
    before, after = files.at(since), files.latest() if until is None else files.at(until)
    current = files.changes(before, after, OPEN, schemas[OPEN]).filter(~F.col(GONE)).drop(SEEN, GONE)
    both = current.unionByName(files.changes(before, after, CLOSED, schemas[CLOSED]))
    return net_changes(both)


def stored_state(spark: SparkSession, root: str) -> int:
    """Number of the stored history's last state."""
    return VersionedFolder(spark, root).latest().number
