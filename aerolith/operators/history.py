"""Type-2 history: versions of a row with a validity interval and a current flag."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.operators.changes import ACTION, differs
from aerolith.operators.ordered import SLICE, HotKeys, Order, slice_hot_keys, split_by_key
from aerolith.sources.writers import latest_per_key, settle, upsert

START, END, CURRENT = "effective_start", "effective_end", "is_current"
_DELETED = "_deleted"
_TIE = "_tie"


@dataclass(frozen=True)
class HistorySpec:
    """Key, tracked columns, and the order of changes.

    ``seq`` is an integer that orders changes with equal time; ``close_on_delete``
    lets a DELETE record end the current version (by default only new images count).
    """

    keys: list[str]
    tracked: list[str]
    ts: str
    seq: str | None = None
    close_on_delete: bool = False

    @property
    def order(self) -> Order:
        return Order(self.keys, self.ts, self.seq)


def open_versions(rows: DataFrame, start: Column) -> DataFrame:
    """Initial load: every row is current from ``start``."""
    return rows.select(
        "*",
        start.alias(START),
        F.lit(None).cast(rows.select(start.alias("s")).schema["s"].dataType).alias(END),
        F.lit("Y").alias(CURRENT),
    )


def _images(log: DataFrame, spec: HistorySpec) -> DataFrame:
    """Marks deletes, or leaves them out, and drops the action column."""
    if ACTION not in log.columns:
        return log.withColumn(_DELETED, F.lit(False))
    marked = log.withColumn(_DELETED, F.coalesce(F.col(ACTION) == "DELETE", F.lit(False))).drop(ACTION)
    return marked if spec.close_on_delete else marked.filter(~F.col(_DELETED))


def _with_tie(log: DataFrame, spec: HistorySpec) -> DataFrame:
    """Adds a hash of all that the order does not name, so that the layout of the rows never decides."""
    hashed = sorted(
        field.name for field in log.schema.fields
        if field.name not in {*spec.keys, spec.ts, spec.seq} and "map<" not in field.dataType.simpleString()
    )
    # A hash passes over nulls, so where they are is hashed as well.
    return log.withColumn(_TIE, F.xxhash64(*[c for name in hashed for c in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())]))


def scd2_rebuild(log: DataFrame, spec: HistorySpec, hot: HotKeys | None = HotKeys(),
                 counted: DataFrame | None = None) -> DataFrame:
    """The whole history from a log of changes.

    A version opens with each change that differs from the one before and ends when
    the next opens.  Other columns are those of the change that opened the version.
    Changes of a key with equal time and sequence are put in order by a hash of their other
    columns (but maps), so the result does not depend on the layout of the rows.
    Rows with a null key match nothing: each stays a current version of its own.
    ``counted`` may name the part of the log in which a key can repeat without bound.
    """
    keyed, loose = split_by_key(_images(log, spec), spec.keys)
    keyed, order = _with_tie(keyed, spec), replace(spec.order, tie=_TIE)
    counted = counted if counted is None else _with_tie(_images(counted, spec), spec)
    state = [F.col(name) for name in [*spec.tracked, _DELETED]]
    sliced = slice_hot_keys(keyed, order, hot, counted)
    if sliced.has_copies:
        # A change delivered many times: copies change nothing and combine before the shuffle.
        sliced = slice_hot_keys(keyed.distinct(), order, hot)
    chained = sliced.with_previous(F.struct(*state), "_before")
    before = [F.col("_before")[name] for name in [*spec.tracked, _DELETED]]
    opened = chained.filter(F.col("_before").isNull() | differs(state, before))
    ended = opened.with_next(F.col(spec.ts), END).df
    versions = _versions(ended.drop(SLICE, "_before", _TIE), spec, F.col(END))
    return versions.unionByName(_versions(loose, spec, F.lit(None).cast(log.schema[spec.ts].dataType)))


def _versions(rows: DataFrame, spec: HistorySpec, end: Column) -> DataFrame:
    kept = [name for name in rows.columns if name not in {spec.ts, END, _DELETED}]
    return rows.filter(~F.col(_DELETED)).select(
        *kept,
        F.col(spec.ts).alias(START),
        end.alias(END),
        F.when(end.isNull(), F.lit("Y")).otherwise(F.lit("N")).alias(CURRENT),
    )


def as_log(history: DataFrame, spec: HistorySpec) -> DataFrame:
    """Versions read as the changes that opened them."""
    return history.withColumnRenamed(START, spec.ts).drop(END, CURRENT)


def scd2_merge(history: DataFrame, changes: DataFrame, spec: HistorySpec,
               hot: HotKeys | None = HotKeys(), last_only: bool = False) -> DataFrame:
    """History after a batch: changed versions are closed and new ones opened in one pass.

    Several changes of a key are chained in order; ``last_only`` keeps the last one.
    Changes older than the current version are put in at their place.  Merging the
    same batch again changes nothing, and folding batches equals the rebuild, except
    that a repeat dropped earlier cannot come back when an older change arrives later.

    Only versions that end after the first change of their key are chained again;
    all others pass through, and those that ended before the batch without a join,
    so a batch in order joins current versions only.  The list of changed keys is written first, so whether
    the history is shuffled to it or it is broadcast is decided by its real size.
    """
    keyed, loose = split_by_key(_images(changes, spec), spec.keys)
    if last_only:
        keyed = latest_per_key(keyed, spec.keys, spec.order.columns)
    first = settle(keyed.groupBy(*spec.keys).agg(F.min(spec.ts).alias("_from")), "merge-keys")
    # What ended before the whole batch began is out of reach and skips the join.
    kind = history.schema[END].dataType
    begin = F.coalesce(F.min("_from"), F.lit("9999-12-31 23:59:59").cast(kind)).alias("begin")
    past = F.col(END) < first.agg(begin).scalar()
    out_of_reach, near = history.filter(past), history.filter(F.col(END).isNull() | ~past)
    dated = near.join(first, spec.keys, "left")
    touched = F.col("_from").isNotNull() & (F.col(END).isNull() | (F.col(END) >= F.col("_from")))
    affected = dated.filter(touched).drop("_from")
    untouched = dated.filter(~touched).select(*history.columns).unionByName(out_of_reach)

    pieces = as_log(affected, spec).withColumn(_DELETED, F.lit(False))
    if spec.close_on_delete:
        ends = affected.filter(F.col(END).isNotNull()).select(
            *[F.col(name) for name in pieces.columns if name not in {spec.ts, spec.seq, _DELETED}],
            F.col(END).alias(spec.ts),
            *([F.lit(None).cast(history.schema[spec.seq].dataType).alias(spec.seq)] if spec.seq else []),
            F.lit(True).alias(_DELETED),
        )
        # A version that was merely replaced ends where another of its key starts: that is no delete.
        starts = pieces.select(*[F.col(name).alias(f"_{name}") for name in [*spec.keys, spec.ts]])
        same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in [*spec.keys, spec.ts]]
        pieces = pieces.unionByName(ends.join(starts, same, "left_anti"))
    log = pieces.unionByName(keyed.select(*pieces.columns)).withColumn(
        ACTION, F.when(F.col(_DELETED), "DELETE").otherwise("INSERT")
    ).drop(_DELETED)
    # Written once, so that counting keys and chaining them do not repeat the join.
    log = log if hot is None else settle(log, "merge-log")
    merged = scd2_rebuild(log, spec, hot).unionByName(untouched)
    loose_rows = _versions(loose, spec, F.lit(None).cast(changes.schema[spec.ts].dataType))
    return merged.unionByName(loose_rows).select(*history.columns)


def scd2_merge_two_step(history: DataFrame, changes: DataFrame, spec: HistorySpec, now: Column) -> DataFrame:
    """One MERGE with two branches: a changed current version is closed, a key without
    a current version gets one.

    A closed key therefore has no current version until its change is seen again.
    The last change of each key counts.
    """
    source = latest_per_key(_images(changes, spec).filter(~F.col(_DELETED)), spec.keys, spec.order.columns)
    incoming = source.select(*spec.keys, F.struct(*spec.tracked).alias("_new"))
    current = F.coalesce(F.col(CURRENT) == "Y", F.lit(False))
    # Only current versions can match; closed ones skip the join.
    matched = history.filter(current).join(incoming, spec.keys, "left")
    changed = F.col("_new").isNotNull() & differs(
        [F.col(name) for name in spec.tracked], [F.col("_new")[name] for name in spec.tracked]
    )
    closed = matched.withColumns({
        END: F.when(changed, now).otherwise(F.col(END)),
        CURRENT: F.when(changed, F.lit("N")).otherwise(F.col(CURRENT)),
    }).select(*history.columns)
    known = history.filter(current).select(*spec.keys)
    unknown = source.join(known, spec.keys, "left_anti").withColumn(spec.ts, now)
    closed = closed.unionByName(history.filter(~current))
    return closed.unionByName(_versions(unknown, spec, F.lit(None).cast(history.schema[END].dataType)).select(*history.columns))


def current_versions(history: DataFrame) -> DataFrame:
    return history.filter(F.col(CURRENT) == "Y")


def history_of(history: DataFrame, keys: list[str], key: dict[str, object] | None = None) -> DataFrame:
    """Versions by key, latest first; of one key only when its values are given."""
    for name, value in (key or {}).items():
        history = history.filter(F.col(name) == F.lit(value))
    return history.orderBy(*keys, F.desc(START))


def valid_at(facts: DataFrame, history: DataFrame, keys: list[str], ts: str, take: dict[str, str],
             hot: HotKeys | None = HotKeys()) -> DataFrame:
    """Each fact with columns of the version valid at its time; null when there is none.

    ``take`` maps result names to history columns.  Facts and versions go through
    one sort per key and the last version before each fact is carried to it, so the
    work grows with facts plus versions.  An equi join with an interval condition
    would compare every fact of a key with every version of it.  Versions of a key
    must not overlap.
    """
    placed, loose = split_by_key(facts, [*keys, ts])
    versions, _ = split_by_key(history, [*keys, START])
    kinds = {name: history.schema[column].dataType for name, column in take.items()}
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]
    found, crowded = _carry_versions(placed, versions, keys, ts, take, hot)
    if crowded:
        # Many facts share one instant of one key: look up each instant once and join
        # it back, where AQE splits the hot side.
        instants = placed.select(*keys, ts).distinct()
        valid, _ = _carry_versions(instants, versions, keys, ts, take, hot)
        found = placed.join(valid, [*keys, ts], "left").select(*facts.columns, *take)
    return found.unionByName(loose.select("*", *nothing))


def _carry_versions(facts: DataFrame, versions: DataFrame, keys: list[str], ts: str,
                    take: dict[str, str], hot: HotKeys | None) -> tuple[DataFrame, bool]:
    """Facts (whole keys) with the version before them, and whether an instant holds too many to be cut."""
    version = F.struct(START, END, *sorted(set(take.values()) - {START, END}))
    # At one instant versions come before facts.
    left = facts.select(
        *keys, F.col(ts).alias("_ts"), F.lit(1).alias("_seq"), F.struct(*facts.columns).alias("_fact")
    )
    right = versions.select(
        *keys, F.col(START).alias("_ts"), F.lit(0).alias("_seq"), version.alias("_version")
    )
    sliced = slice_hot_keys(left.unionByName(right, allowMissingColumns=True), Order(keys, "_ts", "_seq"), hot)
    end = F.col(f"_version.{END}")
    open_end = F.lit("9999-12-31 23:59:59.999999").cast(versions.schema[END].dataType)
    latest = sliced.with_latest(F.col("_version"), "_valid", F.coalesce(end, open_end)).df
    inside = F.col(f"_valid.{END}").isNull() | (F.col("_ts") < F.col(f"_valid.{END}"))
    found = latest.filter(F.col("_fact").isNotNull()).select(
        "_fact.*", *[F.when(inside, F.col(f"_valid.{column}")).alias(name) for name, column in take.items()]
    )
    return found, sliced.has_copies


def replace_versions(history: DataFrame, versions: DataFrame, spec: HistorySpec) -> DataFrame:
    """Puts versions in by key and start: an idempotent write-back of corrected rows."""
    return upsert(history, versions, [*spec.keys, START])
