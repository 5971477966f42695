"""KPI tables by day, month and quarter: full, incremental and recomputed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions import dates
from aerolith.functions.numbers import exact_mean
from aerolith.operators.changes import ACTION, COPIES
from aerolith.sources.versioned import VersionedTable
from aerolith.sources.writers import upsert


@dataclass(frozen=True)
class Measures:
    """Source columns of a KPI table."""

    date: str = "flight_date"
    delay: str = "arrival_delay"
    cancelled: str = "cancelled"


@dataclass(frozen=True)
class Grain:
    """How one KPI table cuts time.

    ``start`` maps a date to the first day of its period, ``step`` that day to the
    first day of the next period, ``stored`` reads the first day back from a row.
    """

    key: list[str]
    start: Callable[[Column], Column]
    step: Callable[[Column], Column]
    labels: Callable[[Column], dict[str, Column]]
    stored: Callable[[], Column]
    with_total: bool = True


DAILY = Grain(
    key=["metric_date"],
    start=lambda date: date,
    step=lambda day: F.date_add(day, 1),
    labels=lambda day: {
        "metric_date": day,
        "month": F.month(day),
        "year": F.year(day),
        "quarter": dates.quarter_name(day),
    },
    stored=lambda: F.col("metric_date"),
    with_total=False,
)
MONTHLY = Grain(
    key=["month_date"],
    start=dates.month_start,
    step=lambda day: F.add_months(day, 1),
    labels=lambda day: {"month_date": day, "month": F.month(day), "year": F.year(day)},
    stored=lambda: F.col("month_date"),
)
QUARTERLY = Grain(
    key=["metric_quarter"],
    start=dates.quarter_start,
    step=lambda day: F.add_months(day, 3),
    labels=lambda day: {
        "year": F.year(day),
        "quarter": F.quarter(day),
        "metric_quarter": dates.year_quarter_name(day),
    },
    stored=lambda: dates.date_from_parts(F.col("year"), F.col("quarter") * 3 - 2, F.lit(1)),
)


#: First day of the period, and what a period's metrics are made of.  All but the first add up.
PERIOD, STATE = "period_start", ["flights", "delayed", "cancelled", "delay_sum", "delay_count"]


def period_state(facts: DataFrame, grain: Grain, measures: Measures = Measures(), copies: Column | None = None) -> DataFrame:
    """Counts and sums per period, which add up over any split of the facts.

    ``copies`` weighs each row: negative numbers take facts back.  One shuffle of one partial row
    per period and task.
    """
    delay, cancelled = F.col(measures.delay), F.col(measures.cancelled)
    weight = F.lit(1) if copies is None else copies
    # Counted in 64 bits; conditions that are null count as false.
    sums = [
        F.sum(weight.cast("long")),
        F.sum(F.when(delay > 0, weight).otherwise(0).cast("long")),
        F.sum(F.when(cancelled == 1, weight).otherwise(0).cast("long")),
        F.sum(delay if copies is None else delay * weight),
        F.sum(F.when(delay.isNotNull(), weight).otherwise(0).cast("long")),
    ]
    day = F.col(measures.date).cast("date")
    return facts.groupBy(grain.start(day).alias(PERIOD)).agg(*[value.alias(name) for name, value in zip(STATE, sums)])


def add_states(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """The sum of two states; periods without flights drop out."""
    both = stored.select(PERIOD, *STATE).unionByName(delta.select(PERIOD, *STATE))
    kinds = {name: stored.schema[name].dataType for name in STATE}
    total = both.groupBy(PERIOD).agg(*[F.sum(name).cast(kinds[name]).alias(name) for name in STATE])
    return total.filter(F.col("flights") != 0)


def state_metrics(state: DataFrame, grain: Grain) -> DataFrame:
    """The KPI table that a state stands for; labels are computed on its few rows."""
    labels = [column.alias(name) for name, column in grain.labels(F.col(PERIOD)).items()]
    total = [F.col("flights").alias("total_flights")] if grain.with_total else []
    return state.select(
        *labels, *total, F.col("delayed").alias("total_delayed_flights"), F.col("cancelled").alias("total_cancelled_flights"),
        exact_mean(F.col("delay_sum"), F.col("delay_count")).alias("avg_delay"),
    )


def period_metrics(facts: DataFrame, grain: Grain, measures: Measures = Measures()) -> DataFrame:
    """Delayed, cancelled and mean delay per period, and the total where the grain has one."""
    return state_metrics(period_state(facts, grain, measures), grain)


class StoredPeriods:
    """A KPI table kept under late, changed and deleted facts.

    The table stores states, one part per year.  A batch of signed changes becomes a state of its
    own, by an aggregate over the batch alone, and is added to the stored rows of its years: no
    other fact of a period is read again.
    """

    def __init__(self, spark: SparkSession, root: str, grain: Grain, measures: Measures = Measures()):
        self.grain, self.measures = grain, measures
        self.table = VersionedTable(spark, root, [PERIOD], part=F.year(PERIOD))

    def apply(self, changes: DataFrame, notes: dict | None = None) -> int:
        """Takes in facts, or changes with an action and, if rows repeat, their copies."""
        copies = F.lit(1)
        if COPIES in changes.columns:
            copies = F.col(COPIES)
        if ACTION in changes.columns:
            copies = F.when(F.col(ACTION) == "DELETE", -copies).otherwise(copies)
        delta = period_state(changes, self.grain, self.measures, copies)
        return self.table.merge(delta, add_states, notes=notes)

    def read(self) -> DataFrame:
        return state_metrics(self.table.read(), self.grain)


def newer_than_stored(facts: DataFrame, stored: DataFrame, grain: Grain, date: str) -> DataFrame:
    """Rows of periods after the last stored one; all rows when nothing is stored.

    The mark is a scalar subquery compared with the bare date column, so it prunes
    row groups in the scan.
    """
    mark = stored.agg(F.max(grain.stored()).alias("mark"))
    next_start = mark.select(grain.step(F.col("mark")).alias("next_start")).select(
        F.coalesce("next_start", F.lit("0001-01-01").cast("date")).cast(facts.schema[date].dataType)
    )
    return facts.filter(F.col(date) >= next_start.scalar())


def add_new_periods(stored: DataFrame, facts: DataFrame, grain: Grain,
                    measures: Measures = Measures()) -> DataFrame:
    """Incremental upkeep: aggregates only rows after the stored periods.

    Late rows, dated inside a stored period, are left out; ``recompute_periods``
    takes them in.
    """
    fresh = newer_than_stored(facts, stored, grain, measures.date)
    return upsert(stored, period_metrics(fresh, grain, measures), grain.key)


def recompute_periods(stored: DataFrame, facts: DataFrame, arrived: DataFrame, grain: Grain,
                      measures: Measures = Measures()) -> DataFrame:
    """Rebuilds the periods that newly arrived rows touch, late ones included.

    The touched periods are broadcast: there are never more of them than days in
    the calendar.  Their first and last day also bound the scan.
    """
    day = F.col(measures.date).cast("date")
    touched = arrived.select(grain.start(day).alias("_period")).distinct()
    kind = facts.schema[measures.date].dataType
    first = touched.agg(F.min("_period").cast(kind).alias("at"))
    past = touched.agg(grain.step(F.max("_period")).cast(kind).alias("at"))
    near = facts.filter(F.col(measures.date).between(first.scalar(), past.scalar()))
    affected = near.withColumn("_period", grain.start(day)).join(F.broadcast(touched), "_period", "left_semi")
    return upsert(stored, period_metrics(affected, grain, measures), grain.key)


def keep_up(table: VersionedTable, facts: DataFrame, grain: Grain, measures: Measures = Measures()) -> int:
    """``add_new_periods`` on a stored table: aggregates the rows after it and commits their periods."""
    fresh = newer_than_stored(facts, table.read(), grain, measures.date)
    return table.upsert(period_metrics(fresh, grain, measures))
