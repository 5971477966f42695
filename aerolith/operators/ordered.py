"""Order-dependent operators per key that survive hot keys.

A window partitioned by a key puts all rows of the key into one task.  Here a key
that holds more than a set share of all rows is cut into slices along its order.
Windows run per (key, slice); what must cross a slice edge is one row per slice,
taken by an aggregate and handed on by a small window over the slices.

Results are the same as those of the plain window, given an order without ties; only
the work is spread.
Without hot keys the plan is the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.dates import micros
from aerolith.operators.filters import all_present

SLICE = "_slice"
_EDGE = "_edge"


@dataclass(frozen=True)
class HotKeys:
    """When and how finely a key is cut.

    A key is hot above ``share`` of all rows, so there are fewer than 1/share hot
    keys, however large the table: that bounds what is collected and broadcast.
    Slices that are still too full are cut again, into ``cuts`` (two or more) parts,
    until only rows equal in the whole order are together; rows crowded into one
    instant are cut by their sequence number, then by the tie.
    """

    share: float = 1 / 50_000
    min_rows: int = 1_000_000
    cuts: int = 4096


@dataclass(frozen=True)
class Order:
    """Keys and order of the rows: a time column, and optional integers that break ties."""

    keys: list[str]
    ts: str
    seq: str | None = None
    tie: str | None = None

    @property
    def columns(self) -> list[str]:
        return [name for name in (self.ts, self.seq, self.tie) if name]

    @property
    def value(self) -> Column:
        return F.struct(*self.columns)


@dataclass(frozen=True)
class Sliced:
    """Rows with their slice: empty for ordinary keys, growing with the order for hot ones.

    A slice is named by its place in each cut, in hexadecimal digits of fixed width, so a
    part of a slice sorts where the slice was, however often it is cut.
    """

    df: DataFrame
    order: Order
    has_hot: bool = False
    has_copies: bool = False  # a hot group of rows that are equal in key and order

    def _window(self, order_by: list | None = None):
        return Window.partitionBy(*self.order.keys, SLICE).orderBy(*(order_by or self.order.columns))

    def _add(self, name: str, local: Column, edge: Column, pick) -> Sliced:
        """``local`` inside a slice; where it is null, what the other slices hand on."""
        df = self.df.withColumn(name, local)
        if self.has_hot:
            across = Window.partitionBy(*self.order.keys).orderBy(SLICE)
            handed = (
                self.df.filter(F.col(SLICE) != "")
                .groupBy(*self.order.keys, SLICE)
                .agg(edge.alias(_EDGE))
                .withColumn(_EDGE, pick(across))
            )
            df = (
                df.join(handed, [*self.order.keys, SLICE], "left")
                .withColumn(name, F.coalesce(F.col(name), F.col(_EDGE)))
                .drop(_EDGE)
            )
        return replace(self, df=df)

    def filter(self, condition: Column) -> Sliced:
        return replace(self, df=self.df.filter(condition))

    def with_previous(self, value: Column, name: str) -> Sliced:
        """Adds the value (a non-null struct) of the row before; null on a key's first row."""
        return self._add(
            name, F.lag(value).over(self._window()),
            F.max_by(value, self.order.value), lambda across: F.lag(_EDGE).over(across),
        )

    def with_next(self, value: Column, name: str) -> Sliced:
        """Adds the value (not null) of the row after; null on a key's last row."""
        return self._add(
            name, F.lead(value).over(self._window()),
            F.min_by(value, self.order.value), lambda across: F.lead(_EDGE).over(across),
        )

    def with_latest(self, value: Column, name: str, tie: Column) -> Sliced:
        """Adds the last non-null value up to and including each row.

        ``tie`` (not null) orders rows that are equal in (ts, seq).
        """
        order_by = [*[F.col(c) for c in self.order.columns], tie]
        up_to_here = self._window(order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return self._add(
            name, F.last(value, ignorenulls=True).over(up_to_here),
            F.max_by(value, F.when(value.isNotNull(), F.struct(*order_by))),
            lambda across: F.last(_EDGE, ignorenulls=True).over(
                across.rowsBetween(Window.unboundedPreceding, -1)
            ),
        )


#: A row's place in the order as plain numbers: time, sequence, tie.
_PLACE = ("_t", "_s", "_h")


def _with_position(df: DataFrame, order: Order) -> DataFrame:
    stamp = micros(F.col(order.ts), df.schema[order.ts].dataType.typeName())
    numbers = [stamp, *[F.col(name).cast("long") if name else F.lit(0) for name in (order.seq, order.tie)]]
    return df.withColumns({
        name: F.coalesce(number, F.lit(-(2 ** 62))) for name, number in zip(_PLACE, numbers)
    })


def slice_hot_keys(df: DataFrame, order: Order, hot: HotKeys | None = HotKeys(),
                   counted: DataFrame | None = None) -> Sliced:
    """Finds hot keys and numbers their slices; every key column must be filled.

    The first look counts rows per key and reads the key columns only; later ones
    read hot keys alone.  Counting is an action, so pass a table rather than a costly
    plan, or name the part of the rows to count that can make a key hot.
    """
    whole = df.withColumn(SLICE, F.lit(""))
    if hot is None:
        return Sliced(whole, order)
    counted = df if counted is None else counted
    total = counted.agg(F.count(F.lit(1)).alias("n")).scalar()
    limit = F.greatest(F.lit(float(hot.min_rows)), total * F.lit(hot.share))
    # Here and below fewer than 1/share rows are collected, see HotKeys.
    per_key = counted.groupBy(*order.keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    hot_keys = per_key.collect()
    if not hot_keys:
        return Sliced(whole, order)

    spark = df.sparkSession
    names = [*order.keys, SLICE]
    listed = F.broadcast(spark.createDataFrame(hot_keys, per_key.schema).drop("n"))
    rows = _with_position(counted, order).select(*order.keys, *_PLACE).join(listed, order.keys, "inner")
    rows = rows.withColumn(SLICE, F.lit(""))
    whole = _with_position(whole, order)
    has_copies = False
    # What is crowded after a cut by its number of rows is bunched, and is cut as finely as can be.
    cuts = F.least(F.lit(hot.cuts), F.ceil(F.col("_n") * 4 / limit))
    while True:
        bounds = [end(name).alias(f"{name}{n}") for name in _PLACE for n, end in enumerate((F.min, F.max))]
        crowded = (
            rows.groupBy(*names)
            .agg(F.count(F.lit(1)).alias("_n"), *bounds)
            .filter(F.col("_n") > limit)
            .withColumn("_cuts", cuts.cast("long"))
        )
        cells = crowded.collect()
        found = [cell for cell in cells if any(cell[f"{name}0"] < cell[f"{name}1"] for name in _PLACE)]
        has_copies = has_copies or len(found) < len(cells)
        if not found:
            break
        cut = F.broadcast(spark.createDataFrame(found, crowded.schema).drop("_n"))
        whole = _cut(whole.join(cut, names, "left"), hot)
        rows = _cut(rows.join(cut, names, "inner"), hot)
        cuts = F.lit(hot.cuts)
    return Sliced(whole.drop(*_PLACE), order, True, has_copies)


def _cut(joined: DataFrame, hot: HotKeys) -> DataFrame:
    """Adds the part to the slice's name where the slice is cut.

    A slice is cut by time, one that is a single instant by sequence, and one of a single
    sequence number by the tie.  Its first and last row fall in different parts, so every
    cut helps.  Rows that were not counted may lie outside its bounds and go to its first
    or last part.
    """
    cuts = F.col("_cuts")

    def distance(value: str, low: str) -> Column:
        # Exact: far numbers that differ by little are not one number.
        return (F.col(value).cast("decimal(20,0)") - F.col(low).cast("decimal(20,0)")).cast("double")

    number = F.lit(0).cast("long")
    for name in reversed(_PLACE):
        low, high = f"{name}0", f"{name}1"
        part = F.floor(distance(name, low) / F.nullif(distance(high, low), F.lit(0.0)) * cuts)
        number = (
            F.when(F.col(low) < F.col(high), part)
            .when(F.col(name) < F.col(low), F.lit(0))
            .when(F.col(name) > F.col(high), cuts - 1)
            .otherwise(number)
        )
    inside = F.greatest(F.lit(0), F.least(number, cuts - 1)).cast("long")
    digits = F.lpad(F.hex(inside), len(f"{hot.cuts - 1:X}"), "0")
    finer = F.when(cuts.isNull(), F.col(SLICE)).otherwise(F.concat(F.col(SLICE), digits))
    return joined.withColumn(SLICE, finer).drop("_cuts", *[f"{name}{n}" for name in _PLACE for n in (0, 1)])


def split_by_key(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a whole key, and rows with a null in it, which match nothing."""
    whole = all_present(keys)
    return df.filter(whole), df.filter(~whole)
