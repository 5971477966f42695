"""Declarative column tests, rejected rows, reconciliation and outliers."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.sources.writers import settle

RESULT = ["table_name", "check_name", "columns", "failures", "status"]


@dataclass(frozen=True)
class Check:
    """One test on a table.

    ``bad`` is a row test that is true for a failing row.  ``unique`` and ``parent``
    tests compare rows with each other or with a parent table instead.
    """

    name: str
    columns: list[str]
    bad: Column | None = None
    parent: DataFrame | None = None
    parent_columns: list[str] = field(default_factory=list)


def not_null(*columns: str) -> list[Check]:
    return [Check("not_null", [c], F.col(c).isNull()) for c in columns]


def accepted_values(column: str, values: list) -> Check:
    """Values outside the list fail; null passes."""
    return Check("accepted_values", [column], ~F.col(column).isin(values))


def in_range(column: str, low, high) -> Check:
    """Values outside low..high fail; null passes."""
    return Check("range", [column], ~F.col(column).between(low, high))


def in_order(first: str, second: str) -> Check:
    """Rows where the second time is before the first fail."""
    return Check("time_order", [first, second], F.col(second) < F.col(first))


def expression(name: str, columns: list[str], holds: Column) -> Check:
    """Rows for which the expression is false fail; null passes."""
    return Check(name, columns, ~holds)


def unique(*columns: str) -> Check:
    """Failures are the value combinations that repeat; a null in one exempts it."""
    return Check("unique", list(columns))


def relationship(columns: list[str], parent: DataFrame, parent_columns: list[str]) -> Check:
    """Failures are rows whose key, if it has no null, is absent from the parent."""
    return Check("relationship", columns, parent=parent, parent_columns=parent_columns)


def repeated(df: DataFrame, columns: list[str]) -> DataFrame:
    """Value combinations that occur more than once, with their number.

    Counting is combined before the shuffle, so one value that fills a third of the
    table reaches its reducer as one row per task.
    """
    present = df.select(*columns).na.drop(how="any")
    return present.groupBy(*columns).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def orphans(df: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Key values without a parent and the number of their rows.

    Keys are counted first, so the anti join sees each key once however hot it is.
    """
    keys = df.select(*columns).na.drop(how="any").groupBy(*columns).agg(F.count(F.lit(1)).alias("occurrences"))
    known = parent.select(*[F.col(p).alias(c) for c, p in zip(columns, parent_columns, strict=True)])
    return keys.join(known, columns, "left_anti")


def run_checks(df: DataFrame, table: str, checks: list[Check]) -> DataFrame:
    """One row per test: failures and PASS or FAIL.

    All row tests share one scan and one aggregate; unique and parent tests need a
    shuffle on their own key each.
    """
    row_checks = [check for check in checks if check.bad is not None]
    parts = []
    if row_checks:
        counted = df.agg(*[F.count_if(check.bad).alias(f"_{i}") for i, check in enumerate(row_checks)])
        entries = [
            F.struct(
                F.lit(check.name).alias("check_name"),
                F.lit(", ".join(check.columns)).alias("columns"),
                F.col(f"_{i}").alias("failures"),
            )
            for i, check in enumerate(row_checks)
        ]
        parts.append(counted.select(F.inline(F.array(*entries))))
    for check in checks:
        if check.bad is not None:
            continue
        if check.parent is None:
            failing = repeated(df, check.columns).agg(F.count(F.lit(1)).alias("failures"))
        else:
            failing = orphans(df, check.columns, check.parent, check.parent_columns).agg(
                F.coalesce(F.sum("occurrences"), F.lit(0)).alias("failures")
            )
        parts.append(failing.select(
            F.lit(check.name).alias("check_name"), F.lit(", ".join(check.columns)).alias("columns"), "failures"
        ))
    return reduce(DataFrame.unionByName, parts).select(
        F.lit(table).alias("table_name"), "check_name", "columns", "failures",
        F.when(F.col("failures") == 0, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
    )


def split_rejects(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every rule, and the others with the names of the rules they break.

    A rule that is null counts as broken, so kept and rejected rows always add up to
    the input.
    """
    broken = F.concat_ws(", ", *[
        F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()
    ])
    marked = df.withColumn("reject_reason", broken)
    return marked.filter("reject_reason = ''").drop("reject_reason"), marked.filter("reject_reason <> ''")


def reconcile(source: DataFrame, target: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Row counts of two tables, per group of equal ``by`` columns, and whether they agree."""
    by = by or []
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = source.select(*by, one.alias("s"), none.alias("t")).unionByName(
        target.select(*by, none.alias("s"), one.alias("t"))
    )
    counts = both.groupBy(*by).agg(
        F.coalesce(F.sum("s"), none).alias("source_rows"), F.coalesce(F.sum("t"), none).alias("target_rows")
    )
    difference = F.col("source_rows") - F.col("target_rows")
    return counts.select(
        *by, "source_rows", "target_rows", difference.alias("difference"),
        F.when(difference == 0, F.lit("MATCH")).otherwise(F.lit("MISMATCH")).alias("status"),
    )


def flag_outliers(df: DataFrame, value: str, by: list[str], deviations: float) -> DataFrame:
    """Adds the distance from the group mean in standard deviations and a 0/1 flag.

    Mean and deviation are merged from parts without a difference of large sums, so values far
    from zero keep their spread; the last digits may depend on row order.  The group figures are
    written before they are joined back: few groups are broadcast, so a hot group
    is never shuffled.  Rows with a null group or value get null and 0, as do groups without spread.
    """
    x = F.col(value).cast("double")
    stats = settle(df.groupBy(*by).agg(
        F.avg(x).alias("_mean"), F.nullif(F.stddev_samp(x), F.lit(0.0)).alias("_deviation")), "group-figures")
    distance = (x - F.col("_mean")) / F.col("_deviation")
    return (
        df.join(stats, by, "left")
        .withColumn("z_score", distance)
        .withColumn("is_outlier", F.when(F.abs(F.col("z_score")) > deviations, F.lit(1)).otherwise(F.lit(0)))
        .select(*df.columns, "z_score", "is_outlier")
    )
