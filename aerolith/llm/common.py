"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructType

#: A word: a run of characters other than the six ASCII white-space characters (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def pack(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole input row as one struct ``row``, beside columns computed from the input.

    Names an operator works with can then not clash with columns of its input.
    """
    whole = F.struct(*[F.col(quoted(name)) for name in df.columns]).alias("row")
    return df.select(whole, *[column.alias(name) for name, column in columns.items()])


def unpack(df: DataFrame, **columns: Column) -> DataFrame:
    """The input's columns again, and ``columns``; an input column of the same name gives way."""
    new = {name.lower() for name in columns}
    kept = [name for name in df.schema["row"].dataType.names if name.lower() not in new]
    return df.select(
        *[F.col("row").getField(name).alias(name) for name in kept],
        *[column.alias(name) for name, column in columns.items()],
    )


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session now hands texts to Python in batches of at most 8 MB.

    A worker holds a batch several times over (Arrow, Python strings, results), so this bounds
    its memory however long the texts are.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fields(**columns: DataType) -> StructType:
    """A struct type; unlike a DDL string it can be written before a session exists."""
    out = StructType()
    for name, given in columns.items():
        out = out.add(name, given)
    return out


def longs(*names: str) -> StructType:
    return fields(**{name: LongType() for name in names})
