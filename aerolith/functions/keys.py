from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def surrogate_key(*columns: Column | str) -> Column:
    """md5 of the values joined with ``|`` in the given order.

    Null in any part gives a null key: that is why this concatenates and does not
    use concat_ws, which skips nulls and so lets different keys collide.
    """
    parts: list[Column] = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts += [F.lit("|"), text] if parts else [text]
    return F.md5(F.concat(*parts))


def calendar_key(date: Column) -> Column:
    """md5 of the day written as a midnight timestamp with milliseconds."""
    return F.md5(F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit(" 00:00:00.000")))


def auto_number(df: DataFrame, name: str, after: int = 0) -> DataFrame:
    """Unique, increasing, not dense ids above ``after``; needs no shuffle.

    The ids depend on how the rows are partitioned, so write the result before
    using it twice.  ``surrogate_key(key, start)`` is the repeatable choice.
    """
    return df.select((F.monotonically_increasing_id() + F.lit(after + 1)).alias(name), "*")
