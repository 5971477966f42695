from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """Date of three numbers; null for a day that does not exist (make_date raises)."""
    text = F.when(
        year.isNotNull() & month.isNotNull() & day.isNotNull(),
        F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month.cast("string"), day.cast("string")),
    )
    return text.try_cast("date")


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")


def quarter_start(date: Column) -> Column:
    return F.trunc(date, "quarter")


def quarter_name(date: Column) -> Column:
    """``Q1`` .. ``Q4``."""
    return F.concat(F.lit("Q"), F.quarter(date).cast("string"))


def year_quarter_name(date: Column) -> Column:
    """``2015-Q1``."""
    return F.concat(F.year(date).cast("string"), F.lit("-"), quarter_name(date))


def rough_quarter_date(date: Column) -> Column:
    """First of January plus 90 days per full quarter: an approximation some models store."""
    return F.date_add(F.trunc(date, "year"), (F.quarter(date) - 1) * 90)


def day_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def later_by_micros(ts: Column, micros: Column) -> Column:
    """Adds a sequence number as microseconds, which makes equal stamps distinct."""
    return F.timestamp_add("MICROSECOND", micros, ts)


def micros(ts: Column, data_type: str) -> Column:
    """Microseconds since 1970 as an exact number, without a time-zone detour for NTZ."""
    if data_type == "timestamp_ntz":
        day = F.unix_date(F.to_date(ts)).cast("long")
        second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
        minutes = (day * 24 + F.hour(ts)) * 60 + F.minute(ts)
        return minutes * 60_000_000 + second
    if data_type == "date":
        return F.unix_date(ts).cast("long") * 86_400_000_000
    return F.unix_micros(ts)
