"""What several test modules share; a module of its own, since every folder has its conftest."""

import datetime as dt


def rows(df, *names):
    """Rows as a sorted list of tuples, nulls first."""
    names = names or df.columns
    found = [tuple(row[n] for n in names) for row in df.collect()]
    return sorted(found, key=lambda r: [(v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in r])


def at(minute, second=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute, seconds=second)
