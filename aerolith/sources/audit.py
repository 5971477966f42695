"""Audit records: how many rows a step read and wrote."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from aerolith.schemas import AUDIT
from aerolith.sources.writers import append_rows, overwrite_parquet


def audit_record(process: str, step: str, dataset: str, before: int | None, after: int,
                 message: str, status: str = "SUCCESS", at: dt.datetime | None = None) -> dict:
    return {
        "log_time": at or dt.datetime.now(dt.timezone.utc),
        "process_name": process,
        "step_name": step,
        "dataset_name": dataset,
        "row_count_before": before,
        "row_count_after": after,
        "message": message,
        "status": status,
    }


def audited_overwrite(source: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str,
                      log_path: str, *, process: str, step: str, dataset: str, message: str,
                      count_before: bool = True, at: dt.datetime | None = None) -> DataFrame:
    """Writes ``transform(source)`` and logs the row counts, all in one pass.

    Both counts are observed on the running write, so nothing is read twice.  The
    transform should work row by row: below a shuffle a repeated stage would count
    its input again.
    """
    before, after = Observation(), Observation()
    seen = source.observe(before, F.count(F.lit(1)).alias("rows")) if count_before else source
    result = transform(seen).observe(after, F.count(F.lit(1)).alias("rows"))
    written = overwrite_parquet(result, path)
    record = audit_record(
        process, step, dataset, before.get["rows"] if count_before else None, after.get["rows"], message, at=at,
    )
    append_rows(source.sparkSession, [record], AUDIT, log_path)
    return written
