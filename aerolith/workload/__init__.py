"""Queries over the driver's tables, each beside the SQL that gives the same result."""

from aerolith.workload import columns, files, history, joins, layers, metrics, quality, reports, stored  # noqa: F401
from aerolith.workload.registry import ORACLES, QUERIES  # noqa: F401
