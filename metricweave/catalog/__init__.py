"""Every operator as a query over the benchmark tables, with its SQL counterpart."""

from metricweave.catalog import alerts, batches, files, joins, models, rows, scans  # noqa: F401  (registers)
from metricweave.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
