"""Every operator as a query over the given tables, most with the SQL that yields the same rows."""

from tablesight.workload import charts, files, labels, monitor, stats, tables, text, vectors  # noqa: F401
from tablesight.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
