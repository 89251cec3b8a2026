"""Reading tables and documents, listing files, and writing results."""

from tablesight.sources.readers import read_any, read_context, read_csv, read_json, read_parquet

__all__ = ["read_any", "read_context", "read_csv", "read_json", "read_parquet"]
