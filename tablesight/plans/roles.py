"""Which columns are dates, numbers and categories; read off the schema, without a job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class SchemaRoles:
    dates: tuple[str, ...]
    numerics: tuple[str, ...]
    categoricals: tuple[str, ...]
    all: tuple[str, ...]


def schema_roles(df: DataFrame) -> SchemaRoles:
    """Roles in column order. Whatever is neither date nor number is a category, booleans included."""
    fields = [f for f in df.schema if not f.name.startswith("_row")]
    dates = tuple(f.name for f in fields if isinstance(f.dataType, _DATES))
    numerics = tuple(f.name for f in fields if isinstance(f.dataType, T.NumericType))
    rest = tuple(f.name for f in fields if f.name not in dates + numerics)
    return SchemaRoles(dates, numerics, rest, tuple(f.name for f in fields))
