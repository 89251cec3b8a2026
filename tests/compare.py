"""Comparison of a Spark result with the rows of its SQL."""

from __future__ import annotations

import datetime as dt
import decimal
import math

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def plain(value):
    """A value in a form that compares and sorts alike for both engines."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, (int, float)) or hasattr(value, "item"):
        value = float(value)
        return None if math.isnan(value) else value
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def difference(spark_df, relation):
    """None when both have the same columns and rows, else a description."""
    a_names, b_names = sorted(spark_df.columns), sorted(relation.columns)
    if a_names != b_names:
        return f"columns {a_names} != {b_names}"
    a = rows_of(spark_df.columns, spark_df.collect())
    b = rows_of(relation.columns, relation.fetchall())
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ, first: {str(wrong[0][0])[:400]} != {str(wrong[0][1])[:400]}"
    return None


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con
