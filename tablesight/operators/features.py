"""Derived columns: date parts, encodings, scaling, normalised text, and a catalog of what was added."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablesight.functions.nulls import col, join_on
from tablesight.functions.storage import with_global_rank
from tablesight.operators.stages import add_computed
from tablesight.plans.roles import schema_roles

_PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "quarter": F.quarter, "day_of_week": F.weekday,
}


def date_parts(df: DataFrame, columns: Sequence[str] | None = None,
               parts: Sequence[str] = ("year", "month", "day")) -> DataFrame:
    """``{column}_{part}`` for every date column; a column that exists already is kept. Monday is day 0."""
    columns = schema_roles(df).dates if columns is None else columns
    new = {
        f"{c}_{p}": _PARTS[p](col(c)) for c in columns for p in parts if f"{c}_{p}" not in df.columns
    }
    return df.withColumns(new) if new else df


def normalise_text(text: Column) -> Column:
    """Lower case, single blanks, no blanks at the ends."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Rows ``(label, code)``: labels in alphabetical order, numbered from 0."""
    labels = df.where(col(column).isNotNull()).select(col(column).alias("label")).distinct()
    return with_global_rank(labels, [F.col("label")], "code")


def label_encode(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Add the label's code; a missing label gets the code after the last one."""
    codes = label_codes(df, column)
    after = codes.agg(F.coalesce(F.max("code") + 1, F.lit(0))).scalar()
    name = name or f"{column}_code"
    encoded = join_on(df, codes.select(F.col("label").alias(column), F.col("code").alias(name)), [column])
    return encoded.withColumn(name, F.coalesce(col(name), after))


def z_scores(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Distance from the mean in population standard deviations; NULL for a constant column."""
    stats = df.agg(F.struct(
        *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(col(c)).alias(f"s{i}") for i, c in enumerate(columns)])).scalar()
    s = F.col("_stats")
    return df.withColumn("_stats", stats).withColumns({
        f"{c}{suffix}": F.try_divide(col(c) - s[f"m{i}"], s[f"s{i}"]) for i, c in enumerate(columns)
    }).drop("_stats")


def derive(df: DataFrame, metrics: Mapping[str, str], params=None) -> DataFrame:
    """Derived metrics as expressions over the columns, one after the other."""
    return add_computed(df, metrics, params)


def feature_catalog(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows ``(feature, type, source, method, known, missing)`` for the columns that ``after`` has beyond ``before``.

    One aggregate over ``after`` counts the values of all features.
    """
    rows = []
    for f in after.schema:
        if f.name in before.columns:
            continue
        source = max((c for c in before.columns if f.name.startswith(f"{c}_")), key=len, default=None)
        method = f.name[len(source) + 1:] if source else "expression"
        rows.append(F.struct(
            F.lit(f.name).alias("feature"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(source).cast("string").alias("source"),
            F.lit(method).alias("method"), F.count(col(f.name)).alias("known"), F.count_if(col(f.name).isNull()).alias("missing")))
    if not rows:
        return after.sparkSession.createDataFrame([], "feature string, type string, source string, method string, known long, missing long")
    return after.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))
