"""Column profiles, quality scores and the roles that follow from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tablesight.functions.nulls import col
from tablesight.operators.quantiles import unpivot
from tablesight.operators.typing import decide_types, string_columns, type_shares

SAMPLE_VALUES = 3
# A string column with fewer distinct values than this share of its rows is a category.
CATEGORY_SHARE = 0.5

_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_PLAIN = (T.StringType, T.BooleanType, T.NumericType, *_DATES)


def profiled_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _PLAIN) and not f.name.startswith("_row")]


def type_label(dtype: T.DataType) -> str:
    """temporal, boolean, numerical or text, by declared type."""
    if isinstance(dtype, _DATES):
        return "temporal"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "numerical" if isinstance(dtype, T.NumericType) else "text"


def profile(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """One row per column: ``name, type, sample_values, null_percentage, unique_count, rows``.

    Samples are the smallest distinct values. With ``approx`` the distinct counts come from a sketch, samples are the
    least, the greatest and some other value, and one row per column and task is shuffled.
    """
    columns = profiled_columns(df) if columns is None else list(columns)
    cells = unpivot(df, columns, as_type="string", name="name")
    if approx:
        v = F.col("value")
        picks = F.array(F.min(v), F.max(v), F.min_by(v, F.when(v.isNotNull(), F.xxhash64(v))))
        counts = cells.groupBy("name").agg(
            F.approx_count_distinct(v).alias("unique_count"), F.count_if(v.isNull()).alias("nulls"),
            F.count(F.lit(1)).alias("rows"), F.array_sort(F.array_distinct(F.array_compact(picks))).alias("sample_values"))
    else:
        # One row per distinct value and column, combined on the map side: hot values shuffle once per task.
        distinct = cells.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
        first = W.partitionBy("name").orderBy("value")
        samples = (
            distinct.where(F.col("value").isNotNull()).withColumn("_rank", F.row_number().over(first))
            .where(F.col("_rank") <= SAMPLE_VALUES)
            .groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
        )
        counts = distinct.groupBy("name").agg(
            F.count("value").alias("unique_count"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.sum("n").alias("rows")).join(samples, "name", "left")
    labels = F.create_map(*[F.lit(v) for c in columns for v in (c, type_label(df.schema[c].dataType))])
    label = labels[F.col("name")]
    is_category = F.col("unique_count") < CATEGORY_SHARE * (F.col("rows") - F.col("nulls"))
    return counts.select(
        "name",
        F.when((label == "text") & is_category, "categorical").otherwise(label).alias("type"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        (F.col("nulls") / F.col("rows") * 100).alias("null_percentage"),
        "unique_count", "rows")


def column_roles(profile_rows: DataFrame) -> DataFrame:
    """Adds ``role``: time, measure or dimension. A name with date or time in it makes a time column."""
    lowered = F.lower("name")
    timely = (F.col("type") == "temporal") | F.contains(lowered, F.lit("date")) | F.contains(lowered, F.lit("time"))
    role = F.when(timely, "time").when(F.col("type") == "numerical", "measure").otherwise("dimension")
    return profile_rows.withColumn("role", role)


def characteristics(profile_rows: DataFrame) -> DataFrame:
    """Adds ``characteristic``: id when every row has its own value, else the type label."""
    unique = (F.col("unique_count") == F.col("rows")) & (F.col("null_percentage") == 0)
    candidate = F.col("type").isin("numerical", "text", "categorical")
    return profile_rows.withColumn(
        "characteristic", F.when(unique & candidate, "id").otherwise(F.col("type")))


def shape(df: DataFrame) -> DataFrame:
    """One row ``(columns, rows, column_names)``."""
    names = [c for c in df.columns if not c.startswith("_row")]
    return df.agg(F.lit(len(names)).alias("columns"), F.count(F.lit(1)).alias("rows"),
                  F.first(F.array(*[F.lit(c) for c in names])).alias("column_names"))


def json_keys(records: DataFrame, json: str) -> DataFrame:
    """Distinct top-level keys over all records of a JSON text column, with the number of records."""
    keys = records.select(F.explode(F.json_object_keys(col(json))).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("records"))


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Scalar column: rows that repeat an earlier row."""
    columns = profiled_columns(df) if columns is None else list(columns)
    # Grouped by all columns, combined per task first: copies of one row cost one row per task.
    groups = df.groupBy(*[col(c) for c in columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).scalar()


def quality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: ``rows, columns, missing, duplicates, completeness, consistency, score``.

    Completeness is the share of cells that are known; consistency the share of known cells that read as
    their column's winning type (a typed column always does).
    """
    columns = profiled_columns(df) if columns is None else list(columns)
    texts = [c for c in string_columns(df) if c in columns]
    base = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(col(c)).alias(f"_known_{i}") for i, c in enumerate(columns)])
    known = sum((F.col(f"_known_{i}") for i in range(len(columns))), F.lit(0))
    if texts:
        shares = type_shares(df, texts)
        kinds = decide_types(shares).select("name", "type")
        odd = shares.join(kinds, "name").agg(F.sum(
            F.when(F.col("type").isin("bigint", "double"), F.col("known") - F.col("number"))
            .when(F.col("type") == "timestamp", F.col("known") - F.array_max("dates"))
            .otherwise(0))).scalar()
    else:
        odd = F.lit(0)
    cells = F.col("rows") * len(columns)
    return base.select(
        "rows", F.lit(len(columns)).alias("columns"), (cells - known).alias("missing"),
        duplicate_rows(df, columns).alias("duplicates"),
        F.try_divide(known, cells).alias("completeness"),
        F.try_divide(known - odd, known).alias("consistency"),
    ).withColumn("score", (F.col("completeness") + F.col("consistency")
                           + F.coalesce(1 - F.try_divide("duplicates", "rows"), F.lit(1.0))) / 3)


def issues_by_column(df: DataFrame, columns: Sequence[str] | None = None, high_null_percentage: float = 20.0) -> DataFrame:
    """File profile: per column its declared type, nulls, distinct values and the issues they suggest."""
    rows = profile(df, columns)
    checks = F.array(
        F.when(F.col("null_percentage") == 100, "empty").when(
            F.col("null_percentage") > high_null_percentage, "many missing values").when(
            F.col("null_percentage") > 0, "missing values"),
        F.when(F.col("unique_count") == 1, "constant"),
        F.when((F.col("unique_count") == F.col("rows")) & (F.col("null_percentage") == 0), "key"))
    return rows.select(
        "name", "type", F.round(F.col("null_percentage") * F.col("rows") / 100).cast("bigint").alias("null_count"),
        "unique_count", F.array_compact(checks).alias("issues"))


def analysis_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row that hands a table over to analysis: quality figures and the columns of each role."""
    roles = column_roles(profile(df, columns))
    named = roles.agg(*[
        F.array_sort(F.collect_list(F.when(F.col("role") == r, F.col("name")))).alias(n)
        for r, n in (("measure", "measures"), ("dimension", "dimensions"), ("time", "time_columns"))])
    # Both sides have one row; the lists come along as values.
    lists = named.select(F.struct("measures", "dimensions", "time_columns")).scalar()
    return quality(df, columns).withColumn("_roles", lists).select(
        "rows", "columns", "completeness", "consistency", "score", "_roles.measures", "_roles.dimensions", "_roles.time_columns")
