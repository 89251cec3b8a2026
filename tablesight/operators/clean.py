"""Cleaning: duplicates, gaps, formats, outliers and rules, with a report of what changed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablesight.functions.nulls import col, try_double
from tablesight.functions.storage import store
from tablesight.operators.profile import duplicate_rows, profiled_columns
from tablesight.operators.quantiles import modes, quantile_row
from tablesight.operators.typing import infer_types, string_columns

STRATEGIES = ("conservative", "standard", "aggressive")
IQR_FACTOR = 1.5


def drop_missing(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in which every key column is known."""
    for k in keys:
        df = df.where(col(k).isNotNull())
    return df


def numbers_only(df: DataFrame, measure: str) -> DataFrame:
    """The measure as a number; rows without one are dropped."""
    return df.withColumn(measure, try_double(col(measure))).where(col(measure).isNotNull())


def fill_unknown(df: DataFrame, columns: Sequence[str], label: str = "Unknown") -> DataFrame:
    return df.withColumns({c: F.coalesce(col(c).cast("string"), F.lit(label)) for c in columns})


def drop_duplicates(df: DataFrame, keys: Sequence[str] | None = None, order: str | None = None) -> DataFrame:
    """One row per key: the first in ``order``, or any when rows are equal in every column.

    It is an aggregate, not a window: each task keeps one row per key before the shuffle, so a row with
    very many copies is no hot spot.
    """
    columns = [c for c in df.columns if c != order]
    keys = list(keys) if keys else columns
    if order is None:
        return df.dropDuplicates(keys)
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*[col(c) for c in rest]), col(order)).alias("_first")
    return df.groupBy(*[col(k) for k in keys]).agg(first).select(
        *[col(c) if c in keys else F.col("_first").getField(c).alias(c) for c in df.columns])


def _numeric(df: DataFrame) -> list[str]:
    return [c for c in profiled_columns(df) if isinstance(df.schema[c].dataType, T.NumericType)]


def _categorical(df: DataFrame) -> list[str]:
    return [c for c in profiled_columns(df) if isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType))]


def fill_values(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Rows ``(column, value)``: the median of numbers and the mode of categories, as text."""
    parts = []
    if numeric:
        medians = quantile_row(df, numeric, [0.5])
        parts.append(medians.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), col(c)[0].cast("string").alias("value")) for c in numeric]))))
    if categorical:
        parts.append(modes(df, categorical).select("column", "value"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def impute(df: DataFrame, numeric: Sequence[str] | None = None, categorical: Sequence[str] | None = None) -> DataFrame:
    """Fill gaps: numbers with the column's median, categories with its most frequent value. Types stay."""
    numeric = _numeric(df) if numeric is None else list(numeric)
    categorical = _categorical(df) if categorical is None else list(categorical)
    if not numeric and not categorical:
        return df
    # Medians and modes come as one value each, attached once per row and dropped again.
    found, out = {}, {}
    if numeric:
        found["_middle"] = quantile_row(df, numeric, [0.5]).agg(
            F.first(F.struct(*[col(c)[0].alias(f"m{i}") for i, c in enumerate(numeric)]))).scalar()
        out |= {c: F.coalesce(col(c), _as_type(F.col("_middle")[f"m{i}"], df.schema[c].dataType))
                for i, c in enumerate(numeric)}
    if categorical:
        found["_usual"] = modes(df, categorical).agg(
            F.map_from_entries(F.collect_list(F.struct("column", "value")))).scalar()
        out |= {c: F.coalesce(col(c), F.col("_usual")[F.lit(c)].cast(df.schema[c].dataType)) for c in categorical}
    return df.withColumns(found).withColumns(out).drop(*found)


def _as_type(value: Column, dtype: T.DataType) -> Column:
    """A number in the column's own type; whole-number columns take the rounded value."""
    return (F.round(value) if isinstance(dtype, T.IntegralType) else value).cast(dtype)


def standardise(df: DataFrame, columns: Sequence[str] | None = None, case: str | None = None,
                types: bool = False) -> DataFrame:
    """Trim and collapse blanks in text; optionally fold case and read dates and numbers."""
    columns = string_columns(df) if columns is None else list(columns)
    out = {}
    for c in columns:
        text = F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))
        out[c] = {"lower": F.lower, "upper": F.upper, "title": F.initcap}.get(case, lambda t: t)(text)
    df = df.withColumns(out) if out else df
    return infer_types(df) if types else df


def fences(df: DataFrame, columns: Sequence[str], factor: float = IQR_FACTOR) -> Column:
    """Scalar struct of structs ``c{i}(q1, q3, low, high)``: the interquartile fences of each column."""
    quartiles = quantile_row(df, columns, [0.25, 0.75])
    return quartiles.agg(F.first(F.struct(*[
        F.struct(
            col(c)[0].alias("q1"), col(c)[1].alias("q3"),
            (col(c)[0] - factor * (col(c)[1] - col(c)[0])).alias("low"),
            (col(c)[1] + factor * (col(c)[1] - col(c)[0])).alias("high")).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]))).scalar()


def flag_outliers(df: DataFrame, columns: Sequence[str], factor: float = IQR_FACTOR,
                  suffix: str = "_outlier") -> DataFrame:
    """A boolean column per measure: outside its interquartile fences."""
    f = F.col("_fences")
    return df.withColumn("_fences", fences(df, columns, factor)).withColumns({
        f"{c}{suffix}": F.coalesce(~col(c).between(f[f"c{i}"]["low"], f[f"c{i}"]["high"]), F.lit(False))
        for i, c in enumerate(columns)
    }).drop("_fences")


def count_violations(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Rows ``(rule, violations, percentage)`` for SQL predicates that every row should fulfil."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.count_if(~F.coalesce(F.expr(text), F.lit(False))).alias(f"r{i}")
        for i, text in enumerate(rules.values())
    ])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations"),
                 F.coalesce(F.try_divide(F.col(f"r{i}") * 100.0, F.col("_rows")), F.lit(0.0)).alias("percentage"))
        for i, name in enumerate(rules)
    ])))


def severity(percentage: Column) -> Column:
    return F.when(percentage > 20, "high").when(percentage > 5, "medium").otherwise("low")


def issues(df: DataFrame, rules: Mapping[str, str] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows ``(type, column, severity, affected_rows, percentage, action)`` for everything found wrong."""
    columns = profiled_columns(df) if columns is None else list(columns)
    numbers = [c for c in _numeric(df) if c in columns]
    counts = [F.count(F.lit(1)).alias("_rows")]
    entries = [("duplicate_rows", None, duplicate_rows(df, columns), "remove repeated rows")]
    for i, c in enumerate(columns):
        counts.append(F.count_if(col(c).isNull()).alias(f"_null_{i}"))
        fill = "median" if c in numbers else "most frequent value"
        entries.append(("missing_values", c, F.col(f"_null_{i}"), f"fill with {fill}"))
    if numbers:
        out = F.col("_fences")
        df = df.withColumn("_fences", fences(df, numbers))
        for i, c in enumerate(numbers):
            counts.append(F.count_if(~col(c).between(out[f"c{i}"]["low"], out[f"c{i}"]["high"])).alias(f"_out_{i}"))
            entries.append(("outliers", c, F.col(f"_out_{i}"), "review or remove"))
    for i, (name, text) in enumerate((rules or {}).items()):
        counts.append(F.count_if(~F.coalesce(F.expr(text), F.lit(False))).alias(f"_rule_{i}"))
        entries.append(("invalid_values", name, F.col(f"_rule_{i}"), "remove or correct"))
    table = df.agg(*counts).select("_rows", F.inline(F.array(*[
        F.struct(F.lit(kind).alias("type"), F.lit(c).cast("string").alias("column"),
                 n.cast("bigint").alias("affected_rows"), F.lit(action).alias("action"))
        for kind, c, n, action in entries
    ])))
    percentage = F.coalesce(F.try_divide(F.col("affected_rows") * 100.0, F.col("_rows")), F.lit(0.0))
    return table.where(F.col("affected_rows") > 0).select(
        "type", "column", severity(percentage).alias("severity"), "affected_rows",
        percentage.alias("percentage"), "action")


def clean(df: DataFrame, strategy: str = "standard", rules: Mapping[str, str] | None = None) -> DataFrame:
    """Clean a table.

    ``conservative`` only adds flags; ``standard`` tidies text, removes repeated rows and fills gaps;
    ``aggressive`` also drops outliers and rows that break a rule.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    numbers = _numeric(df)
    if strategy == "conservative":
        columns = profiled_columns(df)
        df = df.withColumn("_missing", sum((F.when(col(c).isNull(), 1).otherwise(0) for c in columns), F.lit(0)))
        df = flag_outliers(df, numbers) if numbers else df
        return df.withColumn("_valid", _fulfils(rules))
    df = drop_duplicates(standardise(df))
    if strategy == "aggressive":
        # Fences and fill values each read the rows again; they read the stored, already reduced ones.
        df = store(df.where(_fulfils(rules)))
        if numbers:
            f, inside = F.col("_fences"), F.lit(True)
            for i, c in enumerate(numbers):
                inside = inside & (col(c).isNull() | col(c).between(f[f"c{i}"]["low"], f[f"c{i}"]["high"]))
            df = store(df.withColumn("_fences", fences(df, numbers)).where(inside).drop("_fences"))
    return impute(df)


def _fulfils(rules: Mapping[str, str] | None) -> Column:
    test = F.lit(True)
    for text in (rules or {}).values():
        test = test & F.coalesce(F.expr(text), F.lit(False))
    return test


def lineage(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row ``(records_before, records_after, records_removed, data_loss_percentage)``."""
    counted = before.agg(F.count(F.lit(1)).alias("records_before"))
    kept = after.agg(F.count(F.lit(1))).scalar()
    removed = F.col("records_before") - F.col("records_after")
    return counted.withColumn("records_after", kept).select(
        "records_before", "records_after", removed.alias("records_removed"),
        F.coalesce(F.try_divide(removed * 100.0, F.col("records_before")), F.lit(0.0)).alias("data_loss_percentage"))
