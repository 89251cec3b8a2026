"""Null handling shared by every reader and operator.

Readers map NaN and the usual "missing" spellings to NULL once, so that group keys and aggregates never
see two kinds of missing value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Strings that tabular readers treat as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating point column."""
    return df.select(*[
        F.when(~F.isnan(F.col(quote(f.name))), F.col(quote(f.name))).alias(f.name)
        if is_float(f.dataType) else F.col(quote(f.name))
        for f in df.schema
    ])


def na_tokens_to_null(df: DataFrame, tokens=NA_TOKENS) -> DataFrame:
    """Replace the missing-value spellings by NULL in every string column."""
    return df.select(*[
        F.when(~F.col(quote(f.name)).isin(*tokens), F.col(quote(f.name))).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(quote(f.name))
        for f in df.schema
    ])


def quote(name: str) -> str:
    """Quote a column name so that dots and spaces in it are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def sum_or_zero(value: Column) -> Column:
    """Sum in which a group without any value totals 0."""
    return F.coalesce(F.sum(value), F.lit(0))


def try_double(value: Column) -> Column:
    """Number in a value of any type, NULL when it is not one."""
    return F.when(~F.isnan(value.try_cast("double")), value.try_cast("double"))


def join_on(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Equi join on equally named keys in which NULL matches NULL; the left side's keys are kept."""
    renamed = {k: f"_join{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(renamed)
    condition = F.lit(True)
    for k, r in renamed.items():
        condition = condition & col(k).eqNullSafe(F.col(r))
    return left.join(right, condition, how).drop(*renamed.values())
