"""Types from content: string columns become booleans, numbers or timestamps when enough values parse."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablesight.functions.nulls import col
from tablesight.operators.quantiles import unpivot

# A column becomes numeric when more than this share of all rows parses.
NUMERIC_THRESHOLD = 0.8
# A column becomes a timestamp when more than this share of all rows parses.
DATE_THRESHOLD = 0.7

_NUMBER = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf(?:inity)?))$"
_INTEGER = r"^[+-]?\d+$"
_BOOLEANS = ("True", "TRUE", "true", "False", "FALSE", "false")

# Accepted date spellings; on equal shares the earlier one wins.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm",
    "yyyy/M/d", "yyyy/M/d HH:mm:ss", "M/d/yyyy", "M/d/yyyy HH:mm:ss", "M/d/yyyy HH:mm", "d/M/yyyy",
    "d/M/yyyy HH:mm:ss", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "d-MMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy",
    "yyyy-MM",
)


@dataclass(frozen=True)
class ColumnType:
    """What was found out about one string column."""

    name: str
    type: str
    share: float
    format: str | None = None


def parse_number(text: Column) -> Column:
    """Double in a string, NULL when it is not written as a plain number."""
    trimmed = F.trim(text)
    return F.when(F.rlike(trimmed, F.lit(_NUMBER)), trimmed.try_cast("double"))


def parse_date(text: Column, fmt: str) -> Column:
    """Timestamp in a string. Only text of the format's shape is parsed: failing on the rest is dear."""
    trimmed = F.trim(text)
    return F.when(shape(trimmed).isin(*format_shapes(fmt)), _read(trimmed, fmt))


def _read(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


# What each letter group of a format looks like when digits are written 9 and letters a.
_SHAPES = {
    "[.SSSSSS]": ["", *("." + "9" * n for n in range(1, 7))], "'T'": ["a"], "yyyy": ["9999"],
    "MMMM": ["a" * n for n in range(3, 10)], "MMM": ["aaa"], "MM": ["99"], "M": ["9", "99"], "dd": ["99"],
    "d": ["9", "99"], "HH": ["99"], "mm": ["99"], "ss": ["99"],
}
_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LONGEST_DATE = 32


def format_shapes(fmt: str) -> list[str]:
    """Every shape of text that a date format can read."""
    parts = re.split("(" + "|".join(re.escape(k) for k in _SHAPES) + ")", fmt)
    return ["".join(p) for p in itertools.product(*[_SHAPES.get(p, [p]) for p in parts])]


def shape(text: Column) -> Column:
    """Text with digits as 9 and letters as a; NULL for text too long to be a date."""
    outline = F.translate(text, _DIGITS + _LETTERS, "9" * len(_DIGITS) + "a" * len(_LETTERS))
    return F.when(F.length(text) <= _LONGEST_DATE, outline)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def type_shares(df: DataFrame, columns: Sequence[str] | None = None, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """One row per string column: rows, non-null, and how many values parse as each type.

    Cells are unpivoted first, so one small aggregate counts all columns and formats, however wide the table.
    """
    columns = string_columns(df) if columns is None else list(columns)
    cells = unpivot(df, columns, as_type="string", name="name", value="text") if columns else (
        df.sparkSession.createDataFrame([], "name string, text string"))
    text = F.trim("text")
    cells = cells.select("name", text.alias("text"), shape(text).alias("shape"))
    whole = F.rlike("text", F.lit(_INTEGER))
    dates = [F.when(F.col("shape").isin(*format_shapes(f)), _read(F.col("text"), f)) for f in formats]
    counted = cells.groupBy("name").agg(
        F.count(F.lit(1)).alias("rows"), F.count("text").alias("known"),
        F.count(parse_number(F.col("text"))).alias("number"),
        F.count_if(whole & F.col("text").try_cast("bigint").isNotNull()).alias("integer"),
        F.count_if(whole & F.col("text").try_cast("decimal(38,0)").isNotNull()).alias("whole"),
        F.count_if(F.col("text").isin(*_BOOLEANS)).alias("boolean"),
        *[F.count(d).alias(f"_d{i}") for i, d in enumerate(dates)])
    return counted.select("name", "rows", "known", "number", "integer", "whole", "boolean",
                          F.array(*[F.col(f"_d{i}") for i in range(len(formats))]).alias("dates"))


def decide_types(shares: DataFrame, numeric_threshold: float = NUMERIC_THRESHOLD,
                 date_threshold: float = DATE_THRESHOLD, formats: Sequence[str] = DATE_FORMATS,
                 date_columns: Sequence[str] = ()) -> DataFrame:
    """Rows ``(name, type, share, format)`` from the counts of ``type_shares``.

    ``date_columns`` are read as dates whatever their share.
    """
    rows = F.greatest(F.col("rows"), F.lit(1))
    best = F.array_max("dates")
    names = F.array(*[F.lit(f) for f in formats])
    all_known = F.col("known") > 0
    number_share = F.col("number") / rows
    date_share = best / rows
    is_bool = all_known & (F.col("boolean") == F.col("rows"))
    is_number = (number_share > numeric_threshold) | (F.col("number") == F.col("known"))
    is_date = (date_share > date_threshold) | F.col("name").isin(list(date_columns))
    kind = (
        F.when(is_bool, "boolean")
        .when(F.col("name").isin(list(date_columns)), "timestamp")
        .when(is_number & all_known & (F.col("integer") == F.col("number")), "bigint")
        # Identifiers beyond 64 bits keep all their digits.
        .when(is_number & all_known & (F.col("whole") == F.col("number")), "decimal(38,0)")
        .when(is_number, "double")
        .when(is_date, "timestamp")
        .otherwise("string")
    )
    share = (
        F.when(kind == "boolean", F.col("boolean") / rows)
        .when(kind.isin("bigint", "decimal(38,0)", "double"), number_share)
        .when(kind == "timestamp", date_share)
        .otherwise(F.col("known") / rows)
    )
    fmt = F.when(kind == "timestamp", F.element_at(names, F.array_position("dates", best).cast("int")))
    return shares.select("name", kind.alias("type"), share.alias("share"), fmt.alias("format"))


def detect_types(df: DataFrame, columns: Sequence[str] | None = None, **options) -> list[ColumnType]:
    """Run the detection job; the result has one entry per string column."""
    columns = string_columns(df) if columns is None else list(columns)
    if not columns:
        return []
    formats = options.get("formats", DATE_FORMATS)
    found = decide_types(type_shares(df, columns, formats), **options).collect()
    return [ColumnType(r["name"], r["type"], r["share"], r["format"]) for r in found]


def apply_types(df: DataFrame, types: Sequence[ColumnType]) -> DataFrame:
    """Cast string columns as detected; values that do not parse become NULL."""
    by_name = {t.name: t for t in types}
    out = []
    for f in df.schema:
        t, c = by_name.get(f.name), col(f.name)
        if t is None or t.type == "string":
            out.append(c)
        elif t.type == "timestamp":
            out.append(parse_date(c, t.format).alias(f.name))
        elif t.type == "double":
            out.append(parse_number(c).alias(f.name))
        else:
            out.append(F.trim(c).try_cast(t.type).alias(f.name))
    return df.select(*out)


def infer_types(df: DataFrame, **options) -> DataFrame:
    """Detect and apply in one call. Only string columns are looked at."""
    return apply_types(df, detect_types(df, **options))
