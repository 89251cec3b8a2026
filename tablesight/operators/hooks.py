"""User code around the operators: stage chains, variants tried in order, SQL text, scalar functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tablesight.functions.expressions import REGISTERED

Stage = Callable[[DataFrame], DataFrame]


def chain(df: DataFrame, *stages: Stage | None) -> DataFrame:
    """Apply stages one after the other; None is skipped."""
    for stage in stages:
        if stage is not None:
            df = df.transform(stage)
    return df


@dataclass
class Attempt:
    """The variant that worked, its result, and what went wrong before."""

    variant: str
    result: DataFrame
    errors: list[str] = field(default_factory=list)


def first_success(df: DataFrame, variants: Mapping[str, Stage]) -> Attempt:
    """Try variants in the order of their names; one succeeds when its plan is valid and yields a row set."""
    errors: list[str] = []
    for name in sorted(variants):
        try:
            result = variants[name](df)
            result.limit(1).collect()
            return Attempt(name, result, errors)
        except Exception as err:  # noqa: BLE001 - any failure moves on to the next variant
            errors.append(f"{name}: {err}")
    raise RuntimeError("all variants failed: " + "; ".join(errors))


def run_sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Run SQL text over named tables."""
    return spark.sql(text, **tables) if all(f"{{{n}}}" in text for n in tables) else _with_views(spark, text, tables)


def _with_views(spark, text, tables):
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return spark.sql(text)


def register_function(spark: SparkSession, name: str, function, return_type=None) -> None:
    """Make a scalar function callable in compute and filter expressions. Prefer pandas functions."""
    spark.udf.register(name, function, return_type)
    REGISTERED.add(name)
