"""A seeded sales-like table for trying out charts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed values of the model behind the numbers.
LOG_SPREAD, CATEGORY_STEP, TREND_LOW, TREND_HIGH, NOISE_SHARE = 0.5, 0.1, 0.05, 0.2, 0.1


def synthetic_sales(spark: SparkSession, rows: int = 500, categories: int = 10, years: tuple[int, int] = (2015, 2024),
                    base_value: float = 1000.0, seed: int = 7, partitions: int | None = None,
                    time: str = "Year", category: str = "Category", value: str = "Value") -> DataFrame:
    """``rows`` rows ``(time, category, value)``: a log-normal base that grows by category and by year."""
    first, last = years
    base = F.exp(F.lit(math.log(base_value)) + LOG_SPREAD * F.randn(seed))
    df = spark.range(0, rows, 1, partitions or max(1, rows // 1_000_000)).select(
        (F.lit(first) + F.floor(F.rand(seed + 1) * (last - first + 1))).cast("int").alias(time),
        F.floor(F.rand(seed + 2) * categories).cast("int").alias("_c"),
        base.alias("_base"), F.rand(seed + 3).alias("_u"), F.randn(seed + 4).alias("_n"))
    growth = (F.col(time) - first) * (TREND_LOW + (TREND_HIGH - TREND_LOW) * F.col("_u")) * base_value
    amount = (F.col("_base") * (1 + CATEGORY_STEP * (F.col("_c") + 1)) + growth
              + F.col("_n") * NOISE_SHARE * F.col("_base"))
    return df.select(
        time, F.concat(F.lit("Category "), (F.col("_c") + 1).cast("string")).alias(category),
        F.greatest(F.lit(0.0), F.round(amount, 2)).alias(value))
