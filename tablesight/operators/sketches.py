"""Profiles of growing tables: sketches per part that merge, so that only new parts are read.

A part, usually a file, is summed up once by counts, bounds, a HyperLogLog sketch of its values and, for numbers, a KLL sketch of their
order. Sketches are appended to a table; the profile of all parts is the merge of its rows. Distinct counts of many values are within a few percent
(``DISTINCT_ERROR``), ranks of quantiles within ``RANK_ERROR``; all else is exact. ``profile`` remains the exact way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablesight.functions.nulls import col

# Three standard errors of a HyperLogLog sketch of 2 ** 12 places; twice the usual rank error of a KLL sketch of size 200.
PLACES, DISTINCT_ERROR = 12, 0.05
KLL_SIZE, RANK_ERROR = 200, 0.03
QUANTILES = (0.25, 0.5, 0.75)

SKETCHES = ("part string, name string, rows long, nulls long, least string, greatest string, least_number double, greatest_number double, "
            "distinct_sketch binary, order_sketch binary")


def sketch(df: DataFrame, part: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per part and column. Every task keeps one sketch of each, so that is all that is shuffled."""
    columns = df.columns if columns is None else list(columns)
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    cells = F.array(*[F.struct(
        F.lit(c).alias("name"), col(c).cast("string").alias("text"),
        (F.when(~F.isnan(col(c).cast("double")), col(c).cast("double")) if c in numeric else F.lit(None).cast("double")).alias("number")) for c in columns])
    rows = df.select(part.cast("string").alias("part"), F.inline(cells))
    return rows.groupBy("part", "name").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("text").isNull()).alias("nulls"), F.min("text").alias("least"), F.max("text").alias("greatest"),
        F.min("number").alias("least_number"), F.max("number").alias("greatest_number"),
        F.hll_sketch_agg("text", F.lit(PLACES)).alias("distinct_sketch"),
        F.when(F.count("number") > 0, F.kll_sketch_agg_double("number", F.lit(KLL_SIZE))).alias("order_sketch"))


def append_sketches(sketches: DataFrame, path: str) -> None:
    sketches.write.mode("append").parquet(path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    """Stored sketches; a part that was appended twice counts once. Empty where there are none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], SKETCHES)
    return spark.read.schema(SKETCHES).parquet(path).dropDuplicates(["part", "name"])


def merged(sketches: DataFrame) -> DataFrame:
    """The profile of all parts: ``name, rows, nulls, least, greatest, unique_count, quantiles``; bounds of numbers are theirs as numbers."""
    is_number = F.col("order").isNotNull()
    one = sketches.groupBy("name").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.min("least_number").alias("least_number"), F.max("greatest_number").alias("greatest_number"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("unique_count"), F.kll_merge_agg_double("order_sketch").alias("order"))
    known = one.withColumn("order", F.when(F.col("greatest_number").isNotNull(), F.col("order")))
    return known.select(
        "name", "rows", "nulls", F.when(is_number, F.col("least_number").cast("string")).otherwise(F.col("least")).alias("least"),
        F.when(is_number, F.col("greatest_number").cast("string")).otherwise(F.col("greatest")).alias("greatest"), "unique_count",
        F.when(is_number, F.array(*[F.kll_sketch_get_quantile_double("order", F.lit(q)) for q in QUANTILES])).alias("quantiles"))


def profile_files(spark: SparkSession, files: DataFrame, read: Callable[[list[str]], DataFrame], path: str) -> DataFrame:
    """The profile of all ``files(path)``, of which only those are read that ``path`` has no sketches of.

    ``read`` gives the rows of a list of paths; their file is found by Spark itself.
    """
    known = read_sketches(spark, path).select(F.col("part").alias("path")).distinct()
    # One row per new file, no more than the file listing that Spark keeps anyway.
    new = [r["path"] for r in files.select("path").distinct().join(known, "path", "left_anti").collect()]
    if new:
        rows = read(new)
        append_sketches(sketch(rows.withColumn("_file", F.input_file_name()), F.col("_file"), rows.columns), path)
    return merged(read_sketches(spark, path).join(files.select(F.col("path").alias("part")).distinct(), "part", "left_semi"))
