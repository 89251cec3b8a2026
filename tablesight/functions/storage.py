"""Durable cuts in a plan and order-preserving row numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application that every executor can reach; it is removed when the application ends.

    It lies in ``spark.checkpoint.dir``, or in the warehouse where that is unset.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stored"
    folder = f"{shared.rstrip('/')}/tablesight-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and continue from the written table.

    Unlike a cached copy it outlives lost executors, and later steps read only the columns they use.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_global_rank(df: DataFrame, order: list, name: str = "_row_id", start: int = 0) -> DataFrame:
    """Add consecutive numbers in the global order of ``order`` without sorting everything in one task.

    The sorted rows are written once; each sorted partition then only needs the row count of the
    partitions before it, a table with one row per partition.
    """
    ranked = store(
        df.orderBy(*order)
        .withColumn("_mono", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mono", 33))
        .withColumn("_pos", F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    sizes = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # One row per sorted partition, so this side is always small.
    return (
        ranked.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + F.col("_pos") + start).cast("bigint"))
        .drop("_mono", "_part", "_pos", "_offset")
    )
