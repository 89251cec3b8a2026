"""Writing tables, results per session, vector indexes, chart data and histories."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablesight.functions.nulls import col
from tablesight.functions.text import slug

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS"


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One record per line, dates in ISO form, missing values kept."""
    df.write.mode(mode).option("timestampFormat", ISO).option("timestampNTZFormat", ISO).option(
        "ignoreNullFields", False).json(path)


def write_json_documents(df: DataFrame, path: str, mode: str = "errorifexists", pretty: bool = True) -> None:
    """One JSON array per file, as programs write that dump a list: every task writes its rows as they come."""
    rows = df.select(F.to_json(F.struct("*"), {"pretty": str(pretty).lower()}).alias("value"))

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, some = "[", False
        for batch in batches:
            values = []
            for value in batch.column(0).to_pylist():
                values.append(f"{mark}\n{value}")
                mark, some = ",", True
            yield pa.RecordBatch.from_pydict({"value": pa.array(values, pa.string())})
        if some:
            yield pa.RecordBatch.from_pydict({"value": ["]"]})

    rows.mapInArrow(frame, "value string").write.mode(mode).text(path)


def append_results(results: DataFrame, path: str, session: str = "session_id", run_at: Column | None = None) -> None:
    """Append results, one folder per session; ``run_ts`` tells runs apart."""
    stamped = results.withColumn("run_ts", F.current_timestamp() if run_at is None else run_at)
    stamped.write.mode("append").partitionBy(session).parquet(path)


def latest_results(spark: SparkSession, path: str, session: str = "session_id") -> DataFrame:
    """All rows of the newest run of each session."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy(col(session).alias("_session")).agg(F.max("run_ts").alias("_run"))
    return rows.join(newest, col(session).eqNullSafe(F.col("_session")) & (F.col("run_ts") == F.col("_run")), "left_semi")


def result_name(operation: Column, request: Column, run_at: Column) -> Column:
    """File-like name of a stored result."""
    return F.concat_ws("_", F.lit("orchestration"), operation, slug(request), F.date_format(run_at, "yyyyMMdd_HHmmss"))


def save_index(chunks: DataFrame, path: str, vector: str = "embedding", mode: str = "overwrite") -> None:
    """Store chunks with their vectors; an index without rows is refused."""
    known = chunks.where(col(vector).isNotNull())
    if known.isEmpty():
        raise ValueError("there is nothing to index")
    known.write.mode(mode).parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as err:
        raise FileNotFoundError(f"no index at {path}") from err


def save_charts(charts: Mapping[str, DataFrame], path: str, mode: str = "overwrite") -> DataFrame:
    """Write each chart's data to its own folder and return the manifest ``(chart, path, columns)``."""
    if not charts:
        raise ValueError("there are no charts to save")
    rows, spark = [], None
    for i, (name, data) in enumerate(charts.items(), start=1):
        target = f"{path.rstrip('/')}/chart_{i:03d}"
        data.write.mode(mode).parquet(target)
        spark = data.sparkSession
        rows.append((name, target, data.columns))
    manifest = spark.createDataFrame(rows, "chart string, path string, columns array<string>")
    manifest.write.mode(mode).json(f"{path.rstrip('/')}/manifest")
    return manifest


def append_history(entries: DataFrame, path: str) -> None:
    """Append questions to a history table."""
    entries.write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str, order: str = "asked_at") -> DataFrame:
    return spark.read.parquet(path).orderBy(col(order))


def write_insights(insights: DataFrame, path: str, mode: str = "overwrite", links: Sequence[str] = ()) -> None:
    """Insights as JSON records; the named link columns move into ``references``."""
    out = insights
    for name in links:
        out = out.withColumn("references", F.col("references").withField(name, col(name))).drop(name)
    out.write.mode(mode).json(path)
