"""Catalog classes, health of answers, and totals of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablesight.functions.nulls import col
from tablesight.functions.text import suffix

# Extensions by nature of the data.
STRUCTURED = (".csv", ".xlsx", ".xls")
UNSTRUCTURED = (".pdf", ".html", ".htm", ".txt", ".md")
FLEXIBLE = (".json",)

# Limits and weights of the health score.
LATENCY_THRESHOLD_MS = 60_000
AVAILABILITY_WEIGHT, LATENCY_PENALTY, INDEX_PENALTY, ERROR_PENALTY, MAX_ERROR_PENALTY = 40.0, 20.0, 20.0, 5.0, 20.0
HEALTHY, DEGRADED = 80, 50
LISTED_ERRORS = 5

# Upload size classes in bytes.
INLINE_BYTES, SINGLE_BYTES = 15_000_000, 50_000_000

# Media types by extension.
MEDIA_TYPES = {
    ".pdf": "application/pdf",
    ".txt": "text/plain",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".doc": "application/msword",
    ".rtf": "application/rtf",
    ".json": "application/json",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".xls": "application/vnd.ms-excel",
    ".csv": "text/csv",
    ".tsv": "text/tab-separated-values",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".webp": "image/webp",
    ".heif": "image/heif",
    ".mp4": "video/mp4",
    ".mpeg": "video/mpeg",
    ".mov": "video/quicktime",
    ".avi": "video/x-msvideo",
    ".mpg": "video/mpeg",
    ".webm": "video/webm",
    ".wmv": "video/x-ms-wmv",
    ".flv": "video/x-flv",
    ".3gp": "video/3gpp",
    ".c": "text/x-c",
    ".cpp": "text/x-c++",
    ".py": "text/x-python",
    ".java": "text/x-java",
    ".php": "text/x-php",
    ".sql": "application/sql",
    ".html": "text/html",
    ".htm": "text/html",
    ".css": "text/css",
    ".js": "text/javascript",
    ".xml": "text/xml",
    ".md": "text/markdown",
}
DEFAULT_MEDIA_TYPE = "application/octet-stream"


def data_nature(extension: Column) -> Column:
    """structured, unstructured, flexible or unknown."""
    return (
        F.when(extension.isin(*STRUCTURED), "structured").when(extension.isin(*UNSTRUCTURED), "unstructured")
        .when(extension.isin(*FLEXIBLE), "flexible").otherwise("unknown"))


def media_type(extension: Column) -> Column:
    known = F.create_map(*[F.lit(v) for pair in MEDIA_TYPES.items() for v in pair])
    return F.coalesce(known[extension], F.lit(DEFAULT_MEDIA_TYPE))


def classify_sources(files: DataFrame, path: str) -> DataFrame:
    """Adds ``extension``, ``data_nature`` and ``media_type`` to a list of files."""
    extension = suffix(col(path))
    return files.withColumns({
        "extension": extension, "data_nature": data_nature(extension), "media_type": media_type(extension)})


def catalog_summary(sources: DataFrame, by: Sequence[str] = (), exists: str | None = None) -> DataFrame:
    """Counts of all, existing, and per nature."""
    nature = lambda n: F.count_if(F.col("data_nature") == n)
    there = F.count_if(col(exists)) if exists else F.count(F.lit(1))
    return sources.groupBy(*[col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("total"), there.alias("existing"), nature("structured").alias("structured"),
        nature("unstructured").alias("unstructured"), nature("flexible").alias("flexible"),
        nature("unknown").alias("unknown"))


def upload_mix(sources: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per session what its files are, taken together; a session without any file is ``none``."""
    has = lambda n: F.coalesce(F.bool_or(F.col("data_nature") == n), F.lit(False))
    flags = sources.groupBy(*[col(b) for b in by]).agg(
        F.count("extension").alias("files"), has("structured").alias("s"), has("unstructured").alias("u"),
        has("flexible").alias("f"))
    label = (
        F.when(F.col("files") == 0, "none").when(F.col("s") & F.col("u"), "mixed").when(F.col("s"), "structured")
        .when(F.col("u"), "unstructured").when(F.col("f"), "flexible").otherwise("unknown"))
    return flags.select(*[col(b) for b in by], "files", label.alias("primary_data_nature"))


def upload_class(files: DataFrame, by: Sequence[str], size: str) -> DataFrame:
    """Per session how its files are best handed over, by their total size."""
    sums = files.groupBy(*[col(b) for b in by]).agg(
        F.coalesce(F.sum(col(size)), F.lit(0)).alias("bytes"), F.count(col(size)).alias("files"))
    label = (
        F.when(F.col("bytes") < INLINE_BYTES, "inline_batch")
        .when((F.col("files") == 1) & (F.col("bytes") < SINGLE_BYTES), "files_api_single")
        .otherwise("files_api_individual"))
    return sums.withColumn("upload_class", label)


def health_score(availability: Column, latency_ms: Column, threshold_ms: Column, index_missing: Column,
                 errors: Column) -> Column:
    """Score from 0 to 100: deductions for missing files, slow answers, a missing index and errors."""
    late = F.coalesce(latency_ms > threshold_ms, F.lit(False))
    score = (
        100.0 - (1.0 - F.coalesce(availability, F.lit(1.0))) * AVAILABILITY_WEIGHT
        - F.when(late, LATENCY_PENALTY).otherwise(0.0)
        - F.when(F.coalesce(index_missing, F.lit(False)), INDEX_PENALTY).otherwise(0.0)
        - F.least(F.lit(MAX_ERROR_PENALTY), F.coalesce(errors, F.lit(0)) * ERROR_PENALTY))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def health_status(score: Column) -> Column:
    return F.when(score >= HEALTHY, "healthy").when(score >= DEGRADED, "degraded").otherwise("failing")


def health(rows: DataFrame, threshold_ms: float = LATENCY_THRESHOLD_MS) -> DataFrame:
    """Adds ``health_score``, ``status`` and ``alerts`` to monitoring rows.

    Rows hold ``files`` ARRAY<STRUCT<name, exists>>, ``latency_ms``, ``processing_type``,
    ``rag_index_present`` and ``errors`` ARRAY<STRING>.
    """
    files = F.coalesce(F.col("files"), F.array().cast(rows.schema["files"].dataType))
    missing = F.filter(files, lambda f: ~f["exists"])
    share = F.coalesce(1.0 - F.try_divide(F.size(missing), F.size(files)), F.lit(1.0))
    no_index = ~F.coalesce("rag_index_present", F.lit(False)) & F.coalesce(
        F.col("processing_type") == "RAG", F.lit(False))
    errors = F.coalesce(F.col("errors"), F.array().cast("array<string>"))
    limit = F.lit(float(threshold_ms))
    score = health_score(share, F.col("latency_ms"), limit, no_index, F.size(errors))
    alerts = F.concat(
        F.array_compact(F.array(
            F.when(F.size(missing) > 0, F.concat(F.lit("Missing files: "), F.array_join(
                F.transform(missing, lambda f: f["name"]), ", "))),
            F.when(F.col("latency_ms") > limit, F.concat(
                F.lit("High answer latency: "), F.col("latency_ms").cast("string"),
                F.lit(f" ms > {threshold_ms} ms"))),
            F.when(no_index, F.lit("RAG index not found after qualitative processing")))),
        F.transform(F.slice(errors, 1, LISTED_ERRORS), lambda e: F.concat(F.lit("Error: "), e)))
    return rows.withColumn("availability", share).withColumn("health_score", score).withColumn(
        "status", health_status(F.col("health_score"))).withColumn("alerts", alerts)


def first_errors(events: DataFrame, by: str, order: str, message: Column, is_error: Column) -> DataFrame:
    """Rows ``(by, errors)`` with each session's first errors.

    Score and alerts look at no more than the listed errors, so nothing beyond them is collected.
    """
    rank = W.partitionBy(col(by)).orderBy(col(order))
    first = events.where(is_error).select(col(by), col(order), message.alias("_message")).withColumn(
        "_rank", F.row_number().over(rank)).where(F.col("_rank") <= LISTED_ERRORS)
    packed = F.array_sort(F.collect_list(F.struct("_rank", "_message")))
    return first.groupBy(col(by)).agg(F.transform(packed, lambda e: e["_message"]).alias("errors"))


def step_summary(steps: DataFrame, by: str = "session_id") -> DataFrame:
    """Per session: completed, failed and all steps, cost and tokens. The root node is not a step."""
    status = lambda s: F.count_if(F.col("status") == s)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return steps.where(F.col("step_id") != "ROOT").groupBy(col(by)).agg(
        status("completed").alias("completed_steps"), status("failed").alias("failed_steps"),
        F.count(F.lit(1)).alias("total_steps"), total("cost").alias("total_cost"),
        total("input_tokens").alias("total_input_tokens"), total("output_tokens").alias("total_output_tokens"))


def run_summary(runs: DataFrame, by: Sequence[str], created: str, seconds: str) -> DataFrame:
    """Per run: charts requested and created, success rate, charts per second, status."""
    sums = runs.groupBy(*[col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("requested"), F.count_if(col(created)).alias("created"),
        F.coalesce(F.sum(col(seconds)), F.lit(0.0)).alias("seconds"))
    return sums.withColumns({
        "success_rate": F.coalesce(F.try_divide("created", "requested"), F.lit(0.0)),
        "charts_per_second": F.coalesce(F.try_divide(F.col("created").cast("double"), F.col("seconds")), F.lit(0.0)),
        "status": F.when(F.col("created") == 0, "failed").when(
            F.col("created") < F.col("requested"), "partial_success").otherwise("success"),
    })


def answers(sessions: DataFrame, steps: DataFrame, by: str = "session_id") -> DataFrame:
    """Per session its final answer: the stored one, else the output of its retrieval step.

    ``sessions`` has ``answer``, ``primary_classification`` and ``secondary_classification``; ``steps``
    has ``step_id`` and ``output``.
    """
    found = steps.where(F.col("step_id") == "rag_processing").groupBy(col(by)).agg(F.max("output").alias("_output"))
    joined = sessions.join(found, by, "left")
    return joined.select(
        col(by), F.coalesce(F.nullif("answer", F.lit("")), "_output").alias("final_answer"),
        "primary_classification",
        F.coalesce(F.nullif("secondary_classification", F.lit("")), F.lit("None")).alias("secondary_classification"))
