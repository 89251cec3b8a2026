"""Lists of files: what there is, what kind it is, which one to use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesight.functions.nulls import col
from tablesight.functions.text import file_name, suffix

# Accepted uploads, artifact groups, entry pages, dataset preference.
UPLOADS = (".csv", ".xlsx", ".xls", ".json", ".txt", ".pdf", ".html", ".htm", ".md")
ARTIFACTS = ("html", "png", "svg", "pdf", "yaml", "json")
ENTRY_PAGES = ("plotly_index.html", "report.html")
DATASET_RANK = {".csv": 0, ".xlsx": 1, ".xls": 1}


def list_files(spark: SparkSession, path, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """Rows ``(path, name, extension, size, modified)``; file contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path", file_name(F.col("path")).alias("name"), suffix(F.col("path")).alias("extension"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def allowed_uploads(files: DataFrame, extensions: Sequence[str] = UPLOADS) -> DataFrame:
    return files.where(F.col("extension").isin(*extensions))


def artifact_groups(files: DataFrame, base_url: str = "") -> DataFrame:
    """Adds ``kind`` (html, png, …, other) and, with a base address, ``public_url``."""
    kind = F.regexp_replace("extension", r"^\.", "")
    out = files.withColumn("kind", F.when(kind.isin(*ARTIFACTS), kind).otherwise("other"))
    if base_url.strip():
        out = out.withColumn("public_url", F.concat(
            F.lit(base_url.strip().rstrip("/") + "/"), F.regexp_replace("path", "^/+", "")))
    return out


def preferred_entry(files: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per session the page to open first."""
    ranks = F.create_map(*[F.lit(v) for i, n in enumerate(ENTRY_PAGES) for v in (n, i)])
    return files.withColumn("_rank", ranks[F.col("name")]).where("_rank IS NOT NULL").groupBy(
        *[col(b) for b in by]).agg(F.min_by("path", F.struct("_rank", "path")).alias("preferred_entry"))


def choose_dataset(manifest: DataFrame, by: Sequence[str], path: str, position: str, exists: str | None = None) -> DataFrame:
    """Per session the first existing CSV file of its manifest, else the first Excel file."""
    ranks = F.create_map(*[F.lit(v) for pair in DATASET_RANK.items() for v in pair])
    rows = manifest.withColumn("_rank", ranks[suffix(col(path))]).where("_rank IS NOT NULL")
    if exists:
        rows = rows.where(col(exists))
    return rows.groupBy(*[col(b) for b in by]).agg(
        F.min_by(col(path), F.struct(F.col("_rank"), col(position))).alias("dataset"))


def latest(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Newest row per key; one row per key and task is shuffled."""
    rest = [c for c in rows.columns if c not in by]
    newest = rows.groupBy(*[col(b) for b in by]).agg(
        F.max_by(F.struct(*[col(c) for c in rest]), col(order)).alias("_row"))
    return newest.select(*[col(c) if c in by else F.col("_row").getField(c).alias(c) for c in rows.columns])

