"""Text documents from folders, and one chunk table from documents of all kinds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesight.operators.figures import extract_html
from tablesight.operators.html import blank_to_null
from tablesight.operators.text import chunk, indented_json
from tablesight.sources.readers import file_path


def read_documents(spark: SparkSession, path, pattern: str = "*.{txt,md,html,htm,json}") -> DataFrame:
    """Rows ``(doc, path, text, kind)``, one per file, named by its path. Bytes that are not UTF-8 are read as ISO-8859-1."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True).select(
        file_path().alias("path"), F.col("value"))
    text = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(
        F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    kind = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    clean = F.regexp_replace(text, r"^\x{FEFF}", "")
    return raw.select(F.col("path").alias("doc"), "path", clean.alias("text"), kind.alias("kind"))


def document_text(docs: DataFrame, page_kinds: Sequence[str] = ("html", "htm")) -> DataFrame:
    """Rows ``(doc, text)`` with markup and JSON turned into plain text; blank documents are dropped."""
    is_page = F.col("kind").isin(*page_kinds)
    pages = extract_html(docs.where(is_page), "doc", "text").select("doc", "text")
    json = docs.where(F.col("kind") == "json").select("doc", indented_json(F.col("text")).alias("text"))
    plain = docs.where(~is_page & (F.col("kind") != "json")).select("doc", "text")
    every = reduce(DataFrame.unionByName, [pages, json, plain])
    return every.where(blank_to_null(F.col("text")).isNotNull())


def chunk_all(parts: Sequence[DataFrame]) -> DataFrame:
    """One chunk table from several; columns missing in one part are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def chunk_documents(docs: DataFrame, **options) -> DataFrame:
    return chunk(document_text(docs), "doc", "text", **options)
