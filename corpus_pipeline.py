"""From documents to packed training sequences: each stage works on all rows that the one before it kept.

Between stages the rows are written as a table, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesight.functions.storage import store
from tablesight.llm import jaccard, mixing, packing, secrets, toxicity
from tablesight.llm.queries import ranks_path


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones does not find toxic. Null and empty texts are scored as empty; repeated rows stay as often as given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group that shares at least 80 % of its five-word shingles: the smallest id.

    Rows are known by a number that is stored with them, so null and repeated ids are no exception, and all
    jobs see the same numbers however the files are split.
    """
    row = _unused(docs, "_row")
    rows = store(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = jaccard.link(rows, id_col=row, ngram=5, percent=80)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    stays = (rows.select(row, "doc_id").join(groups, row).groupBy("component_id").agg(F.min(order).alias("first"))
             .select(F.col("first")[row].alias(row)))
    return rows.join(stays, row, "left_semi").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; the recorded length follows. Null texts stay null."""
    before = _unused(docs, "_before")
    masked = secrets.redact(docs.withColumn(before, F.length("text")))
    masked = masked.withColumn("n_chars", F.when(F.length("text") != F.col(before), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is a source, a null text has no words."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their sequence and place; a null or empty text is one piece of its end token."""
    return packing.pack(packing.tokenise(docs, ranks_path()))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Models, tokens and packing are beyond SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES, 1):
        rows = stage(spark, rows, sf_dir)
        if place < len(STAGES):
            rows = store(rows)
    return rows
