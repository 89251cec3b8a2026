"""Bounded training samples and features that classifiers of this package share."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

# Rows per class that a classifier is fitted on: the smallest hashes of all labelled rows.
ROWS_PER_CLASS = 5_000
HELD_OUT_OF = 5
# Partitions of the sample: its texts can be long, and a task holds those of its rows at once.
PARTS = 64


def held_out(doc_id: Column) -> Column:
    """Whether a row is never used to learn: its digest is a multiple of five. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF == 0


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
                  rows_per_class: int = ROWS_PER_CLASS, **others: str) -> DataFrame:
    """``(id, text, label)``, and ``others`` as name to column, of at most ``rows_per_class`` rows of each class, chosen by hash, none of them held out.

    An id with several labels has its greatest, an id with several documents the one whose text has the smallest hash; ids without
    document and rows without label are left out. The chosen ids are broadcast: their number is bounded by the parameter.
    """
    given = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
             .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
             .groupBy("id").agg(F.max("label").alias("label")).withColumn("hash", F.xxhash64("id")))
    few = [given.where(F.col("label") == k).orderBy("hash", "id").limit(rows_per_class) for k in (0, 1)]
    kept = [F.col(column).alias(name) for name, column in others.items()]
    rows = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *kept)
            .join(F.broadcast(few[0].unionByName(few[1]).select("id", "label")), "id"))
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", *others)).alias("row")
    chosen = rows.groupBy("id", "label").agg(one).select("id", *[f"row.{c}" for c in ("text", *others)], "label")
    return chosen.repartition(PARTS, "id")


def bucket(token: str, bits: int) -> int:
    """A stable place of a token in a table of ``2 ** bits``."""
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) * 2654435761 % (1 << 32) >> (32 - bits)


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression, by Newton steps."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + ridge * w
        curvature = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


WORD = re.compile(r"\w+")
