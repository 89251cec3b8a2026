"""What the vector operators share: which vectors take part, and bounded samples of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE = 20_000


def usable(vector: Column) -> Column:
    """Whether a vector is neither null, empty, zero nor holds null or non-finite components."""
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & plain & F.exists(vector, lambda x: x != 0), F.lit(False))


def same_length(vectors: DataFrame, name: str = "vector") -> DataFrame:
    """The rows whose vector has the most frequent length, of equally frequent ones the smallest."""
    lengths = vectors.groupBy(F.size(name).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return vectors.where(F.size(name) == (lengths[0].d if lengths else 0))


def sample(vectors: DataFrame, by: str, name: str = "vector", rows: int = SAMPLE) -> np.ndarray:
    """At most ``rows`` vectors, those with the smallest hashes of ``by``, as a matrix on the driver."""
    taken = vectors.select(name, F.xxhash64(by).alias("h")).orderBy("h").limit(rows).select(name).toPandas()[name]
    return np.array([np.asarray(v, float) for v in taken]) if len(taken) else np.zeros((0, 0))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long vectors as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
