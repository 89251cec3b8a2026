"""Clusters, principal components and tests that Spark ML provides."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import KolmogorovSmirnovTest
from pyspark.sql import DataFrame, functions as F, types as T

from tablesight.functions.nulls import col

SEED = 7


def with_vector(df: DataFrame, columns: Sequence[str] | str, name: str = "_features") -> DataFrame:
    """A vector column from an array column or from several measures; incomplete rows are dropped."""
    if isinstance(columns, str):
        return df.where(col(columns).isNotNull()).withColumn(name, array_to_vector(col(columns)))
    return VectorAssembler(inputCols=list(columns), outputCol=name, handleInvalid="skip").transform(df)


def clusters(df: DataFrame, columns: Sequence[str] | str, k: int, seed: int = SEED) -> DataFrame:
    """Add the number of each row's k-means cluster."""
    data = with_vector(df, columns)
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(data)
    return model.transform(data).drop("_features")


def principal_components(df: DataFrame, columns: Sequence[str] | str, k: int) -> DataFrame:
    """Add the row's coordinates on the first ``k`` principal components."""
    data = with_vector(df, columns)
    model = PCA(k=k, inputCol="_features", outputCol="_pca").fit(data)
    return model.transform(data).withColumn("components", vector_to_array("_pca")).drop("_features", "_pca")


def explained_variance(df: DataFrame, columns: Sequence[str] | str, k: int) -> DataFrame:
    """Rows ``(component, explained_variance)``."""
    model = PCA(k=k, inputCol="_features", outputCol="_pca").fit(with_vector(df, columns))
    rows = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance)]
    return df.sparkSession.createDataFrame(rows, "component int, explained_variance double")


def _gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 10_000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = value = 1 / b
    for n in range(1, 10_000):
        b += 2
        d = 1 / (b - n * (n - a) * d)
        c = b - n * (n - a) / c
        value *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * value


@F.udf(T.DoubleType())
def _chi_square_tail(statistic, dof):
    """Probability of a value at least this large. Called on a result of one row."""
    return None if statistic is None or not dof else _gamma_tail(dof / 2, max(statistic, 0.0) / 2)


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``(statistic, df, p_value)``: are two categorical columns independent?

    One grouping gives the observed cells. Cells that do not occur add what is expected of them: all rows
    less what is expected of the observed ones. Rows without either value are left out.
    """
    cells = (df.where(col(a).isNotNull() & col(b).isNotNull()).groupBy(col(a).alias("a"), col(b).alias("b"))
             .agg(F.count(F.lit(1)).cast("double").alias("o")))
    rows = cells.groupBy("a").agg(F.sum("o").alias("r"))
    columns = cells.groupBy("b").agg(F.sum("o").alias("c"))
    total = cells.agg(F.sum("o")).scalar()
    e = F.col("r") * F.col("c") / total
    sums = cells.join(rows, "a").join(columns, "b").withColumn("e", e).agg(
        F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e")).alias("seen"), F.sum("e").alias("expected"),
        F.sum("o").alias("n"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))
    found = sums.select((F.col("seen") + F.col("n") - F.col("expected")).alias("statistic"),
                        ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("df"))
    return found.select("statistic", "df", _chi_square_tail("statistic", F.col("df").cast("double")).alias("p_value"))


def normality(df: DataFrame, measure: str) -> DataFrame:
    """One row ``(statistic, p_value)``: Kolmogorov-Smirnov distance to the fitted normal distribution."""
    stats = df.agg(F.avg(col(measure)).alias("m"), F.stddev_samp(col(measure)).alias("s")).first()
    values = df.where(col(measure).isNotNull()).select(col(measure).cast("double").alias("v"))
    return KolmogorovSmirnovTest.test(values, "v", "norm", float(stats["m"]), float(stats["s"])).select(
        "statistic", F.col("pValue").alias("p_value"))
