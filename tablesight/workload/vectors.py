"""Nearest neighbours and retrieval over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tablesight.functions.storage import store
from tablesight.operators import vectors
from tablesight.operators.text import chunk
from tablesight.workload.registry import query

_MEANS = """means AS (SELECT label, list(m ORDER BY i) AS centroid FROM (
        SELECT label, i, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
        GROUP BY ALL) GROUP BY 1)"""
_NEAREST = f"""{_MEANS}, near AS (SELECT m.label, vec_id, list_distance(e.embedding::DOUBLE[], m.centroid) ** 2 AS d
        FROM means m, embeddings e QUALIFY row_number() OVER (PARTITION BY m.label ORDER BY d, vec_id) <= 5)"""


def nearest_to_means(t) -> DataFrame:
    """The five vectors nearest to each label's mean vector."""
    means = vectors.centroids(t("embeddings"), "label", "embedding")
    return vectors.knn(t("embeddings"), means, "vec_id", "embedding", "label", "centroid", 5)


@query("knn_exact", f"""
    WITH {_NEAREST} SELECT label, vec_id, round(d, 8) AS distance,
        row_number() OVER (PARTITION BY label ORDER BY d, vec_id)::INT AS rank FROM near""")
def knn_exact(t):
    return nearest_to_means(t).withColumn("distance", F.round("distance", 8))


@query("knn_blocks", f"""
    WITH {_NEAREST} SELECT label, vec_id, round(d, 8) AS distance,
        row_number() OVER (PARTITION BY label ORDER BY d, vec_id)::INT AS rank FROM near""")
def knn_blocks(t):
    """The way taken when there are too many questions to send to every task."""
    means = vectors.centroids(t("embeddings"), "label", "embedding")
    out = vectors.knn(t("embeddings"), means, "vec_id", "embedding", "label", "centroid", 5, broadcast_bytes=0)
    return out.withColumn("distance", F.round("distance", 8))


@query("centroids", f"WITH {_MEANS} SELECT label, unnest(range(64))::INT AS i, round(unnest(centroid), 8) AS x FROM means")
def centroids(t):
    means = vectors.centroids(t("embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 8))


@query("rag_context", f"""
    WITH {_NEAREST} SELECT label, string_agg('vector ' || vec_id, chr(10) || chr(10) ORDER BY d, vec_id) AS context FROM near GROUP BY 1""")
def rag_context(t):
    chunks = t("embeddings").select("vec_id", F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("chunk_text"))
    return vectors.context(nearest_to_means(t), chunks, "label", "vec_id")


@query("lsh_knn")
def lsh_knn(t):
    means = vectors.centroids(t("embeddings"), "label", "embedding")
    return vectors.approximate_knn(t("embeddings"), means, "vec_id", "embedding", "label", "centroid", 5)


@query("rag_retrieval")
def rag_retrieval(t):
    """Chunks of all documents nearest to each benchmark text, by hashed TF-IDF vectors."""
    chunks = chunk(t("documents", spread=True), "doc_id", "text")
    model = vectors.TfIdf(chunks, dimensions=128, keep=["chunk_id"])
    asked = model.embed(t("benchmark"), "text", "question")
    return vectors.knn(model.embed(), asked, "chunk_id", "embedding", "item_id", "question", 5)


@query("lsh_recall", f"WITH {_NEAREST} SELECT count(*) AS wanted, true AS enough FROM near")
def lsh_recall(t):
    """Whether the approximate neighbours hold at least 90 % of the exact ones."""
    means = vectors.centroids(t("embeddings"), "label", "embedding")
    found = vectors.approximate_knn(t("embeddings"), means, "vec_id", "embedding", "label", "centroid", 5)
    return vectors.recall(nearest_to_means(t), found, "label", "vec_id").select("wanted", (F.col("recall") >= 0.9).alias("enough"))


@query("lsh_rows", "SELECT label, unnest(range(1, 6)) AS rank, 5 AS rows, true AS exact, true AS in_order FROM (SELECT DISTINCT label FROM embeddings)")
def lsh_rows(t):
    """Approximate neighbours as a result must be: as many as asked for, ranked by their exact distances."""
    embeddings = t("embeddings")
    means = vectors.centroids(embeddings, "label", "embedding")
    near = vectors.approximate_knn(embeddings, means, "vec_id", "embedding", "label", "centroid", 5)
    again = vectors.squared_distance(F.col("centroid"), F.col("embedding"))
    known = near.join(embeddings.select("vec_id", "embedding"), "vec_id").join(means, "label").withColumn("again", again)
    per_question = W.partitionBy("label")
    return known.select(
        "label", "rank", F.count(F.lit(1)).over(per_question).alias("rows"), (F.abs(F.col("distance") - F.col("again")) < 1e-9).alias("exact"),
        (F.row_number().over(per_question.orderBy("again", "vec_id")) == F.col("rank")).alias("in_order"))


@query("rag_rows", """
    SELECT item_id, unnest(range(1, 6)) AS rank, 5 AS rows, true AS exact, true AS in_order FROM benchmark""")
def rag_rows(t):
    """Retrieved chunks as a result must be: five for every question, ranked by exact distances of unit vectors."""
    chunks = chunk(t("documents", spread=True), "doc_id", "text")
    model = vectors.TfIdf(chunks, dimensions=128, keep=["chunk_id"])
    asked = model.embed(t("benchmark"), "text", "question")
    embedded = store(model.embed())
    near = vectors.knn(embedded, asked, "chunk_id", "embedding", "item_id", "question", 5)
    known = near.join(embedded, "chunk_id").join(asked.select("item_id", "question"), "item_id").withColumn(
        "again", vectors.squared_distance(F.col("question"), F.col("embedding")))
    per_question = W.partitionBy("item_id")
    unit = F.abs(vectors.squared_distance(F.col("embedding"), F.transform("embedding", lambda _: F.lit(0.0))) - 1) < 1e-5
    return known.select(
        "item_id", "rank", F.count(F.lit(1)).over(per_question).alias("rows"), (unit & (F.abs(F.col("distance") - F.col("again")) < 1e-9)).alias("exact"),
        (F.row_number().over(per_question.orderBy("again", "chunk_id")) == F.col("rank")).alias("in_order"))
