import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesight.operators import vectors
from tablesight.operators.text import chunk


def points(spark, rows, key="long"):
    return spark.createDataFrame(rows, f"id {key}, v array<float>")


def brute(rows, questions, k):
    out = set()
    for q, qv in questions:
        d = [(float(((np.array(v) - np.array(qv)) ** 2).sum()), i) for i, v in rows if v is not None]
        out |= {(q, i, r) for r, (_, i) in enumerate(sorted(d)[:k], start=1)}
    return out


@pytest.mark.parametrize("budget", [vectors.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("key", ["long", "string"])
def test_knn_equals_brute_force(spark, budget, key):
    rng = random.Random(2)
    cast = int if key == "long" else (lambda i: f"c{i:04d}")
    # Few distinct positions, so that many distances tie.
    rows = [(cast(i), [float(rng.randint(0, 2)) for _ in range(3)]) for i in range(400)] + [(cast(999), None)]
    asked = [(i, [rng.random() * 2 for _ in range(3)]) for i in range(6)] + [(9, [1.0, 1.0, 1.0])]
    queries = spark.createDataFrame(asked, "q int, w array<double>")
    out = vectors.knn(points(spark, rows, key).repartition(5), queries, "id", "v", "q", "w", 4, budget)
    assert {(r["q"], r["id"], r["rank"]) for r in out.collect()} == brute(rows, asked, 4)


def test_fewer_rows_than_k_and_no_questions(spark):
    corpus = points(spark, [(1, [0.0]), (2, [3.0])])
    queries = spark.createDataFrame([(0, [1.0])], "q int, w array<double>")
    assert [(r["id"], r["distance"]) for r in vectors.knn(corpus, queries, "id", "v", "q", "w").orderBy("rank").collect()] == [(1, 1.0), (2, 4.0)]
    assert vectors.knn(corpus, queries.where("q > 5"), "id", "v", "q", "w").count() == 0
    assert [r["id"] for r in vectors.nearest_to(corpus, "v", [2.9], "id", 1).collect()] == [2]


def test_approximate_finds_most_and_measures_itself(spark, sf_dir):
    corpus = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = vectors.centroids(corpus, "label", "embedding")
    exact = vectors.knn(corpus, queries, "vec_id", "embedding", "label", "centroid")
    near = vectors.approximate_knn(corpus, queries, "vec_id", "embedding", "label", "centroid")
    assert vectors.recall(exact, near, "label", "vec_id").first()["recall"] > 0.8


def test_approximate_gives_every_question_its_rows(spark):
    corpus = points(spark, [(i, [100.0 * i, 0.0]) for i in range(9)] + [(50, None)])
    queries = spark.createDataFrame([(0, [5000.0, 0.0]), (1, [-700.0, 3.0]), (2, None)], "q int, w array<double>")
    near = vectors.approximate_knn(corpus, queries, "id", "v", "q", "w", 2)
    assert sorted((r["q"], r["id"], r["rank"]) for r in near.collect()) == [(0, 7, 2), (0, 8, 1), (1, 0, 1), (1, 1, 2)]


@pytest.mark.parametrize("budget", [vectors.BROADCAST_BYTES, 0])
def test_null_questions_are_left_out(spark, budget):
    queries = spark.createDataFrame([(0, [1.0]), (1, None)], "q int, w array<double>")
    out = vectors.knn(points(spark, [(1, [0.0]), (2, [3.0])]), queries, "id", "v", "q", "w", 1, budget)
    assert [(r["q"], r["id"]) for r in out.collect()] == [(0, 1)]


def test_embedding_and_context(spark):
    docs = spark.createDataFrame([("a", "red apple pie"), ("b", "blue sky"), ("c", "apple tart"), ("d", " ")], "doc string, text string")
    chunks = vectors.embed(chunk(docs, "doc", "text"), dimensions=64)
    assert chunks.count() == 3
    assert chunks.select(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x).alias("n")).where("abs(n - 1) > 1e-5").count() == 0
    asked = chunks.where("doc = 'c'").select(F.lit("apple").alias("q"), F.col("embedding").alias("w"))
    near = vectors.knn(chunks, asked, "chunk_id", "embedding", "q", "w", 2)
    assert vectors.context(near, chunks, "q", "chunk_id").first()["context"] == "apple tart\n\nred apple pie"


def test_own_model_skips_failures(spark):
    docs = spark.createDataFrame([("a", "one"), ("b", "two words")], "doc string, chunk_text string")
    out = vectors.embed(docs, model=lambda batch: [[float(len(t.split()))] if " " in t else None for t in batch])
    assert [(r["doc"], r["embedding"]) for r in out.collect()] == [("b", [2.0])]

    def moody(batch):
        if any(t == "one" for t in batch):
            raise ValueError("refused")
        return [[1.0] for _ in batch]

    assert [r["doc"] for r in vectors.embed(docs.coalesce(1), model=moody).collect()] == ["b"]


def test_stored_counts_give_the_same_vectors_and_texts_are_split_once(spark):
    texts = ["a b a", "B c", None, "", "   \n", "d", "　a"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "id int, chunk_text string")
    model = vectors.TfIdf(corpus, dimensions=16, keep=["id"])
    kept, made = model.embed(), model.embed(corpus)
    assert kept.columns == ["id", "embedding"]
    assert sorted(map(tuple, kept.collect())) == sorted((r["id"], r["embedding"]) for r in made.collect())
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 5, 6]
    assert made._jdf.queryExecution().executedPlan().toString().count("split(") == 1
    with pytest.raises(ValueError):
        vectors.TfIdf(corpus, dimensions=16).embed()
