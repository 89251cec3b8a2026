import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesight.llm import quality, toxicity
from tablesight.llm.queries import QUERIES
from tablesight.llm.sampling import ROWS_PER_CLASS, logistic, training_rows


def slow_segments(scores):
    """Maximal segments by their definition: repeatedly the best segment, then the same left and right of it."""
    def best(low, high):
        found = max(((sum(scores[a:b]), -(b - a), -a) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0,))
        if found[0] <= 0:
            return []
        a = -found[2]
        b = a - found[1]
        return [*best(low, a), (a, b, found[0]), *best(b, high)]

    return best(0, len(scores))


def test_segments_are_all_maximal_ones():
    rng = random.Random(0)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        got = toxicity.segments(np.array(scores, float))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in slow_segments(scores)]


def test_segments_take_linear_time():
    assert len(toxicity.segments(np.tile([1.0, -0.5, 1.0, -3.0], 100_000))) > 0


@pytest.fixture
def corpus(documents, spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioustr") for _ in range(4))
    rows, labels = [], []
    for i in range(500):
        toxic, good = rng.random() < 0.3, rng.random() < 0.6
        words = [word() for _ in range(rng.randint(5, 80))]
        if not good:
            words = [w + "$$$" for w in words] if i % 2 else [words[0]] * 40
        if toxic:
            words[2:2] = rng.sample(["vile", "vilest", "scummy", "scum!", "Moron"], 2)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(good), int(toxic), "x"))
    rows += [(900, None, None), (901, "", "s"), (902, "long " * 200_000, "s"), (None, "no id", "s"), (3, rows[3][1], "s")]
    labels += [(7, None, None, "x"), (None, 1, 1, "x"), (9999, 1, 1, "x"), (3, labels[3][1], labels[3][2], "x")]
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), {i: (g, t) for i, g, t, _ in labels}


@pytest.mark.parametrize("operator, column, which", [(toxicity, "toxic", 1), (quality, "quality", 0)])
def test_scores(corpus, operator, column, which):
    docs, labels, truth = corpus
    model = operator.fit(docs, labels)
    scored = operator.score(docs, model).collect()
    assert len(scored) == 505 and all(0 <= r.score <= 1 for r in scored)
    held = [r for r in scored if r.doc_id is not None and r.doc_id < 500 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = [(r.score >= 0.5) == bool(truth[r.doc_id][which]) for r in held]
    assert len(held) > 60 and sum(right) >= 0.95 * len(right)
    assert len({r.score for r in scored if r.doc_id == 3}) == 1
    assert operator.score(docs.where("false"), model).count() == 0


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_without_labels(corpus, operator):
    docs, labels, _ = corpus
    assert {r.score for r in operator.score(docs, operator.fit(docs, labels.where("false"))).collect()} == {0.0}
    one = operator.fit(docs, labels.withColumn("toxic", F.lit(1)).withColumn("quality", F.lit(1)))
    assert {r.score for r in operator.score(docs, one).collect()} == {1.0}
    empty = operator.fit(docs.where("false"), labels)
    assert {r.score for r in operator.score(docs, empty).collect()} == {0.0}


def test_rejects_toxic_rows_only(corpus):
    docs, labels, truth = corpus
    kept = toxicity.reject(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert sum((i in ids) != bool(truth[i][1]) for i in range(500)) >= 0.98 * 500 and {900, 901, 902, None} <= ids


def test_texts_without_evidence_are_not_rejected(documents, spark):
    docs = documents([(1, "fine words", "s"), (3, "other ones", "s"), (5, None, "s"), (6, "third text", "s")])
    labels = spark.createDataFrame([(i, int(i == 3)) for i in (1, 3)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.5}  # one text of each class, no word twice
    assert toxicity.reject(docs, model).count() == 4


def test_held_out_rows_are_never_learned_from(corpus):
    docs, labels, _ = corpus
    used = {r.id for r in training_rows(docs, labels, "toxic").collect()}
    assert used and not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in used)
    assert training_rows(docs, labels, "toxic", rows_per_class=20).select("id").distinct().count() <= 40 < ROWS_PER_CLASS


def test_repeated_ids_stay_within_the_sample(corpus, documents):
    docs, labels, _ = corpus
    i = next(r.id for r in training_rows(docs, labels, "toxic").collect())
    many = docs.unionByName(documents([(i, f"text {k}", "s") for k in range(3000)]))
    rows = training_rows(many, labels, "toxic", rows_per_class=20, recorded="n_chars")
    assert rows.columns == ["id", "text", "recorded", "label"]
    got = rows.collect()
    assert len({r.id for r in got}) == len(got) <= 40
    assert sorted(map(repr, rows.repartition(7).collect())) == sorted(map(repr, got))
    whole = [r.text for r in training_rows(many, labels, "toxic").collect() if r.id == i]
    assert len(whole) == 1


def test_law_of_chance_segments_holds_on_other_texts():
    rng = np.random.default_rng(3)
    scores = lambda: rng.choice([-1.5, -0.5, 0.4, 1.2], p=[0.35, 0.35, 0.2, 0.1], size=300)
    decay = toxicity._decay(np.concatenate([scores() for _ in range(300)]))
    seen = np.sum([toxicity._reached(scores(), decay) for _ in range(1500)], axis=0)
    space = toxicity._space(seen, 1500 * 300)
    again = np.sum([toxicity._reached(scores(), decay) for _ in range(1500)], axis=0)
    want = space * 1500 * 300 * np.exp(-np.array(toxicity.LEVELS, float))
    assert (np.abs(np.log(again[1:4] / want[1:4])) < 0.35).all()


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    model = quality.Model(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, 4)), 0.5, True)
    rows = [(np.sort(rng.choice(quality.SIZE, k, replace=False)), rng.normal(size=k)) for k in (1, 5, 30)]
    for (i, x), margin in zip(rows, model.margins(rows)):
        pairs = sum(model.factors[i[a]] @ model.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert margin == pytest.approx(0.3 + model.weights[i] @ x + pairs)


def test_logistic_fits_a_line():
    x = np.random.default_rng(1).normal(size=(4000, 2))
    y = (x @ [2.0, -1.0] + 0.5 + np.random.default_rng(2).logistic(size=4000) > 0).astype(float)
    assert logistic(x, y) == pytest.approx([2.0, -1.0, 0.5], abs=0.25)


@pytest.mark.parametrize("name, label, least", [("op8_toxicity", "toxic", 0.93), ("op10_quality", "quality", 0.93)])
def test_query(spark, name, label, least):
    sf_dir = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    truth = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", label)
    rows = got.join(truth, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.predicted == r[label] for r in rows) >= least * len(rows)
