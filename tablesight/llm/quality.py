"""Quality of documents by a factorisation machine.

A document is a sparse vector of hashed words, structure statistics and its recorded length. The model scores
it with a weight per feature and low-rank weights for all pairs of features; the pairs take linear time, as their sum is
half the difference between the squared sum and the sum of squares of the factors.

Defined results: a null or empty text has the features of an empty text; a null recorded length counts as the
length of the text; repeated rows repeat their score; without labels of both classes every score is the share of good training labels (0.0
without any); an empty table gives no rows; other columns are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablesight.llm.sampling import ROWS_PER_CLASS, bucket, training_rows

BITS = 16
RANK = 8
EPOCHS = 8
BATCH = 64
RATE = 0.1
DECAY = 1e-5
SEED = 11
KNOWN_WORDS = 500_000
BINS = 8  # one feature per statistic and bin, besides the statistic itself

UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STATISTICS = ("words", "chars", "recorded", "word_length", "distinct", "adjacent", "upper", "digits", "marks", "symbols", "breaks",
              "wide", "lines_distinct", "short_lines", "longest_word", "plain_words")
FIRST_WORD = len(STATISTICS) * (1 + BINS)
SIZE = FIRST_WORD + (1 << BITS)


def statistics(text: str, words: list[str], recorded: int) -> list[float]:
    """Structure statistics, each between 0 and about 1."""
    n, raw = max(len(words), 1), text.encode("utf-8", "surrogatepass")
    size = max(len(raw), 1)

    def share(characters: bytes) -> float:
        return (len(raw) - len(raw.translate(None, characters))) / size

    lines = text.split("\n")
    return [
        math.log1p(len(words)) / 10, math.log1p(len(text)) / 12, math.log1p(max(recorded, 0)) / 12, min(len(text) / n, 20) / 20,
        len(set(words)) / n, sum(map(operator.eq, words, words[1:])) / n, share(UPPER), share(DIGITS) * 4, share(MARKS) * 2,
        share(b"#$%&*!|<>{}[]\\^~=+") * 4, min(1.0, share(b"\n") * 20), (len(raw) - len(text)) / size, len(set(lines)) / len(lines),
        sum(len(x) < 30 for x in lines) / len(lines), min(max(map(len, words), default=0), 60) / 60,
        sum(map(str.isalpha, words)) / n]


def features(text: str, recorded: int | None, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the nonzero features."""
    words = text.split()
    stats = np.array(statistics(text, words, len(text) if recorded is None else recorded))
    missing = [w for w in set(words) if w not in known]
    if len(known) + len(missing) > KNOWN_WORDS:
        known.clear()
        missing = list(set(words))
    for w in missing:
        known[w] = FIRST_WORD + bucket(w.lower(), BITS)
    hashed = np.unique(np.fromiter((known[w] for w in set(words)), np.int64))
    binned = len(STATISTICS) + np.arange(len(STATISTICS)) * BINS + np.clip(stats * BINS, 0, BINS - 1).astype(int)
    return (np.concatenate([np.arange(len(STATISTICS)), binned, hashed]),
            np.concatenate([stats, np.full(len(STATISTICS), 0.3), np.full(len(hashed), 1 / math.sqrt(max(len(hashed), 1)))]))


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    base_rate: float
    fitted: bool

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores before the logistic function, of a batch of sparse rows."""
        starts = np.cumsum([0, *[len(i) for i, _ in rows[:-1]]])
        at, x = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
        vx = self.factors[at] * x[:, None]
        sums, squares = np.add.reduceat(vx, starts), np.add.reduceat(vx * vx, starts)
        return self.bias + np.add.reduceat(self.weights[at] * x, starts) + 0.5 * (sums * sums - squares).sum(1)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows or not self.fitted:
            return np.full(len(rows), self.base_rate)
        return np.concatenate([1 / (1 + np.exp(-np.clip(self.margins(rows[k:k + 256]), -30, 30))) for k in range(0, len(rows), 256)])


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Fit by stochastic gradient descent with a rate per feature. Labels are 0 or 1; both classes weigh alike."""
    random = np.random.default_rng(SEED)
    model = Model(0.0, np.zeros(SIZE, "float32"), random.normal(0, 0.05, (SIZE, RANK)).astype("float32"),
                  float(labels.mean()) if len(labels) else 0.0, len(set(labels.tolist())) == 2)
    if not model.fitted:
        return model
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    seen_w, seen_v = np.full(SIZE, 1e-6, "float32"), np.full((SIZE, RANK), 1e-6, "float32")
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            some = order[k:k + BATCH]
            batch = [rows[i] for i in some]
            counts = np.array([len(i) for i, _ in batch])
            at, x = np.concatenate([i for i, _ in batch]), np.concatenate([v for _, v in batch])
            starts, of = np.concatenate([[0], np.cumsum(counts)[:-1]]), np.repeat(np.arange(len(batch)), counts)
            vx = model.factors[at] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            margin = (model.bias + np.add.reduceat(model.weights[at] * x, starts)
                      + 0.5 * (sums * sums - np.add.reduceat(vx * vx, starts)).sum(1))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[some]) * weight[some] / len(batch)
            step = (error[of] * x).astype("float32")
            unique, inverse = np.unique(at, return_inverse=True)
            gw = np.bincount(inverse, step, len(unique)) + DECAY * model.weights[unique]
            each = step[:, None] * (sums[of] - vx)
            gv = np.stack([np.bincount(inverse, each[:, f], len(unique)) for f in range(RANK)], 1) + DECAY * model.factors[unique]
            seen_w[unique] += gw * gw
            seen_v[unique] += gv * gv
            model.weights[unique] -= RATE * gw / np.sqrt(seen_w[unique])
            model.factors[unique] -= RATE * 0.3 * gv / np.sqrt(seen_v[unique])
            model.bias -= RATE * 0.1 * float(error.sum())
    return model


def _sparse(batch: pa.RecordBatch, text_at: int, recorded_at: int, known: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [features(text.as_py() or "", recorded, known)
            for text, recorded in zip(batch.column(text_at), batch.column(recorded_at).to_pylist())]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        recorded_col: str = "n_chars", rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Fit on a bounded sample of labelled rows; the driver gets the sparse features of these rows only."""
    rows = training_rows(docs, labels, label_col, id_col, text_col, rows_per_class, recorded=recorded_col)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            found = _sparse(batch, 0, 1, known)
            yield pa.RecordBatch.from_arrays([
                batch.column(2), pa.array([i.astype("int32") for i, _ in found], pa.list_(pa.int32())),
                pa.array([x.astype("float32") for _, x in found], pa.list_(pa.float32())), batch.column(3)], names=["label", "i", "x", "place"])

    chosen = rows.select("text", F.col("recorded").cast("long").alias("recorded"), "label", F.xxhash64("id").alias("place"))
    # Rows are learned in the order of a hash, however they are partitioned.
    sample = chosen.mapInArrow(sparse, "label int, i array<int>, x array<float>, place long").toPandas().sort_values("place", kind="stable")
    return train([(np.asarray(i), np.asarray(x)) for i, x in zip(sample["i"], sample["x"])], sample["label"].to_numpy(float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", recorded_col: str = "n_chars") -> DataFrame:
    """``(id, score)`` of every row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.scores(_sparse(batch, 1, 2, known)).astype(float), pa.float64())], names=["id", "score"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(recorded_col).cast("long").alias("r"))
    return chosen.mapInArrow(judge, f"id {chosen.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
