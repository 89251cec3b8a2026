"""Toxic passages by maximum-scoring segments of token log-odds.

Training counts the tokens of labelled documents per class, in a table of fixed size, and gives every token
the log-odds of the toxic class with an informative Dirichlet prior. A document is a sequence of scores with
negative expectation on clean text; one pass finds all its maximal segments. The extreme-value law of such scores, its decay fitted on
the scores of clean tokens and its chances per token on the maximal segments of clean training documents, turns a segment
into the number of equally good ones expected by chance, and a logistic fit on the training documents turns the document's
evidence into a probability.

Defined results: a null or empty text is scored like any text without evidence; repeated rows repeat their score;
without labels of both classes every score is the share of toxic training labels (0.0 without any);
an empty table gives no rows; other columns are ignored by ``score`` and kept by ``reject``, which keeps every text that is no likelier toxic than one
without evidence, also where the model has learned too little to tell and scores all alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablesight.functions.storage import store
from tablesight.llm.batches import slices
from tablesight.llm.sampling import ROWS_PER_CLASS, WORD, bucket, logistic, training_rows

BITS = 20
PRIOR = 500.0  # tokens that the prior counts as, spread over the table like the corpus
MARGIN = 0.5  # subtracted from every token, so that clean text falls
STEMS = (5, 7)  # characters of the stems, the features that unknown word forms share
LEVELS = (1, 2, 3, 4, 5)  # at which segments of clean documents are compared with the law, in units of its decay
SIGNIFICANT = 0.01  # expected segments by chance below which a passage is reported
KNOWN_WORDS = 100_000  # words whose scores a task remembers


def features(word: str) -> list[int]:
    """Buckets of a lower-cased word and of its stems."""
    return [bucket(word, BITS), *(bucket(f"^{n}{word[:n]}", BITS) for n in STEMS)]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` in linear time, in order.

    A segment is maximal when no part of it scores more and no longer one with that property holds it. Each
    candidate keeps the running sum at its left and right end; a new one joins the nearest earlier one that starts lower,
    unless that one ends at least as high.
    """
    found: list[list] = []  # start, end, sum at the left, sum at the right
    links: list[int] = []  # of each candidate, the nearest earlier one with a smaller left sum
    total = 0.0
    last = -1
    for i in np.flatnonzero(scores > 0).tolist():
        total += float(scores[last + 1:i].sum()) if i > last + 1 else 0.0
        new = [i, i + 1, total, total + float(scores[i])]
        total, last = new[3], i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = links[j]
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                links.append(j)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:], links[j:]
    return [(start, end, right - left) for start, end, left, right in found]


@dataclass
class Model:
    token_scores: np.ndarray  # one per bucket
    decay: float  # of the chance that a segment reaches a score
    space: float  # of the same law: chances per token
    weights: np.ndarray
    base_rate: float

    def words(self, text: str, known: dict[str, float]) -> np.ndarray:
        """The score of every word: of its form or a stem, whichever says most."""
        words = WORD.findall(text.lower())
        missing = [w for w in set(words) if w not in known]
        if len(known) + len(missing) > KNOWN_WORDS:
            known.clear()
            missing = set(words)
        for w in missing:
            known[w] = self._word(w)
        return np.fromiter(map(known.__getitem__, words), float, len(words)) - MARGIN

    def _word(self, w: str) -> float:
        return max((float(self.token_scores[b]) for b in features(w)), key=abs)

    def evidence(self, scores: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, float, float]]]:
        """Features of a document and its significant segments with their expected number by chance."""
        found = segments(scores)
        n = max(len(scores), 1)
        # log of the number of segments with this score expected in n clean tokens
        chance = np.array([np.log(self.space * n) - self.decay * s for *_, s in found])
        best = -chance.min() if len(chance) else 0.0
        kept = [(a, b, s, float(np.exp(min(e, 50.0)))) for (a, b, s), e in zip(found, chance) if e < np.log(SIGNIFICANT)]
        bits = sum(max(0.0, -e) for e in chance)
        return np.array([np.clip(best, -5, 30) / 10, min(len(kept), 20) / 5, np.log1p(bits) / 3, np.log1p(bits / n)]), kept

    def probability(self, evidence: np.ndarray) -> float:
        if not len(self.weights):
            return self.base_rate
        return float(1 / (1 + np.exp(-np.clip(evidence @ self.weights[:-1] + self.weights[-1], -30, 30))))


def _counts(rows: DataFrame) -> DataFrame:
    """``(bucket, clean, toxic)`` for buckets seen at least twice: at most one row per bucket, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                # A token counts once per document: a line that repeats it is one observation.
                seen = {b for w in set(WORD.findall(text.as_py().lower())) for b in features(w)}
                table[label, list(seen)] += 1
        for label in (0, 1):
            at = np.flatnonzero(table[label])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), label, "int32")), pa.array(table[label, at])],
                                             names=["bucket", "label", "n"])

    return (rows.mapInArrow(count, "bucket long, label int, n long")
            .groupBy("bucket").agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"),
                                   F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"))
            .where(F.col("clean") + F.col("toxic") > 1))


def log_odds(toxic: np.ndarray, clean: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Log-odds of each token with an informative Dirichlet prior, shrunk by its standard error."""
    both = toxic + clean
    alpha = prior * both / max(both.sum(), 1) + 0.3
    nt, nc, a0 = toxic.sum(), clean.sum(), alpha.sum()
    difference = (np.log((toxic + alpha) / (nt + a0 - toxic - alpha)) - np.log((clean + alpha) / (nc + a0 - clean - alpha)))
    error = np.sqrt(1 / (toxic + alpha) + 1 / (clean + alpha))
    z = difference / error
    return np.where(both > 0, difference * np.clip(np.abs(z) - 2.0, 0, 2) / 2, 0.0)


def _decay(scores: np.ndarray) -> float:
    """The positive root of ``mean(exp(x * score)) = 1``."""
    low, high = 0.0, 1.0
    while np.mean(np.exp(np.minimum(high * scores, 50))) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if np.mean(np.exp(np.minimum(middle * scores, 50))) < 1 else (low, middle)
    return max(high, 1e-3)


def _reached(scores: np.ndarray, decay: float) -> list[int]:
    """How many maximal segments reach each of the levels, in units of the decay."""
    found = np.array([s for *_, s in segments(scores)])
    return [int((found * decay >= level).sum()) for level in LEVELS]


def _space(reached: np.ndarray, tokens: int) -> float:
    """Chances per token: segments seen at all levels by those that the law expects there at one chance per token."""
    return float(max(reached.sum(), 1) / (max(tokens, 1) * np.exp(-np.array(LEVELS, float)).sum()))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Fit on a bounded sample of labelled rows; the driver gets counts per bucket and evidence per sampled row."""
    rows = store(training_rows(docs, labels, label_col, id_col, text_col, rows_per_class).select("text", "label"))
    counted = _counts(rows).toPandas()
    table = np.zeros((2, 1 << BITS))
    table[0, counted["bucket"]], table[1, counted["bucket"]] = counted["clean"], counted["toxic"]
    model = Model(log_odds(table[1], table[0]).astype("float32"), 1.0, 1.0, np.array([]), 0.0)
    # The law of chance segments, from the scores of clean training tokens weighted by their counts.
    share = np.maximum(table[0].sum(), 1)
    background = np.repeat(model.token_scores, np.round(table[0] / share * 200_000).astype(int)) - MARGIN
    if len(background) and (background > 0).any() and background.mean() < 0:
        model.decay = _decay(background)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        tokens, reached = 0, np.zeros(len(LEVELS), np.int64)
        for batch in batches:
            for text in batch.column(0):
                scores = model.words(text.as_py(), known)
                tokens += len(scores)
                reached += _reached(scores, model.decay)
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (tokens, *reached.tolist())], names=["tokens", *names])

    names = [f"level_{level}" for level in LEVELS]
    clean = rows.where(F.col("label") == 0).select("text").mapInArrow(survey, ", ".join(f"{c} long" for c in ("tokens", *names)))
    seen = clean.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", *names)]).first()
    if seen["tokens"]:
        model.space = _space(np.array([seen[c] for c in names]), seen["tokens"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            found = [model.evidence(model.words(text.as_py(), known))[0].tolist() for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["label", "x"])

    seen = rows.mapInArrow(gather, "label int, x array<double>").toPandas()
    truth = seen["label"].to_numpy(float)
    if len(truth):
        model.base_rate = float(truth.mean())
    if len(set(truth)) == 2:
        model.weights = logistic(np.array(seen["x"].tolist()), truth)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, passages)`` of every row; passages are word ranges with score and expected number by chance."""
    passage = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("segment_score", pa.float64()), ("expected", pa.float64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in slices(batches, 1):
            found = [model.evidence(model.words(text.as_py() or "", known)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([model.probability(x) for x, _ in found], pa.float64()),
                pa.array([[dict(zip(("first_word", "end_word", "segment_score", "expected"), k)) for k in kept] for _, kept in found], pa.list_(passage)),
            ], names=["id", "score", "passages"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(judge, (
        f"id {chosen.schema['id'].dataType.simpleString()}, score double, "
        "passages array<struct<first_word:long,end_word:long,segment_score:double,expected:double>>")).withColumnRenamed("id", id_col)


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score stays below ``threshold`` or at that of a text without evidence."""
    at = docs.columns.index(text_col)
    nothing = model.probability(model.evidence(np.array([]))[0])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in slices(batches, at):
            scores = [model.probability(model.evidence(model.words(text.as_py() or "", known))[0]) for text in batch.column(at)]
            yield batch.filter(pa.array([p < threshold or p <= nothing for p in scores], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
