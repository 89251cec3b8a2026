"""Nearest neighbours by inner product, with an adaptive scan of dimensions within inverted lists.

One more dimension makes the largest inner product the smallest distance. Vectors are dealt to lists by
centroids, rotated at random, and scanned in blocks of columns: after each block a hypothesis test on the partial distance
abandons candidates that are too far. What is too far is known before the scan: the sample's own k-th in the lists
that the query probes. Queries that come back with fewer candidates than there are scan all lists again without a limit. Scores are
computed on the original vectors.

Centroids are fitted on a bounded sample, which also shows how many lists a query must probe. Defined results: vectors that cannot be used (see
``vectors.usable``), have another length than most or a null id take no part; repeated rows count once; of equal
vectors the smallest ids are kept, which are all that can be returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablesight.functions.storage import store
from tablesight.llm.vectors import SAMPLE, matrix, same_length, sample, usable

K = 20
LIST_ROWS, MOST_LISTS = 2_048, 1_024
BLOCK_ROWS = 4_096  # candidates of a list that a task holds
COLUMNS = 16  # dimensions that are added before the next test
STRICTNESS = 2.1  # standard deviations that a partial distance must exceed to be abandoned
QUERIES_AT_ONCE = 256
RECALL = 0.98  # share of the sample's neighbours that lie in the probed lists
SEED = 3


@dataclass
class Index:
    centroids: np.ndarray
    rotation: np.ndarray
    largest: float  # squared length
    probes: int
    sample: np.ndarray | None = None
    near: np.ndarray | None = None  # the list of each sampled vector

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """With one more dimension, in which queries are 0 and candidates fill up to the largest length."""
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.largest - (x * x).sum(1), 0))
        return np.hstack([x, more[:, None]])

    def limits(self, x: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
        """Per query, the squared distance within which the sample alone has ``k`` other vectors in the probed lists."""
        probed = np.zeros((len(x), len(self.centroids)), bool)
        np.put_along_axis(probed, order[:, :self.probes], True, axis=1)
        scores = np.where(probed[:, self.near], x @ self.sample.T, -np.inf)
        best = np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)] if scores.shape[1] > k else np.full(len(x), -np.inf)
        own = (x * x).sum(1)
        return np.where(best > -np.inf, np.maximum(own + self.largest - 2 * best, 0) + 1e-9 * (own + self.largest), np.inf)

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        return (self.centroids ** 2).sum(1) - 2 * lifted @ self.centroids.T


def fit(x: np.ndarray, largest: float, rows: int, k: int = K, recall: float = RECALL) -> Index:
    """Centroids by Lloyd's rounds over a sample, and the number of lists that hold ``recall`` of its neighbours."""
    random = np.random.default_rng(SEED)
    d = x.shape[1] + 1
    index = Index(np.zeros((1, d)), np.linalg.qr(random.normal(size=(d, d)))[0], largest, 1)
    lifted = index.lifted(x, False)
    index.sample = x
    lists = int(min(max(rows // LIST_ROWS, 1), MOST_LISTS, len(x)))
    index.centroids = lifted[random.permutation(len(x))[:lists]]
    for _ in range(10):
        near = index.distances(lifted).argmin(1)
        sums = np.zeros_like(index.centroids)
        np.add.at(sums, near, lifted)
        n = np.bincount(near, minlength=lists)
        index.centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], index.centroids)
    near = index.near = index.distances(lifted).argmin(1)
    asked = x[:200]
    scores = asked @ x.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argpartition(-scores, min(k, len(x) - 1) - 1 if len(x) > 1 else 0, axis=1)[:, :min(k, len(x) - 1)]
    place = index.distances(index.lifted(asked, True)).argsort(1).argsort(1)
    needed = np.sort(np.take_along_axis(place, near[best], 1).ravel())
    index.probes = int(needed[min(math.ceil(recall * len(needed)), len(needed) - 1)]) + 1 if len(needed) else 1
    return index


def in_columns(rotated: np.ndarray) -> list[np.ndarray]:
    """Vectors as blocks of columns, each contiguous."""
    return [np.ascontiguousarray(rotated[:, c:c + COLUMNS]) for c in range(0, rotated.shape[1], COLUMNS)]


def scan(query: np.ndarray, blocks: list[np.ndarray], k: int, limit: float = np.inf) -> np.ndarray:
    """Candidates that may be among the ``k`` nearest and within the squared distance ``limit``.

    After each block of columns a candidate is abandoned when its partial distance is too large, by
    ``STRICTNESS``, for a random rotation of a vector within the limit.
    """
    d, end = sum(b.shape[1] for b in blocks), 0
    alive, partial = None, np.zeros(len(blocks[0]))
    for block in blocks:
        begin, end = end, end + block.shape[1]
        difference = (block if alive is None else block[alive]) - query[begin:end]
        partial = partial + np.einsum("ij,ij->i", difference, difference)
        factor = 1.0 if end == d else end / d * (1 + STRICTNESS / math.sqrt(end)) ** 2
        if limit < np.inf:
            stay = np.flatnonzero(partial <= limit * factor * (1 + 1e-9) + 1e-12)
            alive, partial = stay if alive is None else alive[stay], partial[stay]
    alive = np.arange(len(partial)) if alive is None else alive
    if len(alive) > k:
        inside = partial <= np.partition(partial, k - 1)[k - 1] * (1 + 1e-9) + 1e-12
        alive = alive[inside]
    return alive


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
           sample_rows: int = SAMPLE) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` nearest found of every usable row for which ``is_query`` holds."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
                          F.coalesce(is_query, F.lit(False)).alias("asks"))
    valid = store(same_length(rows.where(F.col("id").isNotNull() & usable(F.col("vector")))).dropDuplicates(["id", "vector"]))
    of_equal = W.partitionBy("vector").orderBy("id")
    candidates = valid.withColumn("nth", F.row_number().over(of_equal)).where(F.col("nth") <= k + 1).drop("nth")
    squares = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)
    rows_n, largest = valid.agg(F.count(F.lit(1)), F.max(squares)).first()
    x = sample(valid, "id", rows=sample_rows)
    index = fit(x, largest or 0.0, rows_n, k) if len(x) else None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = index.distances(index.lifted(matrix(batch.column(1)), False)).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64()), batch.column(0), batch.column(1)], names=["list", "id", "vector"])

    dealt = store(candidates.select("id", "vector").mapInArrow(deal, "list long, id long, vector array<double>"))
    counts = np.zeros(len(index.centroids) if index else 1, np.int64)
    for row in dealt.groupBy("list").count().collect():  # one row per list, of which there are at most MOST_LISTS
        counts[row["list"]] = row["count"]
    blocks = -(-counts // BLOCK_ROWS)

    def probe(batches: Iterator[pa.RecordBatch], everywhere: bool = False) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(s, QUERIES_AT_ONCE) for s in range(0, whole.num_rows, QUERIES_AT_ONCE)):
                x = matrix(batch.column(1))
                order = index.distances(index.lifted(x, True)).argsort(1)
                limits = index.limits(x, order, k)
                # Without a limit from the sample, a query goes to more lists while they hold too few candidates.
                enough = np.cumsum(counts[order], axis=1) >= 2 * (k + 1)
                few = np.where(enough.any(1), enough.argmax(1) + 1, order.shape[1])
                n = np.where(limits < np.inf, index.probes, np.maximum(index.probes, few))
                if everywhere:
                    limits, n = np.full(len(x), np.inf), np.full(len(x), order.shape[1])
                rows = [(i, probed, part) for i in range(len(x)) for probed in order[i, :n[i]].tolist() for part in range(blocks[probed])]
                at, lists, parts = (pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ())))
                taken = batch.take(at)
                yield pa.RecordBatch.from_arrays([lists, parts, taken.column(0), taken.column(1), pa.array(limits).take(at)],
                                                 names=["list", "block", "id", "vector", "limit"])

    asking = valid.where("asks").select("id", "vector")
    sizes = F.element_at(F.array(*[F.lit(int(max(b, 1))) for b in blocks]), (F.col("list") + 1).cast("int"))
    held = dealt.withColumn("block", F.pmod(F.xxhash64("id"), sizes).cast("long"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, original, rotated = None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            x = matrix(batch.column(4))
            for i, (probed, block, kind, row_id, limit) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5)))):
                if (probed, block) != at:
                    at, ids, original, rotated = (probed, block), [], [], None
                if kind == 0:
                    ids.append(row_id)
                    original.append(x[i])
                    continue
                if not ids:
                    continue
                if rotated is None:
                    held_ids, plain = np.array(ids), np.array(original)
                    rotated = in_columns(index.lifted(plain, False) @ index.rotation)
                query = (index.lifted(x[i:i + 1], True) @ index.rotation)[0]
                found = scan(query, rotated, k + 1, limit)
                found = found[held_ids[found] != row_id]
                scores = (plain[found] * x[i]).sum(1)
                for j in np.lexsort((held_ids[found], -scores))[:k].tolist():
                    out.append((row_id, int(held_ids[found[j]]), float(scores[j])))
            if out:
                a, b, c = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "id", "score"])

    def scanned(asked: DataFrame, everywhere: bool = False) -> DataFrame:
        queries = asked.mapInArrow(lambda batches: probe(batches, everywhere), "list long, block long, id long, vector array<double>, limit double")
        both = (held.select("list", "block", F.lit(0).alias("kind"), "id", "vector", F.lit(0.0).alias("limit"))
                .unionByName(queries.select("list", "block", F.lit(1).alias("kind"), "id", "vector", "limit"))
                .repartition("list", "block").sortWithinPartitions("list", "block", "kind", "id"))
        found = both.mapInArrow(nearest, "query_id long, id long, score double").dropDuplicates(["query_id", "id", "score"])
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")

    first = store(scanned(asking))
    full = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = store(asking.join(full, "id", "left_anti"))
    if short.isEmpty():
        return first
    again = scanned(short, True)
    return first.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").select(again.columns).unionByName(again)
