"""Embeddings of chunks, exact and approximate nearest neighbours, and the context they make."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablesight.functions.nulls import col
from tablesight.functions.storage import store
from tablesight.functions.text import NOT_SPACE, words
from tablesight.operators import hashing

K = 5
SEED = 7
# Questions up to this many bytes of vectors go to every executor; more are joined block by block.
BROADCAST_BYTES = 32 * 1024 * 1024
BLOCK_ROWS = 4_096
SALTS = 16
QUESTIONS_AT_ONCE = 256
# Share of the true neighbours that an approximate search must find, and what its tables are chosen on.
RECALL = 0.9
SAMPLED_ROWS, SAMPLED_QUESTIONS = 5_000, 128


class TfIdf:
    """Normalised, hashed TF-IDF vectors: an embedding that needs no service.

    It is fitted once on the corpus and then applied to corpus and questions alike. With ``keep`` the corpus' words are split and counted
    once: the counts are stored with the columns named there, and ``embed()`` makes its vectors from them.
    """

    def __init__(self, corpus: DataFrame, text: str = "chunk_text", dimensions: int = 256, keep: Sequence[str] | None = None):
        self.tf = HashingTF(numFeatures=dimensions, inputCol="_words", outputCol="_tf")
        self.unit = Normalizer(inputCol="_idf", outputCol="_unit")
        counts = self._counts(corpus, text)
        self.stored = store(counts.select(*map(col, keep), "_tf")) if keep is not None else None
        self.idf = IDF(inputCol="_tf", outputCol="_idf").fit(counts if self.stored is None else self.stored)

    def _counts(self, df: DataFrame, text: str) -> DataFrame:
        # Whether there are words is asked of the text: a condition on the words would split them once more.
        known = df.where(F.rlike(col(text), F.lit(NOT_SPACE)))
        return self.tf.transform(known.withColumn("_words", words(F.lower(col(text)))))

    def embed(self, df: DataFrame | None = None, text: str = "chunk_text", name: str = "embedding") -> DataFrame:
        """Add a vector per row; rows without words are dropped. Without a table: the corpus, its kept columns from the stored counts."""
        if df is None and self.stored is None:
            raise ValueError("the counts of the corpus were not kept")
        counts = self.stored if df is None else self._counts(df, text)
        vectors = self.unit.transform(self.idf.transform(counts))
        return vectors.withColumn(name, vector_to_array("_unit", "float32")).drop("_words", "_tf", "_idf", "_unit")


def embed(chunks: DataFrame, text: str = "chunk_text", name: str = "embedding", dimensions: int = 256,
          model: Callable[[pd.Series], list] | None = None) -> DataFrame:
    """Add a vector per row; rows that cannot be embedded are dropped.

    A model gets a batch of texts and returns one vector (or None) per text. Without one the vectors are
    ``TfIdf`` fitted on these rows.
    """
    if model is None:
        return TfIdf(chunks, text, dimensions).embed(chunks, text, name)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def score(batch: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else np.asarray(v, dtype="float32").tolist() for v in _scored(model, batch)])

    return chunks.withColumn(name, score(col(text))).where(col(name).isNotNull())


def _scored(model: Callable, batch: pd.Series) -> list:
    """Vectors of a batch; when the batch fails, its texts are tried one by one and the bad ones left out."""
    try:
        return list(model(batch))
    except Exception:  # noqa: BLE001 - any text may be refused
        if len(batch) == 1:
            return [None]
        return [_scored(model, batch.iloc[i:i + 1])[0] for i in range(len(batch))]


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays, in double precision."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def nearest_to(corpus: DataFrame, vector: str, question, key: str, k: int = K) -> DataFrame:
    """The ``k`` rows nearest to one question vector, with ``distance``."""
    literal = F.array(*[F.lit(float(v)) for v in question])
    return corpus.withColumn("distance", squared_distance(col(vector), literal)).orderBy(
        "distance", col(key)).limit(k)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return values.reshape(len(flat), -1)


def _candidates(keys: np.ndarray, vectors: np.ndarray, questions: np.ndarray, k: int):
    """Each question's ``k`` nearest rows of one block, ties by key: (question, row, distance).

    A matrix product gives distances up to rounding; whatever lies within rounding of the k-th nearest is
    then measured exactly.
    """
    norms = np.einsum("ij,ij->i", vectors, vectors)
    for start in range(0, len(questions), QUESTIONS_AT_ONCE):
        part = questions[start:start + QUESTIONS_AT_ONCE]
        own = np.einsum("ij,ij->i", part, part)
        rough = norms[None, :] + own[:, None] - 2.0 * (part @ vectors.T)
        slack = 1e-9 * (own + norms.max(initial=0.0)) + 1e-12
        for q, (question, near) in enumerate(zip(part, rough)):
            rows = np.arange(len(near))
            if len(near) > k:
                rows = np.flatnonzero(near <= np.partition(near, k - 1)[k - 1] + slack[q])
            gap = vectors[rows] - question
            exact = np.einsum("ij,ij->i", gap, gap)
            for i in np.lexsort((keys[rows], exact))[:k]:
                yield start + q, keys[rows[i]], float(exact[i])


def knn(corpus: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, query_vector: str,
        k: int = K, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows ``(query_key, key, distance, rank)``: the exact ``k`` nearest rows by squared distance.

    Every task keeps only ``k`` rows per question and batch, so what is shuffled does not depend on the
    length of the corpus' texts or vectors. Ties go to the smaller key.
    """
    queries = queries.where(col(query_vector).isNotNull())
    asked_bytes = _asked_bytes(queries, query_vector)
    out = _result_type(corpus, queries, key, query_key)
    partial = (_knn_broadcast if asked_bytes <= broadcast_bytes else _knn_blocks)(corpus, queries, key, vector, query_key, query_vector, k, out)
    best = W.partitionBy(col(query_key)).orderBy("distance", col(key))
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _asked_bytes(queries: DataFrame, query_vector: str) -> int:
    return queries.agg(F.coalesce(F.sum(F.size(col(query_vector))), F.lit(0)) * 8).first()[0]


def _result_type(corpus: DataFrame, queries: DataFrame, key: str, query_key: str) -> T.StructType:
    return T.StructType([
        T.StructField(query_key, queries.schema[query_key].dataType),
        T.StructField(key, corpus.schema[key].dataType),
        T.StructField("distance", T.DoubleType())])


def _knn_broadcast(corpus, queries, key, vector, query_key, query_vector, k, out) -> DataFrame:
    asked = queries.select(col(query_key), col(query_vector).cast("array<double>").alias("_v")).toArrow()
    question_keys = asked.column(0).to_pylist()
    questions = _matrix(asked.column(1)) if question_keys else np.zeros((0, 1))
    shared = corpus.sparkSession.sparkContext.broadcast((question_keys, questions))
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            if not batch.num_rows or not names:
                continue
            keys = np.asarray(batch.column(0).to_pylist())
            found = list(_candidates(keys, _matrix(batch.column(1)), matrix, k))
            yield pa.RecordBatch.from_pydict({
                query_key: [names[q] for q, _, _ in found], key: [x.item() for _, x, _ in found],
                "distance": [d for _, _, d in found]}, schema=arrow)

    known = corpus.where(col(vector).isNotNull()).select(col(key), col(vector).alias("_v"))
    return known.mapInArrow(run, out)


def _knn_blocks(corpus, queries, key, vector, query_key, query_vector, k, out) -> DataFrame:
    """Both sides packed into blocks; every pair of a question block and a row block is a key of its own."""
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.lit(1)).cast("int")

    def pack(df, k_col, v_col, name):
        n = df.agg(blocks).scalar()
        return (
            df.where(col(v_col).isNotNull())
            .withColumn("_b", F.pmod(F.xxhash64(col(k_col)), n).cast("int"))
            .groupBy("_b").agg(F.collect_list(F.struct(col(k_col).alias("k"), col(v_col).alias("v"))).alias(name))
        )

    asked = pack(queries, query_key, query_vector, "_q")
    rows = pack(corpus, key, vector, "_c").select("_c")
    spread = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), queries.agg(blocks).scalar() - 1)))
    pairs = spread.join(asked, "_b").select("_q", "_c")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_block, c_block in zip(batch.column(0), batch.column(1)):
                q, c = q_block.values, c_block.values
                names = q.field("k").to_pylist()
                keys = np.asarray(c.field("k").to_pylist())
                found = list(_candidates(keys, _matrix(c.field("v")), _matrix(q.field("v")), k))
                yield pa.RecordBatch.from_pydict({
                    query_key: [names[i] for i, _, _ in found], key: [x.item() for _, x, _ in found],
                    "distance": [d for _, _, d in found]}, schema=arrow)

    return pairs.mapInArrow(run, out)


def approximate_knn(corpus: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, query_vector: str,
                    k: int = K, wanted: float = RECALL, broadcast_bytes: int = BROADCAST_BYTES, seed: int = SEED) -> DataFrame:
    """Like ``knn`` but only rows in buckets that a question looks into are compared; see ``hashing``.

    Tables and probes are chosen on a bounded sample so that a share of ``wanted`` of the true neighbours is found; where no choice beats
    comparing all rows, that is done. The buckets of all questions go to every executor while they are small, and rows of
    other buckets are dropped where they are read; else questions and rows meet in an equi-join on table, bucket and a salt that spreads full
    buckets over many tasks. A question with fewer than ``k`` rows found is compared with all rows.
    """
    queries = queries.where(col(query_vector).isNotNull())
    known = corpus.where(col(vector).isNotNull())
    rows = known.count()
    hashes = hashing.tune(_sample(known, key, vector, SAMPLED_ROWS), _sample(queries, query_key, query_vector, SAMPLED_QUESTIONS), k, rows, wanted, seed)
    if hashes is None:
        return knn(corpus, queries, key, vector, query_key, query_vector, k, broadcast_bytes)
    out = _result_type(corpus, queries, key, query_key)
    asked_bytes = queries.count() * len(hashes.directions) * (hashes.probes + 1) * 24 + _asked_bytes(queries, query_vector)
    found = (_probe_broadcast if asked_bytes <= broadcast_bytes else _probe_join)(known, queries, key, vector, query_key, query_vector, k, out, hashes)
    near = store(found.distinct())  # read three times
    enough = near.groupBy(col(query_key)).count().where(F.col("count") >= k).select(col(query_key))
    rest = queries.join(enough, query_key, "left_anti")
    every = near.unionByName(knn(corpus, rest, key, vector, query_key, query_vector, k).drop("rank")).distinct()
    best = W.partitionBy(col(query_key)).orderBy("distance", col(key))
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _sample(df: DataFrame, key: str, vector: str, rows: int) -> np.ndarray:
    """At most ``rows`` vectors, those with the smallest hashes of their keys."""
    taken = df.select(col(vector).cast("array<double>").alias("_v"), F.xxhash64(col(key)).alias("_h")).orderBy("_h").limit(rows).select("_v").toArrow()
    return _matrix(taken.column(0)) if taken.num_rows else np.zeros((0, 1))


def _probe_broadcast(corpus, queries, key, vector, query_key, query_vector, k, out, hashes) -> DataFrame:
    asked = queries.select(col(query_key), col(query_vector).cast("array<double>").alias("_v")).toArrow()
    names, questions = asked.column(0).to_pylist(), _matrix(asked.column(1)) if asked.num_rows else np.zeros((0, 1))
    per_table = []
    for keys in np.moveaxis(hashes.probe_keys(questions), 1, 0) if names else []:
        order = np.argsort(keys, axis=None)
        per_table.append((keys.ravel()[order], order // keys.shape[1]))
    shared = corpus.sparkSession.sparkContext.broadcast((names, questions, per_table))
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, questions, per_table = shared.value
        for batch in batches:
            if not batch.num_rows or not names:
                continue
            vectors = _matrix(batch.column(1))
            pairs = []
            for keys, (probed, question) in zip(hashes.keys(vectors).T, per_table):
                low, high = np.searchsorted(probed, keys, "left"), np.searchsorted(probed, keys, "right")
                hit = np.flatnonzero(high > low)
                n = (high - low)[hit]
                at = np.repeat(low[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
                pairs.append(question[at] * batch.num_rows + np.repeat(hit, n))
            pair = np.unique(np.concatenate(pairs))
            q, r = pair // batch.num_rows, pair % batch.num_rows
            exact = np.concatenate([np.zeros(0), *(((vectors[r[i:i + 65_536]] - questions[q[i:i + 65_536]]) ** 2).sum(1) for i in range(0, len(r), 65_536))])
            row_keys = np.asarray(batch.column(0).to_pylist())[r]
            order = np.lexsort((row_keys, exact, q))
            place = np.arange(len(q)) - np.searchsorted(q[order], q[order], "left")
            kept = order[place < k]
            yield pa.RecordBatch.from_pydict({query_key: [names[i] for i in q[kept].tolist()], key: row_keys[kept].tolist(), "distance": exact[kept].tolist()}, schema=arrow)

    return corpus.select(col(key), col(vector).alias("_v")).mapInArrow(run, out)


def _probe_join(corpus, queries, key, vector, query_key, query_vector, k, out, hashes) -> DataFrame:
    @F.pandas_udf("array<array<long>>")
    def own(batch: pd.Series) -> pd.Series:
        return pd.Series([[[key] for key in keys] for keys in hashes.keys(np.array(batch.tolist())).tolist()] if len(batch) else [], dtype=object)

    @F.pandas_udf("array<array<long>>")
    def probed(batch: pd.Series) -> pd.Series:
        return pd.Series(hashes.probe_keys(np.array(batch.tolist())).tolist() if len(batch) else [], dtype=object)

    def hashed(df, k_col, v_col, keys):
        tables = df.select(col(k_col), col(v_col).cast("array<double>").alias("_v")).select(col(k_col), "_v", F.posexplode(keys("_v")).alias("_table", "_buckets"))
        return tables.withColumn("_bucket", F.explode(F.array_distinct("_buckets"))).drop("_buckets")

    rows = hashed(corpus, key, vector, own).withColumn("_salt", F.pmod(F.xxhash64(col(key)), F.lit(SALTS)).cast("int"))
    asked = hashed(queries, query_key, query_vector, probed).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    place = ["_table", "_bucket", "_salt"]
    both = (
        rows.select(*place, F.lit(0).alias("_asks"), col(key).alias("_key"), F.lit(None).cast(out[0].dataType).alias("_name"), "_v")
        .unionByName(asked.select(*place, F.lit(1).alias("_asks"), F.lit(None).cast(out[1].dataType).alias("_key"), col(query_key).alias("_name"), "_v"))
        .repartition(*place).sortWithinPartitions(*place, "_asks"))
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, names, questions = None, [], [], []

        def found() -> Iterator[tuple]:
            if held and names:
                for start in range(0, len(held), BLOCK_ROWS):  # rows of a bucket in blocks, k per question and block
                    part = held[start:start + BLOCK_ROWS]
                    keys, vectors = np.asarray([x for x, _ in part]), np.array([v for _, v in part])
                    yield from ((names[q], x.item(), d) for q, x, d in _candidates(keys, vectors, np.array(questions), k))

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            names_, keys_, distances = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_pydict({query_key: names_, key: keys_, "distance": distances}, schema=arrow)

        for batch in batches:
            ready: list[tuple] = []
            vectors = _matrix(batch.column(6)) if batch.num_rows else []
            for i, (*where, asks, row_key, name) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)))):
                if where != at:
                    ready += found()
                    at, held, names, questions = where, [], [], []
                if asks:
                    names.append(name)
                    questions.append(vectors[i])
                else:
                    held.append((row_key, vectors[i]))
            yield packed(ready)
        yield packed(list(found()))

    return both.mapInArrow(run, out)


def recall(exact: DataFrame, approximate: DataFrame, query_key: str, key: str) -> DataFrame:
    """One row ``(wanted, found, recall)``: how many exact neighbours the approximate result holds."""
    hits = exact.join(approximate.select(col(query_key), col(key), F.lit(1).alias("_hit")), [query_key, key], "left")
    return hits.agg(F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("found")).withColumn(
        "recall", F.try_divide("found", "wanted"))


def context(neighbours: DataFrame, chunks: DataFrame, query_key: str, key: str, text: str = "chunk_text") -> DataFrame:
    """Rows ``(query_key, context)``: the texts of a question's neighbours, nearest first."""
    texts = neighbours.join(chunks.select(col(key), col(text).alias("_text")), key)
    packed = F.array_sort(F.collect_list(F.struct("rank", "_text")))  # at most k rows per question
    return texts.groupBy(col(query_key)).agg(
        F.array_join(F.transform(packed, lambda e: e["_text"]), "\n\n").alias("context"))


def centroids(df: DataFrame, group: str, vector: str, name: str = "centroid") -> DataFrame:
    """Mean vector of each group."""
    known = df.where(col(vector).isNotNull()).select(col(group), array_to_vector(col(vector).cast("array<double>")).alias("_x"))
    return known.groupBy(col(group)).agg(vector_to_array(Summarizer.mean(F.col("_x"))).alias(name))
