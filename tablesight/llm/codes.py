"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned on a bounded sample so that the signs of the rotated vectors, cut at their medians, are balanced
codes that keep neighbours together. The code is cut into parts; vectors that agree in one part meet in a bucket, are compared as
original vectors in double precision, and count as linked from the wanted cosine on. The part length follows the number of
vectors, so that buckets stay small. Parts are added until pairs at the wanted cosine, made from the sample, meet as often as wanted
in the learned codes: a mean that the vectors share makes such pairs differ in more bits than their angle says.

Equal vectors of a label are one class, known by its smallest id and a number of its own: an id may occur with several vectors and labels,
and each of them is a vector by itself, with its own links and component. Defined results: vectors that cannot be used (see ``vectors.usable``), have another
length than most, a null label or a null id link with nothing; repeated rows are copies of each other;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablesight.functions.storage import store
from tablesight.llm.links import components
from tablesight.llm.vectors import SAMPLE, matrix, same_length, sample, usable

COSINE = 0.93
MISS = 0.01  # chance that a pair at the wanted cosine meets in no bucket
BUCKET = 32  # vectors of a label per bucket, on average
BLOCK = 2_048  # vectors of one side of a block
ROUNDS = 30
PAIRS = 4_000  # made at the wanted cosine to measure how often they meet


@dataclass
class Codes:
    """Rotations with their medians, and the length of the parts that bits are cut into."""
    mean: np.ndarray
    rotations: list[np.ndarray]
    medians: list[np.ndarray]
    width: int
    parts: int

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """One number per vector and part."""
        bits = np.hstack([np.zeros((len(unit), 0), bool), *((unit - self.mean) @ r > m for r, m in zip(self.rotations, self.medians))])
        bits = bits[:, :self.width * self.parts].reshape(len(unit), self.parts, self.width)
        return bits @ (1 << np.arange(self.width, dtype=np.int64))


def pairs_at(unit: np.ndarray, cosine: float, random: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sampled vectors with the same turned to the wanted cosine: once towards other sampled vectors, once in any direction."""
    made = []
    for towards in (unit[random.integers(0, len(unit), PAIRS)], random.normal(size=(PAIRS, unit.shape[1]))):
        one = unit[random.integers(0, len(unit), PAIRS)]
        across = towards - (towards * one).sum(1, keepdims=True) * one
        length = np.linalg.norm(across, axis=1)
        one, across = one[length > 1e-6], (across / np.maximum(length, 1e-6)[:, None])[length > 1e-6]
        if len(one):
            made.append((one, cosine * one + math.sqrt(1 - cosine * cosine) * across))
    return made


def parts_for(meet: float, miss: float) -> int:
    """How many parts leave a chance of ``miss``, when a pair meets in each with the chance ``meet``."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-meet))) if meet < 1 else 1


def learn(unit: np.ndarray, most: int, cosine: float = COSINE, miss: float = MISS) -> Codes:
    """Codes from a sample of unit vectors, for labels of up to ``most`` vectors.

    Parts are as many as the angle asks for, and more until no kind of made pairs is missed too often. If further bits do not
    help, parts get shorter; without bits all vectors of a label are compared.
    """
    d = unit.shape[1]
    widest = min(max(round(math.log2(max(most, 1) / BUCKET)), 0), 24)
    cosine = min(cosine, 1.0)
    mean = unit.mean(0)
    centred = unit - mean
    random = np.random.default_rng(5)
    _, axes = np.linalg.eigh(centred.T @ centred)
    pairs = pairs_at(unit, cosine, np.random.default_rng(6))
    rotations, medians = [], []
    same = [np.ones((len(one), 0), bool) for one, _ in pairs]

    def more_bits() -> None:
        projected = centred @ axes[:, ::-1]
        turn = np.linalg.qr(random.normal(size=(d, d)))[0]
        for _ in range(ROUNDS):  # signs for the rotation, then the rotation that fits the signs best
            signs = np.where(projected @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ projected)
            turn = (left @ right).T
        rotations.append(axes[:, ::-1] @ turn)
        medians.append(np.median(centred @ rotations[-1], axis=0))
        for i, (one, other) in enumerate(pairs):
            bits, turned = ((x - mean) @ rotations[-1] > medians[-1] for x in (one, other))
            same[i] = np.hstack([same[i], bits == turned])

    def enough(width: int, expected: int) -> int:
        """The number of parts with which pairs meet as often as wanted, 0 if far more than expected do not suffice."""
        least = parts_for((1 - math.acos(cosine) / math.pi) ** width, miss)
        missed = [np.ones(len(one), bool) for one, _ in pairs]
        for parts in range(1, 4 * max(expected, least) + 1):
            while len(rotations) * d < width * parts:
                more_bits()
            for m, s in zip(missed, same):
                m &= ~s[:, width * (parts - 1):width * parts].all(1)
            if parts >= least and max(m.mean() for m in missed) <= miss:
                return parts
        return 0

    if widest and pairs:
        more_bits()
        agree = min(float(s.mean()) for s in same)
        # Shorter parts ask for fewer of them, but their buckets are larger: a row costs about as much as BUCKET comparisons.
        expected = [parts_for(agree ** w, miss) for w in range(widest + 1)]
        width = min(range(widest + 1), key=lambda w: expected[w] * (1 + most / 2 ** w / BUCKET))
        for width in range(width, 0, -1):
            if parts := enough(width, expected[width]):
                used = -(-width * parts // d)
                return Codes(mean, rotations[:used], medians[:used], width, parts)
    return Codes(mean, [], [], 0, 1)


def block_links(unit: np.ndarray, keys: np.ndarray, part: int, sides: np.ndarray, copies: np.ndarray,
                cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Per vector the copies it links with, and a spanning forest of the links.

    A pair that agrees in an earlier part is counted there. With two sides, only pairs across them are compared.
    """
    close = np.triu(unit @ unit.T >= cosine, 1)
    if len(set(sides.tolist())) > 1:
        close &= sides[:, None] != sides[None, :]
    a, b = np.nonzero(close)
    first = ~(keys[a, :part] == keys[b, :part]).any(1)
    a, b = a[first], b[first]
    linked = (np.bincount(a, copies[b], len(unit)) + np.bincount(b, copies[a], len(unit))).astype(np.int64)
    parent = list(range(len(unit)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            forest.append((x, y))
    return linked, forest


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE,
         sample_rows: int = SAMPLE) -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every row: vectors of the same label linked from ``cosine`` on."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    part_of = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    valid = same_length(rows.where(part_of))
    # Stored, so that the numbers stay. Nodes compare by their smallest id first, which names components.
    classes = store(valid.groupBy("label", "vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
                    .withColumn("node", F.struct("least", F.monotonically_increasing_id().alias("number"))).drop("least"))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    unit = sample(classes, "node", rows=sample_rows)
    codes = learn(unit / np.linalg.norm(unit, axis=1, keepdims=True), most, cosine) if len(unit) else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                keys = codes.keys(x / np.linalg.norm(x, axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys.tolist(), pa.list_(pa.int64()))], names=["node", "keys"])

    keyed = store(classes.select(F.struct("label", "node").alias("node"), "vector")
                  .mapInArrow(cut, f"node struct<label:string,node:{NODE}>, keys array<long>").select("node.label", "node.node", "keys"))
    spread = keyed.select("label", "node", F.posexplode("keys").alias("part", "key"))
    buckets = (spread.groupBy("label", "part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
               .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"))
    members = (
        spread.join(buckets, ["label", "part", "key"])
        .withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("label", "node", "part", "key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side"))
    bucket = ["label", "part", "key", "low", "high"]
    blocks = (classes.join(keyed, ["label", "node"]).join(members, ["label", "node"])
              .repartition(*bucket).sortWithinPartitions(*bucket, "node"))

    def solve(at: tuple, held: list[tuple]) -> list[tuple]:
        node, side, copies, keys, x = map(list, zip(*held))
        x = np.array(x)
        n, forest = block_links(x / np.linalg.norm(x, axis=1, keepdims=True), np.array(keys), at[1], np.array(side), np.array(copies, float), cosine)
        return [(at[0], node[i], None, int(n[i])) for i in np.flatnonzero(n)] + [(at[0], node[i], node[j], 0) for i, j in forest]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            found: list[tuple] = []
            columns = [batch.column(k).to_pylist() for k in range(9)]
            x = matrix(batch.column(9))
            for i, row in enumerate(zip(*columns)):
                if row[:5] != at:
                    if len(held) > 1:
                        found += solve(at, held)
                    at, held = row[:5], []
                held.append((*row[5:], x[i]))
            if found:
                yield pa.RecordBatch.from_pylist([dict(zip(("label", "a", "b", "n"), f)) for f in found], LINKS)
        if len(held) > 1 and (found := solve(at, held)):
            yield pa.RecordBatch.from_pylist([dict(zip(("label", "a", "b", "n"), f)) for f in found], LINKS)

    links = store(blocks.select(*bucket, "node", "side", "copies", "keys", "vector").mapInArrow(compare, f"label string, a {NODE}, b {NODE}, n long"))
    named = components(links.where(F.col("b").isNotNull()))
    counts = links.where(F.col("b").isNull()).groupBy("label", F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    known = (classes.join(counts, ["label", "node"], "left").join(named, "node", "left")
             .select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node")["least"].alias("component")))
    return (rows.join(known, ["label", "vector"], "left")
            .select(F.col("id").alias(id_col), F.when(part_of, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
                    F.when(part_of, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))))


NODE = "struct<least:long,number:long>"
_NODE = pa.struct([("least", pa.int64()), ("number", pa.int64())])
LINKS = pa.schema([("label", pa.string()), ("a", _NODE), ("b", _NODE), ("n", pa.int64())])
