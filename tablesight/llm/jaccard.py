"""Documents that share most of their word n-grams, exactly, by blocked products of the incidence matrix.

A document is the set of digests of its n-grams. Equal sets are one node. Two sets with the wanted similarity must share an
n-gram among the first of both in any common order (rare n-grams first), so only these postings are
shuffled. Every node goes to one cell, that of the most frequent posting around it. In a cell, documents whose
sizes and signatures allow no link are discarded; of the others the whole sets are fetched, the product of document by n-gram
incidence is computed block by block, counts are accumulated, and pairs below the count that their sizes ask for are discarded. Pairs that share
a posting but neither cell nor component are counted and verified at the end, so no link is lost.

Digests have 64 bits. Defined results: null and empty texts have an empty set and link with nothing;
repeated rows are copies of each other; null ids never name a component unless it has no other; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablesight.functions.storage import store
from tablesight.llm.batches import slices
from tablesight.llm.links import components

NGRAM, PERCENT = 4, 85
SKETCH_BITS = 22  # places of the table of approximate n-gram counts; it is broadcast as 4 MB
FILTER_BITS = 24  # of the filter of wanted documents, broadcast as 2 MB
BLOCK_NGRAMS = 300_000  # of one side of a block
KNOWN_WORDS = 100_000
TEXTS_AT_ONCE = 128  # whose words are held as objects
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53,
                 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], "<u8")


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Grams:
    """Digests of word n-grams. Words are cut at ASCII white space; only A-Z are lower-cased."""

    def __init__(self, n: int):
        self.n = n
        self._forget()

    def _forget(self) -> None:
        self.words = _Numbered()
        self.parts = [np.zeros(0, "<u8") for _ in range(self.n)]  # what a word adds to an n-gram, by its place in that

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The sorted set of each text; of fewer words than ``n``, the digest of all of them."""
        for start in range(0, len(texts), TEXTS_AT_ONCE):
            yield from self._some(texts.slice(start, TEXTS_AT_ONCE))

    def _some(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.words) > KNOWN_WORDS:
            self._forget()
        split = [(t.as_py() or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        sizes = np.array([len(words) for words in split], np.int64)
        number = self.words.__getitem__
        ids = np.fromiter((i for words in split for i in map(number, words)), np.int64, int(sizes.sum()))
        if self.words.new:
            digests = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words.new], "<u8")
            self.parts = [np.concatenate([part, _spread(digests + _MIX[k % 8] * np.uint64(k + 1)) * _MIX[(k + 3) % 8]])
                          for k, part in enumerate(self.parts)]
            self.words.new.clear()
        grams = np.zeros(max(len(ids) - self.n + 1, 0), "<u8")
        for k in range(self.n):
            grams += self.parts[k][ids[k:len(grams) + k]]
        grams = _spread(grams)
        found, at = [], 0
        for n in sizes.tolist():
            if n >= self.n:
                found.append(np.unique(grams[at:at + n - self.n + 1]))
            else:
                found.append(np.array([xxhash.xxh3_64_intdigest(self.parts[0][ids[at:at + n]].tobytes(), seed=n)], "<u8")[:n])
            at += n
        return found


class _Numbered(dict):
    """Words by number; a missing one gets the next."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


def needed(n: int, percent: int) -> int:
    """Smallest part of a set of ``n`` that a similar set must share."""
    return (percent * n + 99) // 100


def _node(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _frequent(docs: DataFrame, ngram: int) -> np.ndarray:
    """Approximate order of magnitude of every n-gram's document count, by the digest's place in a fixed table.

    Each task reports places that it met clearly more often than chance explains. The table only orders n-grams; any
    table gives the same links.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, seen = Grams(ngram), set()
        table = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            for found in grams.of(batch.column(0)):
                if len(found) and (node := _node(found)) not in seen:
                    seen.add(node)
                    table[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] += 1
        at = np.flatnonzero(table >= 4 + 3 * table.mean())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at], pa.int64())], names=["place", "n"])

    counted = (docs.select("text").mapInArrow(count, "place long, n long")
               .groupBy("place").agg(F.sum("n").alias("n")).toPandas())
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    levels[counted["place"].to_numpy(np.int64)] = 1 + np.log2(counted["n"].to_numpy(float)).astype(np.uint8)
    return levels


def _sets(docs: DataFrame, ngram: int, percent: int) -> DataFrame:
    """``(doc_id, n, node, signature, first)``: the size and digest of each set, how many of its n-grams fall in each
    range of digests, and its postings: the first n-grams in order of frequency.
    """
    levels = _frequent(docs, ngram)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(ngram)
        for batch in slices(batches, 1):
            sets = list(grams.of(batch.column(1)))
            firsts = []
            for found in sets:
                order = np.lexsort((found, levels[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                firsts.append(found[order[:len(found) - needed(len(found), percent) + 1]].view("<i8"))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([signature(s).tobytes() for s in sets], pa.binary()), pa.array(firsts, pa.list_(pa.int64()))],
                names=["doc_id", "n", "node", "signature", "first"])

    return docs.select("doc_id", "text").mapInArrow(build, "doc_id long, n long, node long, signature binary, first array<long>")


def signature(grams: np.ndarray) -> np.ndarray:
    """Number of n-grams per range of digests, with about four per range. Sets share at most the sum of the smaller numbers."""
    bits = max(3, (len(grams) // 4).bit_length())
    counts = np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    # Beyond a byte, nothing is claimed: 255 everywhere allows any overlap that the other set's numbers allow.
    return (counts if counts.max() < 256 else np.full(1 << bits, 255)).astype("u1")


def _place(doc_id: Column) -> Column:
    """Where a document's id falls in the filter."""
    return F.shiftrightunsigned(F.xxhash64(doc_id), 64 - FILTER_BITS)


def _filter(docs: DataFrame) -> np.ndarray:
    """A bit table of fixed size that holds the ids in ``docs(doc)``; others may pass, which costs time only."""
    words = (docs.select(_place(F.col("doc")).alias("at")).groupBy(F.shiftright("at", 5).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits")).toPandas())
    table = np.zeros(1 << (FILTER_BITS - 5), "<u4")
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def _whole_sets(docs: DataFrame, wanted: DataFrame, ngram: int) -> DataFrame:
    """``(node, grams)`` of the documents ``wanted(doc)`` and perhaps some more, made again from the texts."""
    packed = np.packbits(_filter(wanted))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sent = Grams(ngram), set()
        for batch in slices(batches, 0):
            nodes, out = [], []
            place = batch.column(1).to_numpy()
            for found in grams.of(batch.column(0).filter(pa.array(packed[place >> 3] << (place & 7) & 128 > 0))):
                if len(found) and (node := _node(found)) not in sent:
                    sent.add(node)
                    nodes.append(node)
                    out.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.binary())], names=["node", "grams"])

    return docs.select("text", _place(F.col("doc_id")).alias("place")).mapInArrow(build, "node long, grams binary")


def block_links(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets`` (of different sides, if there are two).

    The product of the incidence matrix with its transpose, one row at a time. Before it, documents whose shared
    n-grams are fewer than their size asks for are discarded, again and again.
    """
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    asked = (percent * size + 99) // 100
    cross = len(set(sides.tolist())) > 1
    while True:
        new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
        run = np.cumsum(new) - 1
        shared = (np.bincount(run) > 1)[run] if len(values) else new
        alive = (np.bincount(owner[shared], minlength=len(sets)) >= asked) & (size > 0)
        keep = shared & alive[owner] if len(values) else shared
        if keep.all():
            break
        values, owner = values[keep], owner[keep]
    if not len(values):
        return []
    starts = np.append(np.flatnonzero(new), len(values))
    lengths = np.diff(starts)
    by_owner = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[by_owner], np.arange(len(sets) + 1))
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for x in np.flatnonzero(alive).tolist():
        runs = run[by_owner[bounds[x]:bounds[x + 1]]]
        n = lengths[runs]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(starts[runs] - (ends - n), n)
        count = np.bincount(owner[at], minlength=len(sets))
        close = 100 * count >= percent * (size[x] + size - count)
        close[:x + 1] = False
        if cross:
            close &= sides != sides[x]
        for y in np.flatnonzero(close & alive).tolist():
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((x, y))
    return links


def may_link(sizes: np.ndarray, sides: np.ndarray, signatures: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each set has another (of the other side, if there are two) that it may link with, by their sizes and signatures."""
    order = np.argsort(sizes, kind="stable")
    cross = len(set(sides.tolist())) > 1
    bits = np.array([len(s).bit_length() for s in signatures])
    may = np.zeros(len(sizes), bool)
    tables = {}
    for b in set(bits.tolist()):  # per length, the sets with that length and, folded, the next
        at = [i for i in order.tolist() if bits[i] in (b, b + 1)]
        rows = np.array([signatures[i] if bits[i] == b else signatures[i].reshape(-1, 2).sum(1) for i in at])
        tables[b] = (np.array(at), rows, sizes[at])
    for x in order.tolist():
        at, rows, n = tables[bits[x]]
        low, high = np.searchsorted(n, [sizes[x], sizes[x] * 100 // percent + 1])
        near = slice(low, high)
        shared = np.minimum(rows[near], signatures[x]).sum(1)
        close = (100 + percent) * shared >= percent * (n[near] + sizes[x])
        close &= at[near] != x
        if cross:
            close &= sides[at[near]] != sides[x]
        if close.any():
            may[x] = True
            may[at[near][close]] = True
    return may


def _members(cells: DataFrame, block: int) -> DataFrame:
    """``cells(node, n, cell, ...)`` of cells with several nodes, each node once for every block it is compared in.

    A cell with more than ``block`` n-grams is cut into parts; each pair of parts is a block ``(cell, low, high)``.
    """
    sizes = cells.groupBy("cell").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("nodes")).where(F.col("nodes") > 1)
    return (
        cells.join(sizes.select("cell", F.ceil(F.col("total") / block).cast("int").alias("parts")), "cell")
        .withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other")).drop("other", "parts"))


def _candidates(members: DataFrame, percent: int) -> DataFrame:
    """``(node)``: those of ``members`` that may link with another one in a block, by signatures."""
    key = ["cell", "low", "high"]

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def passed() -> list[int]:
            if len(held) < 2:
                return []
            node, n, side, sigs = zip(*held)
            may = may_link(np.array(n), np.array(side), [np.frombuffer(s, "u1").astype("i2") for s in sigs], percent)
            return [node[i] for i in np.flatnonzero(may)]

        for batch in batches:
            out: list[int] = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if row[:3] != at:
                    out += passed()
                    at, held = row[:3], []
                held.append(row[3:])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["node"])
        yield pa.RecordBatch.from_arrays([pa.array(passed(), pa.int64())], names=["node"])

    return (members.select(*key, "node", "n", "side", "signature").repartition(*key).sortWithinPartitions(*key)
            .mapInArrow(test, "node long").distinct())


def _links(docs: DataFrame, members: DataFrame, ngram: int, percent: int) -> DataFrame:
    """``(a, b)``: links within each block ``(cell, low, high)`` of ``members(node, doc, cell, low, high, side)``."""
    key = ["cell", "low", "high"]
    blocks = (_whole_sets(docs, members, ngram).join(members.select(*key, "node", "side"), "node")
              .repartition(*key).sortWithinPartitions(*key, "node"))

    def solve(node: list[int], side: list[int], sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
        found = block_links(sets, np.array(side), percent) if len(sets) > 1 else []
        return [node[x] for x, _ in found], [node[y] for _, y in found]

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, node, side, sets, a, b = None, [], [], [], [], []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for k, (cell, low, high, n, s) in enumerate(zip(*columns)):
                if at != (cell, low, high):
                    left, right = solve(node, side, sets)
                    a, b = a + left, b + right
                    at, node, side, sets = (cell, low, high), [], [], []
                if not node or node[-1] != n:
                    node.append(n)
                    side.append(s)
                    sets.append(np.frombuffer(batch.column(5)[k].as_py(), "<u8"))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        left, right = solve(node, side, sets)
        yield pa.RecordBatch.from_arrays([pa.array(a + left, pa.int64()), pa.array(b + right, pa.int64())], names=["a", "b"])

    return blocks.select(*key, "node", "side", "grams").mapInArrow(product, "a long, b long")


def _cells(postings: DataFrame) -> DataFrame:
    """``(node, n, doc, cell)``: the most frequent posting of the nodes that hold the node's own most frequent one."""
    hubs = postings.groupBy("node").agg(F.first("n").alias("n"), F.first("doc").alias("doc"), F.max(F.struct("df", "gram")).alias("hub"))
    hubs = store(hubs.select("node", "n", "doc", "hub", F.col("hub.gram").alias("gram")))
    tops = postings.select("node", "gram").join(hubs.select("node", "hub"), "node").groupBy("gram").agg(F.max("hub").alias("top"))
    return hubs.drop("hub").join(tops, "gram").select("node", "n", "doc", F.col("top.gram").alias("cell"))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """``(id, n_shingles, component_id)`` of every row: its set's size and the smallest id that links reach.

    Two documents link when the intersection of their sets is at least ``percent`` of the union.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = store(_sets(docs, ngram, percent))
    nodes = sets.where(F.col("n") > 0).groupBy("node").agg(
        F.first("n").alias("n"), F.min("doc_id").alias("doc"), F.first("first").alias("first"))
    every = W.partitionBy("gram")
    postings = store(
        nodes.select("node", "doc", "n", F.explode("first").alias("gram"))
        .withColumn("df", F.count(F.lit(1)).over(every)).where(F.col("df") > 1))

    cells = store(_cells(postings))
    signatures = sets.where(F.col("n") > 0).groupBy("node").agg(F.first("signature").alias("signature"))
    alive = store(_candidates(_members(cells.join(signatures, "node"), 4 * BLOCK_NGRAMS), percent))
    links = store(_links(docs, store(_members(cells.join(alive, "node", "left_semi"), BLOCK_NGRAMS)), ngram, percent))
    named = components(links)

    # Pairs that share a posting, but neither cell nor component.
    placed = (
        postings.select("gram", "node", "doc", "n").join(cells.select("node", "cell"), "node")
        .join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
        .withColumn("mixed", (F.min("cell").over(every) != F.max("cell").over(every))
                    & (F.min("component").over(every) != F.max("component").over(every)))
        .where("mixed").select("gram", "node", "doc", "n", "cell", "component"))
    asked = [F.floor((F.col(f"{s}.n") * percent + 99) / 100) for s in "lr"]
    overlap = F.floor(((F.col("l.n") + F.col("r.n")) * percent + 99 + percent) / (100 + percent))
    pairs = store(
        placed.alias("l").join(placed.alias("r"), (F.col("l.gram") == F.col("r.gram")) & (F.col("l.node") < F.col("r.node"))
                               & (F.col("l.cell") != F.col("r.cell")) & (F.col("l.component") != F.col("r.component"))
                               & (F.col("l.n") * 100 >= F.col("r.n") * percent) & (F.col("r.n") * 100 >= F.col("l.n") * percent))
        .groupBy(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
        .agg(F.count(F.lit(1)).alias("common"), F.first(overlap - F.greatest(*asked) + 1).alias("asked"),
             F.first("l.doc").alias("a_doc"), F.first("r.doc").alias("b_doc"))
        .where(F.col("common") >= F.col("asked")))
    if pairs.limit(1).count():
        two = pairs.withColumn("m", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a_doc").alias("doc")),
                                                      F.struct(F.col("b").alias("node"), F.col("b_doc").alias("doc")))))
        pair_members = two.select("m.node", "m.doc", F.col("a").alias("cell"), F.col("b").alias("low"), F.lit(0).alias("high"), F.lit(0).alias("side"))
        more = store(_links(docs, store(pair_members), ngram, percent))
        if more.limit(1).count():
            named = components(links.unionByName(more))

    names = sets.where(F.col("n") > 0).groupBy("node").agg(F.min("doc_id").alias("doc")).join(named, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    names = names.select("node", "component").join(names.groupBy("component").agg(F.min("doc").alias("component_id")), "component")
    return (sets.select("doc_id", "n", "node").join(names.select("node", "component_id"), "node", "left")
            .select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
