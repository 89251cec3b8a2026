"""Phrases whose words occur together far more often than apart, counted by one FM-index per shard of documents.

Documents are cut into shards of one language and about ``SHARD_WORDS`` words. A shard numbers its words and holds them as one sequence
with a separator between pieces. Its index is the Burrows-Wheeler transform of that sequence and of the reversed one, with contexts as deep
as the longest phrase. A phrase is a pair of intervals, one in each; extending it by a word to the left or right narrows
both at once, and their length is the phrase's count in the shard. Counts are summed across shards.

Phrases grow only from words and word pairs that reach the least count in the whole corpus. Counts travel as blocks: a shard deals
its phrases to buckets by the ids of their words and packs each bucket's into one row of sorted, compressed numbers. One task sums a bucket
and tells each shard which of its own pairs are frequent, and nothing else. So every task holds one shard or one bucket, whose
size is that of a few shards, each phrase of a shard costs a few bytes on the way, and texts are joined only to the phrases that are ranked.

Defined results: a null language is ``und``; null and empty texts hold no words; invalid UTF-8 is read with replacement characters;
repeated rows count as often as they occur, ids are never read; an empty table gives no rows; other columns are ignored. A piece is never cut,
so a shard can exceed its size by one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tablesight.functions.storage import store

SHARD_WORDS = 1_000_000
BUCKET_SHARDS = 4  # a bucket holds the phrases of about so many shards' words: fewer words to a bucket make many small blocks
LEAST = 30
WORDS = 4
COVER = 80  # a phrase goes if a longer one holds this share (in percent) of its occurrences
TOP = 2_000

SHARDS = "shard long, lang string, size long, words array<binary>, counts array<long>, codes binary"
KNOWN = "shard long, ids binary, codes binary"
_ENDS = bytes(0xFF if chr(b) in ".,;:!?\n\v\f\r" else b for b in range(256))  # 0xFF is in no UTF-8 text


class Numbers(dict):
    """Numbers words from one in the order of their first occurrence; zero is the separator."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Shard:
    """Words of documents of one language, as numbers."""

    def __init__(self):
        self.numbers = Numbers({b"\xff": 0})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        words = text.lower().translate(_ENDS).replace(b"\xff", b" \xff ").split()
        if words:
            self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
            self.parts.append(np.zeros(1, np.int32))
            self.size += len(words)

    def row(self, shard: int, lang: str) -> dict | None:
        codes = one_separator(np.concatenate(self.parts)) if self.parts else np.zeros(1, np.int32)
        if len(self.numbers) == 1:
            return None
        counts = np.bincount(codes, minlength=len(self.numbers))[1:]
        return {"shard": shard, "lang": lang, "size": int(counts.sum()), "words": list(self.numbers)[1:], "counts": counts.tolist(), "codes": packed(codes)}


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers below 2^31 as compressed bytes, the high bytes of a column apart from its low ones."""
    table = np.stack(columns).astype(np.int32)
    planes = table.view(np.uint8).reshape(*table.shape, 4).transpose(0, 2, 1)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) + table.shape[0].to_bytes(1, "little") + table.shape[1].to_bytes(8, "little")


def unpacked(data: bytes) -> np.ndarray:
    """The columns of ``packed`` as the rows of a matrix."""
    width, length = data[-9], int.from_bytes(data[-8:], "little")
    planes = np.frombuffer(pa.decompress(data[:-9], 4 * width * length, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, 4, length).transpose(0, 2, 1)).view(np.int32)[:, :, 0]


def one_separator(codes: np.ndarray) -> np.ndarray:
    """The sequence between two separators, with one of them at a time."""
    codes = np.concatenate([[0], codes, [0]]).astype(np.int32)
    return codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]


class Direction:
    """The transform of a sequence: ``symbol[p]`` stands before the context of place ``p``, ``step[p]`` is that symbol's own place.

    Contexts are sorted by as many symbols as a phrase has words, which is all that intervals of phrases need.
    """

    def __init__(self, codes: np.ndarray, depth: int):
        rank = codes.astype(np.int64)
        have = 1
        while have < depth:  # ranks of twice as many symbols
            _, rank = np.unique(rank * (int(rank.max()) + 1) + np.roll(rank, -have), return_inverse=True)
            have *= 2
        self.symbol = codes[np.argsort(rank, kind="stable") - 1]
        self.step = np.empty(len(codes), np.int64)
        self.step[np.argsort(self.symbol, kind="stable")] = np.arange(len(codes))


class Index:
    """Both transforms of a shard, and the pairs of intervals of its phrases."""

    def __init__(self, codes: np.ndarray, depth: int = WORDS):
        self.forward = Direction(codes, depth)
        self.backward = Direction(codes[::-1], depth)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes))])

    def single(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(phrases, start forward, start backward, count)`` of all words."""
        words = np.arange(1, len(self.first) - 1)
        counts = np.diff(self.first)[1:]
        return words[:, None], self.first[1:-1], self.first[1:-1], counts

    def extend(self, found: tuple, left: bool) -> tuple:
        """All phrases that are longer by one word to the left, or to the right, in the same form."""
        phrases, forward, backward, counts = found
        side, start, other = (self.forward, forward, backward) if left else (self.backward, backward, forward)
        total = int(counts.sum())
        if not total:
            return np.zeros((0, phrases.shape[1] + 1), np.int64), *[np.zeros(0, np.int64)] * 3
        begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
        owner = np.repeat(np.arange(len(counts)), counts)
        places = np.arange(total) - begins[owner] + start[owner]
        symbols = side.symbol[places]
        order = np.argsort(owner * len(self.first) + symbols, kind="stable")
        owner, symbols = owner[order], symbols[order]
        run = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (symbols[1:] != symbols[:-1])]))
        longer = np.diff(np.append(run, total))
        whole = symbols[run] != 0
        run, longer = run[whole], longer[whole]
        owner, symbols = owner[run], symbols[run].astype(np.int64)
        # The first place with a symbol leads to the longer phrase; the other interval moves on by the smaller symbols.
        near, far = side.step[places[order[run]]], other[owner] + run - begins[owner]
        grown = np.hstack([symbols[:, None], phrases[owner]] if left else [phrases[owner], symbols[:, None]])
        return (grown, near, far, longer) if left else (grown, far, near, longer)


def keep(found: tuple, chosen: np.ndarray) -> tuple:
    return tuple(x[chosen] for x in found)


class Pairs:
    """The word pairs that reach the least count in the whole corpus."""

    def __init__(self, a: np.ndarray, b: np.ndarray, words: int):
        self.words = words + 1
        self.keys = np.sort(a * self.words + b)

    def hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(a), bool)
        keys = a * self.words + b
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys


def phrases_of(codes: np.ndarray, pairs: Pairs, longest: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(phrases, counts)`` of three words and more, all of whose neighbouring words are among ``pairs``, ordered by their second word."""
    index = Index(codes, longest)
    found = index.extend(index.single(), left=False)
    found = keep(found, pairs.hold(found[0][:, 0], found[0][:, 1]))
    for length in range(3, longest + 1):
        left = length % 2 == 1
        found = index.extend(found, left)
        found = keep(found, pairs.hold(*(found[0][:, :2] if left else found[0][:, -2:]).T))
        yield found[0], found[3]


def blocks(columns: list[np.ndarray], counts: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """Phrases, given by columns of words and ordered by the first, with their counts: dealt to buckets, one block for each."""
    mixed = np.zeros(len(counts), np.uint64)
    for column in columns:
        mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    bucket = (mixed % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    held, data = [], []
    for k, (begin, end) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
        if end > begin:
            rows = order[begin:end]
            held.append(k)
            data.append(packed(np.diff(columns[0][rows], prepend=0), *[c[rows] for c in columns[1:]], counts[rows]))
    return held, data


def gathered(data: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``(columns, ends)`` of all blocks, one after the other."""
    parts = []
    for block in data:
        part = unpacked(block.as_py())
        part[0] = np.cumsum(part[0])
        parts.append(part)
    return np.concatenate(parts, axis=1), np.cumsum([part.shape[1] for part in parts])


def joint(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first.astype(np.int64) << 32 | second


def summed(x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, starts, totals)``: ``order`` brings equal phrases together, and each run of them begins at one of ``starts``."""
    order = np.lexsort((y, x))
    a, b = x[order], y[order]
    starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return order, starts, np.add.reduceat(counts[order], starts, dtype=np.int64)


def shards(docs: DataFrame, text_col: str, lang_col: str, shard_words: int) -> DataFrame:
    """Documents as shards of numbered words."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("size", pa.int64()), ("words", pa.list_(pa.binary())),
                            ("counts", pa.list_(pa.int64())), ("codes", pa.binary())])
        made = TaskContext.get().partitionId() << 32
        open_shards: dict[str, Shard] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = open_shards.setdefault(lang, Shard())
                shard.add(text.as_py())
                if shard.size >= shard_words:
                    if row := open_shards.pop(lang).row(made, lang):
                        yield pa.RecordBatch.from_pylist([row], schema)
                    made += 1
        for lang, shard in open_shards.items():
            if row := shard.row(made, lang):
                yield pa.RecordBatch.from_pylist([row], schema)
            made += 1

    text = F.make_valid_utf8(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("binary")
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), text).mapInArrow(gather, SHARDS)


def with_ids(left: pa.Table, right: pa.Table) -> pa.Table:
    """A shard that keeps only its words with ids, numbered in the order of these; all others become separators."""
    rows = []
    if left.num_rows and right.num_rows:
        place, ids = right.column("place").to_numpy(), right.column("id").to_numpy()
        if ids.max() >= 1 << 31:
            raise ValueError("more than 2^31 frequent words")
        order = np.argsort(ids)
        codes = unpacked(left.column("codes")[0].as_py())[0]
        anew = np.zeros(max(int(codes.max()), int(place.max())) + 1, np.int32)
        anew[place[order]] = np.arange(1, len(place) + 1)
        rows = [{"shard": left.column("shard")[0].as_py(), "ids": packed(np.diff(ids[order], prepend=0)), "codes": packed(one_separator(anew[codes]))}]
    return pa.Table.from_pylist(rows, pa.schema([("shard", pa.int64()), ("ids", pa.binary()), ("codes", pa.binary())]))


def pair_blocks(buckets: int):
    """Counts of all pairs in each shard, by the ids of their words, as rows ``(shard, bucket, data)``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.cumsum(unpacked(batch.column("ids")[k].as_py())[0])
                index = Index(unpacked(batch.column("codes")[k].as_py())[0], 2)
                pairs, _, _, counts = index.extend(index.single(), left=False)
                held, data = blocks(list(ids[pairs.T - 1]), counts, buckets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("shard")[k].as_py()] * len(held), pa.int64()), pa.array(held, pa.int32()), pa.array(data, pa.binary())],
                    names=["shard", "bucket", "data"])

    return each


def frequent_pairs(least: int):
    """Rows ``(x, a)`` of a bucket's frequent pairs, and rows ``(owner, data)`` that tell each shard which of its pairs these are."""

    def count(table: pa.Table) -> pa.Table:
        (first, second, counts), ends = gathered(table.column("data"))
        x = joint(first, second)
        order, starts, totals = summed(x, np.zeros(len(x), np.int64), counts)
        often = np.empty(len(x), bool)
        often[order] = np.repeat(totals >= least, np.diff(np.append(starts, len(x))))
        owners, data = [], []
        for owner, begin, end in zip(table.column("shard").to_pylist(), np.concatenate([[0], ends[:-1]]), ends):
            chosen = begin + np.flatnonzero(often[begin:end])
            if len(chosen):
                owners.append(owner)
                data.append(packed(np.diff(first[chosen], prepend=0), second[chosen]))
        frequent = totals >= least
        x, totals = x[order[starts[frequent]]], totals[frequent]
        none = len(x)
        return pa.Table.from_arrays(
            [pa.array(owners + [None] * none, pa.int64()), pa.array(data + [None] * none, pa.binary()),
             pa.array([None] * len(owners) + x.tolist(), pa.int64()), pa.array([None] * len(owners) + totals.tolist(), pa.int64())],
            names=["owner", "data", "x", "a"])

    return count


def phrase_blocks(buckets: int):
    """Counts of a shard's phrases of three words and more, as rows ``(size, bucket, data)``."""
    schema = pa.schema([("size", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return schema.empty_table()
        ids = np.cumsum(unpacked(left.column("ids")[0].as_py())[0])
        (a, b), _ = gathered(right.column("data"))
        pairs = Pairs(*(np.searchsorted(ids, x) + 1 for x in (a, b)), len(ids))
        tables = []
        for phrases, counts in phrases_of(unpacked(left.column("codes")[0].as_py())[0], pairs):
            a, *rest = ids[phrases.T - 1]
            held, data = blocks([*rest[:2], a, *rest[2:]], counts, buckets)
            tables.append(pa.Table.from_arrays([pa.array([phrases.shape[1]] * len(held), pa.int32()), pa.array(held, pa.int32()), pa.array(data, pa.binary())], schema=schema))
        return pa.concat_tables(tables)

    return each


def frequent_phrases(least: int):
    """Rows ``(size, x, y, a)`` of the frequent phrases of one length in a bucket."""

    def count(table: pa.Table) -> pa.Table:
        (second, third, first, *last, counts), _ = gathered(table.column("data"))
        x, y = joint(first, second), joint(third, last[0] if last else np.int32(0))
        order, starts, totals = summed(x, y, counts)
        frequent = totals >= least
        chosen = order[starts[frequent]]
        return pa.Table.from_arrays([pa.array(np.full(len(chosen), 3 + len(last), np.int32)), pa.array(x[chosen]), pa.array(y[chosen]), pa.array(totals[frequent])],
                                    names=["size", "x", "y", "a"])

    return count


def number_words(held: DataFrame, least: int) -> DataFrame:
    """``(lang, word, total, places, id)`` of the words that occur at least ``least`` times: small ids for frequent words, so that blocks of ids pack well."""
    vocabulary = held.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts"))).select(
        F.struct("shard", (F.col("pos") + 1).alias("place")).alias("place"), "lang", F.col("col.words").alias("word"), F.col("col.counts").alias("count"))
    frequent = store(
        vocabulary.repartition("lang", "word").groupBy("lang", "word").agg(F.sum("count").alias("total"), F.collect_list("place").alias("places"))
        .where(F.col("total") >= least).sortWithinPartitions(F.desc("total")).withColumn("_mono", F.monotonically_increasing_id()))
    part, place = F.shiftright("_mono", 33), F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    parts = (frequent.agg(F.max(part)).first()[0] or 0) + 1
    return frequent.withColumn("id", place * parts + part + 1).drop("_mono")


def count_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                  shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(size, x, y, a)`` of all phrases of two to four words that occur at least ``least`` times, ``(id, lang, word, total)`` of such words, and ``(lang, n)``.

    ``x`` holds the ids of the first two words, ``y`` of the others: the first times 2^32, plus the second, 0 for none.
    """
    held = store(shards(docs, text_col, lang_col, shard_words))
    sizes = held.groupBy("lang").agg(F.sum("size").alias("n"))
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (held.agg(F.sum("size")).first()[0] or 0) // (BUCKET_SHARDS * shard_words) + 1)
    words = number_words(held, least)
    places = words.select(F.explode("places").alias("at"), "id").select(F.col("at.shard").alias("owner"), "at.place", "id")
    known = store(held.select("shard", "codes").groupBy("shard").cogroup(places.groupBy("owner")).applyInArrow(with_ids, KNOWN))

    each = known.mapInArrow(pair_blocks(buckets), "shard long, bucket int, data binary")
    pairs = store(each.groupBy("bucket").applyInArrow(frequent_pairs(least), "owner long, data binary, x long, a long"))
    told = pairs.where(F.col("owner").isNotNull()).select("owner", "data")
    counted = known.groupBy("shard").cogroup(told.groupBy("owner")).applyInArrow(phrase_blocks(buckets), "size int, bucket int, data binary")
    longer = counted.groupBy("size", "bucket").applyInArrow(frequent_phrases(least), "size int, x long, y long, a long")
    two = pairs.where(F.col("x").isNotNull()).select(F.lit(2).alias("size"), "x", F.lit(0).cast("long").alias("y"), "a")
    return store(two.unionByName(longer)), words.select("id", "lang", F.col("word").cast("string").alias("word"), "total"), sizes


def score(phrases: DataFrame, words: DataFrame, cover: int = COVER) -> DataFrame:
    """``(lang, size, x, y, a, l, r, score, left, right)`` of the phrases that no longer one covers.

    ``left`` and ``right`` are the counts of the most frequent extensions by one word; a phrase inside a longer one
    is inside such an extension, which occurs no less often.
    """
    inner = F.expr("shiftleft(x & 4294967295L, 32) + shiftright(y, 32)")  # the second and third word
    fourth = F.expr("y & 4294967295L")
    start = [F.col("x"), F.when(F.col("size") == 3, F.lit(0)).otherwise(F.col("y") - fourth).cast("long").alias("y")]
    rest = [inner.alias("x"), F.shiftleft(fourth, 32).alias("y")]
    longer = phrases.where(F.col("size") > 2)
    right = longer.select(*start, "a").groupBy("x", "y").agg(F.max("a").alias("right"))
    left = longer.select(*rest, "a").groupBy("x", "y").agg(F.max("a").alias("left"))
    covered = F.expr(f"cast(greatest(coalesce(left, 0), coalesce(right, 0)) as decimal(30, 0)) * 100 >= cast(a as decimal(30, 0)) * {cover}")
    free = phrases.join(left, ["x", "y"], "left").join(right, ["x", "y"], "left").where(~covered)

    two = phrases.where(F.col("size") == 2).select("x", F.col("a").alias("total"))
    more = (free.where(F.col("size") > 2).withColumn("end", F.when(F.col("size") == 3, inner).otherwise(F.col("y")))
            .join(two.withColumnRenamed("total", "head"), "x").join(two.withColumnsRenamed({"x": "end", "total": "tail"}), "end").drop("end"))
    three = phrases.where(F.col("size") == 3).drop("size")
    four = (more.where(F.col("size") == 4).withColumns({"start_y": start[1], "rest_x": rest[0], "rest_y": rest[1]})
            .join(three.withColumnsRenamed({"y": "start_y", "a": "start_a"}), ["x", "start_y"])
            .join(three.withColumnsRenamed({"x": "rest_x", "y": "rest_y", "a": "rest_a"}), ["rest_x", "rest_y"]).drop("start_y", "rest_x", "rest_y"))
    every = (free.where(F.col("size") == 2).unionByName(more.where(F.col("size") == 3), allowMissingColumns=True)
             .unionByName(four, allowMissingColumns=True)
             .withColumns({"one": F.shiftright("x", 32), "end": F.expr("CASE size WHEN 2 THEN x & 4294967295L WHEN 3 THEN shiftright(y, 32) ELSE y & 4294967295L END")})
             .join(words.select(F.col("id").alias("one"), "lang", F.col("total").alias("first")), "one")
             .join(words.select(F.col("id").alias("end"), F.col("total").alias("last")), "end"))

    def cut(k: int, l: str, r: str):
        exact = f"(cast(a as decimal(30, 0)) * 2000000) div (cast({l} as decimal(30, 0)) + cast({r} as decimal(30, 0)))"
        return F.struct(F.expr(exact).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))

    lowest = (F.when(F.col("size") == 2, F.array(cut(1, "first", "last")))
              .when(F.col("size") == 3, F.array(cut(1, "first", "tail"), cut(2, "head", "last")))
              .otherwise(F.array(cut(1, "first", "rest_a"), cut(2, "head", "tail"), cut(3, "start_a", "last"))))
    return (every.withColumn("cut", F.array_min(lowest))
            .select("lang", "size", "x", "y", "a", "cut.l", "cut.r", "cut.score", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right")))


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, cover: int = COVER, top: int = TOP,
         shard_words: int = SHARD_WORDS) -> DataFrame:
    """The ``top`` collocations of each language: ``(lang, rank, phrase, a, l, r, n, score, left, right)``."""
    phrases, words, sizes = count_phrases(docs, text_col, lang_col, least, shard_words)
    order = [F.desc("score"), F.desc("a")]
    # The best of each share of a language first, so that no task orders all phrases of one; words are joined only to these and to what ties with them.
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = (score(phrases, words, cover).withColumn("share", F.pmod(F.xxhash64("x", "y"), F.lit(shares)))
            .withColumn("rank", F.rank().over(W.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top))
    ids = F.filter(F.array(F.shiftright("x", 32), F.expr("x & 4294967295L"), F.shiftright("y", 32), F.expr("y & 4294967295L")), lambda i: i > 0)
    named = (best.select("x", "y", F.struct("lang", "share", "a", "l", "r", "score", "left", "right").alias("of"), F.posexplode(ids).alias("at", "id"))
             .join(words.select("id", "word"), "id").groupBy("x", "y")
             .agg(F.first("of").alias("of"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("named"))
             .select("of.*", F.array_join("named.word", " ").alias("phrase")))
    ranked = named
    for group in (["lang", "share"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order, F.asc("phrase")))).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "left", "right")
