"""Token counts through a cache of digests: a text that was counted before, under the same tokenizer, is never encoded again.

A text is known by the SHA-256 of its normalised content, a tokenizer by the SHA-256 of its file and the version of its library.
Counts lie in a folder of Parquet files, one partition per tokenizer. ``count`` joins the digests of all rows to it, encodes one
text of every digest that is missing, appends the new counts, and joins all rows to the result.

Texts move at most once, after equal ones of a task were merged, and only those whose digests miss if these are few. A digest
that holds a large share of the rows is joined by broadcast: of such there are at most ``HOT_SHARE``.

Defined results: a null text is empty and has 0 tokens; invalid UTF-8 is read with replacement characters, any stronger
normalisation would change counts; repeated rows and null ids come back as often as given; an empty table gives no rows;
other columns are ignored. A text without any white space is encoded in one piece, whatever its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesight.functions.storage import store

LIMIT = 1_024
HOT_SHARE = 1_000  # a digest with more than this part of all rows is joined by broadcast
FEW_MISSES = 1_000_000  # up to so many missing digests (32 bytes each) are broadcast to filter texts before they move
WINDOW = 1 << 20  # characters whose chunks are held at once
MEMO = 200_000  # chunks whose counts a task remembers

CACHE = "content binary, n_tokens long"
_CHUNK = re.compile(r"\s*\S+|\s+")
_CUT = re.compile(r"(?<=\S)(?=\s)")
_ONLY_PYTHON_SPACE = re.compile(r"[\x1c-\x1f]")


def tokenizer_digest(path: str) -> str:
    """What counts depend on besides the text: the file of the tokenizer, the library and its version."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library} {version(library)}".encode()).hexdigest()


def splits_at_spaces(tokenizer) -> bool:
    """Whether the count of a text is the sum over its parts, when it is cut before runs of white space.

    So it is where nothing but the byte-level pattern looks at a text first: it never joins a character to white space behind it.
    """
    first = tokenizer.pre_tokenizer
    added = tokenizer.get_added_tokens_decoder().values()
    plain = all(not re.search(r"\s", t.content) and not (t.lstrip or t.rstrip or t.single_word) for t in added)
    return plain and tokenizer.normalizer is None and type(first).__name__ == "ByteLevel" and first.use_regex and not first.add_prefix_space


class Memo(dict):
    """Counts of chunks, each encoded when it is first asked for."""

    def __init__(self, length):
        self.length = length

    def __missing__(self, chunk: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[chunk] = n = self.length(chunk)
        return n


class Counter:
    """Counts tokens as the library of a tokenizer's file does, without begin, end and added special tokens."""

    def __init__(self, path: str):
        self.by_chunk = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.length = lambda text: len(model.encode(text))
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.by_chunk = splits_at_spaces(model)
            self.length = lambda text: len(model.encode(text, add_special_tokens=False))
        self.memo = Memo(self.length)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_chunk or _ONLY_PYTHON_SPACE.search(text):
            return self.length(text)
        n, start = 0, 0
        while start < len(text):
            cut = _CUT.search(text, start + WINDOW) if len(text) - start > WINDOW else None
            end = cut.start() if cut else len(text)
            n += sum(map(self.memo.__getitem__, _CHUNK.findall(text, start, end)))
            start = end
        return n


def cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """Stored ``(content, n_tokens)`` of a tokenizer. Runs at the same time may store a digest twice, with equal counts."""
    folder = f"{cache}/tokenizer={tokenizer}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(folder).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count(docs: DataFrame, tokenizer_path: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row. ``cache`` is a folder that all executors reach; it is made where missing."""
    spark = docs.sparkSession
    tokenizer = tokenizer_digest(tokenizer_path)
    texts = docs.select(F.col(id_col).alias("id"), F.make_valid_utf8(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    texts = texts.withColumn("content", F.unhex(F.sha2("text", 256)))
    keys = store(texts.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "content"))
    found = store(keys.groupBy("content").agg(F.count(F.lit(1)).alias("rows")))
    misses = store(found.select("content").join(cached(spark, cache, tokenizer), "content", "left_anti"))
    n_misses = misses.count()

    if n_misses:
        few = n_misses <= FEW_MISSES
        wanted = texts.join(F.broadcast(misses), "content", "left_semi") if few else texts
        one_each = wanted.groupBy("content").agg(F.first("text").alias("text"))
        if not few:
            one_each = one_each.join(misses, "content", "left_semi")

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter = Counter(tokenizer_path)
            for batch in batches:
                n = [counter.count(text.as_py()) for text in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["content", "n_tokens"])

        one_each.mapInArrow(encode, CACHE).write.mode("append").parquet(f"{cache}/tokenizer={tokenizer}")

    known = found.join(cached(spark, cache, tokenizer), "content")
    total = keys.count()
    hot = known.where(F.col("rows") * HOT_SHARE > total).select("content", "n_tokens")
    rest = known.where(F.col("rows") * HOT_SHARE <= total).select("content", "n_tokens")
    # Two inner joins: a hot digest is never a key of a shuffle.
    often = keys.join(F.broadcast(hot), "content")
    seldom = keys.join(F.broadcast(hot.select("content")), "content", "left_anti").join(rest, "content")
    return often.unionByName(seldom).select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
