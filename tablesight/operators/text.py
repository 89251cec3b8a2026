"""Documents as text: tables as lines, JSON as text, word chunks, captions, token costs."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablesight.functions.nulls import col
from tablesight.functions.text import file_name, word_count, words

CHUNK_WORDS = 256
CHUNK_OVERLAP = 40
# Tokens per word and prices per token.
TOKENS_PER_WORD = 1.5
INPUT_PRICE = 0.00000015
OUTPUT_PRICE = 0.0000006

_BLOCK_BITS = 16


def table_lines(df: DataFrame, order: str, columns: Sequence[str] | None = None, separator: str = " | ") -> DataFrame:
    """Rows ``(line_no, line)``: each table row as text, its number taken from the ``order`` column.

    Missing values become empty strings. The header is one constant row in front: line -1.
    """
    columns = [c for c in df.columns if not c.startswith("_row")] if columns is None else list(columns)
    cells = [F.coalesce(col(c).cast("string"), F.lit("")) for c in columns]
    rows = df.select(col(order).cast("bigint").alias("line_no"), F.concat_ws(separator, *cells).alias("line"))
    header = df.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("line_no"),
                                             F.lit(separator.join(columns)).alias("line"))
    return header.unionByName(rows)


def row_json(df: DataFrame, columns: Sequence[str] | None = None, pretty: bool = True) -> Column:
    """A row (or some of its columns) as JSON text."""
    columns = df.columns if columns is None else columns
    return F.to_json(F.struct(*[col(c) for c in columns]), {"pretty": "true" if pretty else "false"})


def indented_json(text: Column) -> Column:
    """JSON text laid out over lines with an indent of two; NULL when it is not JSON."""
    @F.pandas_udf("string")
    def lay_out(batch: pd.Series) -> pd.Series:
        return batch.map(_laid_out)

    return lay_out(text)


def _laid_out(text: str | None) -> str | None:
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except (TypeError, ValueError):
        return None


def check_chunking(size: int, overlap: int) -> int:
    """Words from one chunk start to the next."""
    if size > 0 and overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    return size - overlap


def chunk(docs: DataFrame, name: str, text: str, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Rows ``(doc, chunk_id, chunk_no, chunk_text)``: windows of ``size`` words per document.

    A document without words has no chunk. A size of 0 keeps every text whole. Ids hold the document's
    whole name, so documents that differ in folder or extension do not share any.
    """
    step = check_chunking(size, overlap)
    base = docs.select(col(name).cast("string").alias("doc"), col(text).alias("_text"))
    if size <= 0:
        parts = base.select("doc", F.lit(0).alias("chunk_no"), F.col("_text").alias("chunk_text"))
    else:
        split = base.select("doc", words(F.col("_text")).alias("_words"))
        # The chunks are cut inside the row, so the words are not copied once per chunk.
        starts = F.sequence(F.lit(0), F.size("_words") - 1, F.lit(step))
        cut = F.when(F.size("_words") > 0, F.transform(
            starts, lambda s: F.array_join(F.slice("_words", s + 1, F.lit(size)), " ")))
        parts = split.select("doc", F.posexplode(cut).alias("chunk_no", "chunk_text"))
    return parts.select(
        "doc", F.concat_ws("_", "doc", F.col("chunk_no").cast("string")).alias("chunk_id"), "chunk_no", "chunk_text")


def with_offset(lines: DataFrame, order: str, amount: str, doc: Sequence[str] = ()) -> DataFrame:
    """Add ``offset``: the sum of ``amount`` over all earlier rows of the document.

    ``order`` holds whole numbers that are unique in a document. Sums run over blocks of 65,536 numbers and
    over blocks of such blocks, so that no task sorts the rows of a whole document, even if numbers are far apart.
    """
    keys = [col(d) for d in doc]
    large = F.shiftright("_block", _BLOCK_BITS).alias("_large")

    def before(order_by, *partition):
        return W.partitionBy(*keys, *partition).orderBy(order_by).rowsBetween(W.unboundedPreceding, -1)

    def earlier(value, window):
        return F.coalesce(F.sum(value).over(window), F.lit(0))

    base = lines.withColumn("_block", F.shiftright(col(order), _BLOCK_BITS))
    totals = base.groupBy(*keys, "_block").agg(F.sum(col(amount)).alias("_total")).select("*", large)
    sums = totals.groupBy(*keys, "_large").agg(F.sum("_total").alias("_sum"))
    far = sums.select(*keys, "_large", earlier("_sum", before("_large")).alias("_far"))
    near = totals.withColumn("_near", earlier("_total", before("_block", "_large"))).join(far, [*doc, "_large"])
    starts = near.select(*keys, "_block", (F.col("_far") + F.col("_near")).alias("_start"))
    within = base.withColumn("_inner", earlier(col(amount), before(col(order), "_block")))
    return within.join(starts, [*doc, "_block"]).withColumn(
        "offset", F.col("_start") + F.col("_inner")).drop("_block", "_start", "_inner")


def chunk_lines(lines: DataFrame, name: str, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of one long text given as rows ``(line_no, line)``, as ``chunk`` would cut the joined text.

    Each line's words get their position in the whole text and go to the chunks they lie in; a task holds
    one line or one chunk, never the text.
    """
    step = check_chunking(size, overlap)
    counted = lines.select((F.col("line_no") + 1).alias("line_no"), words(F.col("line")).alias("_words"))
    counted = counted.withColumn("_n", F.size("_words").cast("bigint")).where("_n > 0")
    placed = with_offset(counted, "line_no", "_n")
    first = F.greatest(F.lit(0), F.floor((F.col("offset") - size) / step) + 1)
    last = F.floor((F.col("offset") + F.col("_n") - 1) / step)
    begin = lambda c: F.greatest(F.lit(0), c * step - F.col("offset"))
    end = lambda c: F.least(F.col("_n"), c * step + size - F.col("offset"))
    cut = F.transform(F.sequence(first, last), lambda c: F.struct(
        c.alias("chunk_no"),
        F.array_join(F.slice("_words", (begin(c) + 1).cast("int"), (end(c) - begin(c)).cast("int")), " ").alias("_part")))
    pieces = placed.select("offset", F.inline(cut))
    # A chunk holds at most ``size`` words, so at most that many pieces meet in one group.
    joined = pieces.groupBy("chunk_no").agg(F.array_sort(F.collect_list(F.struct("offset", "_part"))).alias("_parts"))
    text = F.array_join(F.transform("_parts", lambda p: p["_part"]), " ")
    return joined.select(
        F.lit(name).alias("doc"),
        F.concat_ws("_", F.lit(name), F.col("chunk_no").cast("string")).alias("chunk_id"),
        F.col("chunk_no").cast("int").alias("chunk_no"), text.alias("chunk_text"))


# Fixed value: an image link in Markdown.
IMAGE_LINK = r"!\[.*?\]\((.*?)\)"


def replace_images(docs: DataFrame, doc: str, text: str, captions: DataFrame) -> DataFrame:
    """Replace image links by their captions from a table ``(image, caption)``.

    An image matches by its path or, failing that, by its file name. The text is cut at its links, each
    piece becomes a row, and the pieces are put together again.
    """
    link = F.regexp_extract_all(col(text), F.lit(IMAGE_LINK), F.lit(1))
    mark = "\u0000"
    plain = F.split(F.regexp_replace(col(text), IMAGE_LINK, mark), mark, -1)
    pieces = docs.select(col(doc), F.posexplode(F.arrays_zip(plain.alias("plain"), link.alias("src"))).alias("i", "p"))
    pieces = pieces.select(col(doc), "i", F.col("p.plain").alias("plain"), F.col("p.src").alias("src"))
    # Captions are unique per image before the join, so pieces never multiply.
    one = captions.groupBy("image").agg(F.min("caption").alias("caption"))
    by_path = one.select(F.col("image").alias("_path"), F.col("caption").alias("_by_path"))
    by_name = one.groupBy(file_name(F.col("image")).alias("_name")).agg(F.min("caption").alias("_by_name"))
    # Pieces without a link carry a NULL key and stay out of the joins' hash partitions.
    found = (
        pieces.join(by_path, F.col("src") == F.col("_path"), "left")
        .join(by_name, file_name(F.col("src")) == F.col("_name"), "left")
    )
    shown = F.when(F.col("src").isNull(), F.lit("")).otherwise(F.coalesce(
        F.concat(F.lit("**Image:** "), F.coalesce("_by_path", "_by_name")),
        F.concat(F.lit("[Image not found: "), F.col("src"), F.lit("]"))))
    parts = found.select(col(doc), "i", F.concat("plain", shown).alias("_part"))
    return parts.groupBy(col(doc)).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "_part"))), lambda p: p["_part"]), "")
        .alias(text))


def token_cost(turns: DataFrame, by: str, role: str, text: str, answer_role: str = "assistant") -> DataFrame:
    """Rows ``(by, input_tokens, output_tokens, total_tokens, cost)`` estimated from word counts."""
    n = word_count(col(text))
    is_answer = F.coalesce(col(role) == answer_role, F.lit(False))
    counted = turns.groupBy(col(by)).agg(
        F.sum(F.when(is_answer, 0).otherwise(n)).alias("_in"), F.sum(F.when(is_answer, n).otherwise(0)).alias("_out"))
    tokens_in, tokens_out = F.col("_in") * TOKENS_PER_WORD, F.col("_out") * TOKENS_PER_WORD
    return counted.select(
        col(by), tokens_in.alias("input_tokens"), tokens_out.alias("output_tokens"),
        (tokens_in + tokens_out).alias("total_tokens"),
        (tokens_in * INPUT_PRICE + tokens_out * OUTPUT_PRICE).alias("cost"))
