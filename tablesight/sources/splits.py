"""Records of text files whose line ends do not say where a record begins, read in splits.

A CSV value in quotes may hold line breaks, and a JSON document may be one line. Spark still hands out such a file in splits,
as pieces that end with a line feed or with ``}``. The pieces of a split are packed into chunks, and each chunk is scanned under
both assumptions about what is open where it begins: a quoted value or not. A chunk is then a function from what was open before to
what is open after it, and running sums over the chunks of a file, one small row each, compose these functions in order. Now
that each chunk knows its beginning, it cuts its own records; only those that reach over its ends are put together by a shuffle.

Chunks are stored before they are numbered, so that lost executors or other splits change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tablesight.functions.storage import store

CHUNK_BYTES = 1 << 20
_CHUNKS = "path string, file_size long, block long, seq int, text binary, bytes long, end_out int, end_in int, depth_out long, depth_in long"
_PARTS = "path string, block long, seq int, part int, first boolean, text binary"
HEAD, WHOLE, TAIL = 0, 1, 2

# What a chunk's text holds: the end of a record begun earlier, whole records, the beginning of one that goes on.
Cut = tuple[bytes | None, list[bytes], bytes | None]


def decoded_path(path: Column) -> Column:
    """A path as it can be read again; Spark reports it encoded like a URL."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def file_path() -> Column:
    """The path of a row's file."""
    return decoded_path(F.col("_metadata.file_path"))


class CsvScan:
    """Where records of quoted values begin. The state is whether a quoted value is open."""

    def __init__(self, sep: str):
        self.opening = re.compile(rb'(?:\A|\n|%b)"' % re.escape(sep.encode()))

    def quoted(self, text: bytes, inside: bool) -> tuple[list[tuple[int, int]], bool]:
        """Begins and ends of the quoted values, and whether the last one stays open."""
        found, at = [], 0
        while True:
            if not inside:
                begin = self.opening.search(text, at)
                if begin is None:
                    return found, False
                at = begin.end()
            end = text.find(b'"', at)
            while end >= 0 and text[end + 1:end + 2] == b'"':  # a doubled quote belongs to the value
                end = text.find(b'"', end + 2)
            if end < 0:
                return found + [(at, len(text))], True
            found.append((at, end))
            at, inside = end + 1, False

    def ends(self, text: bytes) -> tuple[int, int, int, int]:
        if b'"' not in text:
            return 0, 1, 0, 0
        return int(self.quoted(text, False)[1]), int(self.quoted(text, True)[1]), 0, 0

    def cut(self, text: bytes, inside: bool, depth: int, array: bool) -> Cut:
        regions, still_open = self.quoted(text, inside)
        breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
        if regions:
            begins, ends = np.array(regions).T
            k = np.searchsorted(begins, breaks, "right") - 1
            breaks = breaks[(k < 0) | (breaks >= ends[np.maximum(k, 0)])]
        at = [0, *(breaks + 1).tolist(), len(text) + 1]
        lines = [text[a:b - 1] for a, b in zip(at, at[1:])]
        tail = lines.pop() if still_open else None
        if inside:
            return (lines.pop(0), lines, tail) if lines else (tail, [], None)
        return None, lines, tail


class JsonScan:
    """Where the values of a document begin. The state is whether a string is open; the depth counts open brackets."""

    escaped = re.compile(rb"\\.", re.DOTALL)

    def structure(self, text: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """Bytes outside strings (others 0), the change of depth up to each, and the number of quotes."""
        if b"\\" in text:
            text = self.escaped.sub(b"__", text)
        b = np.frombuffer(text, np.uint8)
        quotes = np.cumsum(b == 34)
        outside = (quotes + inside) % 2 == 0
        plain = np.where(outside, b, 0)
        change = np.isin(plain, (91, 123)).astype(np.int64) - np.isin(plain, (93, 125))
        return plain, np.cumsum(change), int(quotes[-1]) if len(quotes) else 0

    def ends(self, text: bytes) -> tuple[int, int, int, int]:
        _, out, quotes = self.structure(text, False)
        _, inside, _ = self.structure(text, True)
        return quotes % 2, 1 - quotes % 2, int(out[-1]) if len(out) else 0, int(inside[-1]) if len(inside) else 0

    def cut(self, text: bytes, inside: bool, depth: int, array: bool) -> Cut:
        """Elements of a document that is an array, else its values themselves."""
        plain, change, _ = self.structure(text, inside)
        level = change + depth
        if array:
            marks = np.flatnonzero(((plain == 44) & (level == 1)) | ((plain == 91) & (level == 1)) | ((plain == 93) & (level == 0)))
            segments, is_open, at = [], depth > 0, 0
            for mark in marks.tolist():
                segments.append(text[at:mark] if is_open else None)
                is_open, at = plain[mark] != 93, mark + 1
            last = text[at:] if is_open else None
        else:
            marks = np.flatnonzero((plain == 125) & (level == 0))
            at = [0, *(marks + 1).tolist()]
            segments = [text[a:b] for a, b in zip(at, at[1:])]
            last = text[at[-1]:] if len(level) and level[-1] > 0 else None
        if depth <= 0:
            return None, [s for s in segments if s], last
        if not segments:
            return text, [], None
        return segments[0], [s for s in segments[1:] if s], last


def _packed(lines: DataFrame, scan: CsvScan | JsonScan, end: bytes, chunk_bytes: int) -> DataFrame:
    """Chunks of consecutive pieces of one split, with what each does to the state."""
    joint, tail = (end, b"") if end == b"\n" else (end, end)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, seq = None, [], 0, 0

        def chunk() -> pa.RecordBatch:
            text = joint.join(held) + tail
            values = [*at, seq, text, len(joint.join(held)) + 1, *scan.ends(text)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _CHUNK_SCHEMA)], schema=_CHUNK_SCHEMA)

        for batch in batches:
            if not batch.num_rows:
                continue
            changes = set()
            for k in (0, 2):
                changes.update(pc.run_end_encode(batch.column(k)).run_ends.to_pylist())
            begin = 0
            for stop in sorted(changes):
                place = tuple(batch.column(k)[begin].as_py() for k in range(3))
                if place != at:
                    if held:
                        yield chunk()
                    at, held, size, seq = place, [], 0, 0
                for value in batch.column(3).slice(begin, stop - begin).to_pylist():
                    held.append(value)
                    size += len(value) + 1
                    if size >= chunk_bytes:
                        yield chunk()
                        held, size, seq = [], 0, seq + 1
                begin = stop
        if held:
            yield chunk()

    return lines.mapInArrow(pack, _CHUNKS)


_CHUNK_SCHEMA = pa.schema([
    ("path", pa.string()), ("file_size", pa.int64()), ("block", pa.int64()), ("seq", pa.int32()), ("text", pa.binary()), ("bytes", pa.int64()),
    ("end_out", pa.int32()), ("end_in", pa.int32()), ("depth_out", pa.int64()), ("depth_in", pa.int64())])


def _beginnings(chunks: DataFrame) -> DataFrame:
    """Per chunk whether a value is open where it begins, how deep it is, and whether its last byte is one too many.

    A chunk either fixes the state, turns it, or leaves it. So the state is that after the last chunk that fixed it (none: nothing open), turned
    as often as chunks turned it since.
    """
    before = W.partitionBy("path").orderBy("block", "seq").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("path").orderBy("block", "seq").rowsBetween(W.unboundedPreceding, 0)
    fixes, turns = F.col("end_out") == F.col("end_in"), F.col("end_out") > F.col("end_in")
    rows = chunks.select("path", "file_size", "block", "seq", "bytes", "end_out", "end_in", "depth_out", "depth_in")
    rows = rows.withColumn("turned", F.coalesce(F.sum(turns.cast("long")).over(upto), F.lit(0)))
    fixed = F.last(F.when(fixes, F.struct("end_out", "turned")), ignorenulls=True).over(before)
    rows = rows.withColumns({"fixed": fixed, "turned_before": F.coalesce(F.max("turned").over(before), F.lit(0)), "surplus": F.sum("bytes").over(upto) > F.col("file_size")})
    state = F.pmod(F.coalesce(F.col("fixed.end_out"), F.lit(0)) + F.col("turned_before") - F.coalesce(F.col("fixed.turned"), F.lit(0)), F.lit(2)) == 1
    rows = rows.withColumn("inside", state)
    rows = rows.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside"), F.col("depth_in")).otherwise(F.col("depth_out"))).over(before), F.lit(0)))
    return rows.select("path", "block", "seq", "inside", "depth", "surplus")


def _cut(chunks: DataFrame, scan: CsvScan | JsonScan, arrays: Column) -> DataFrame:
    """Rows ``(path, block, seq, part, first, text)``: whole records, and pieces of those that reach over a chunk's ends."""
    known = store(_beginnings(chunks))
    placed = chunks.select("path", "block", "seq", "text").join(known, ["path", "block", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, block, seq, text, inside, depth, surplus, array = (c[k].as_py() for c in batch.columns)
                text = text[:-1] if surplus and isinstance(scan, JsonScan) else text
                begins = block == 0 and seq == 0
                if begins:
                    text = text.removeprefix(b"\xef\xbb\xbf").lstrip(b"\r\n")
                head, whole, tail = scan.cut(text, inside, depth, array)
                texts = [*([head] if head is not None else []), *whole, *([tail] if tail is not None else [])]
                parts = [HEAD] * (head is not None) + [WHOLE] * len(whole) + [TAIL] * (tail is not None)
                first = np.zeros(len(texts), bool)
                first[:1] = begins
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(texts), pa.string()), pa.array(np.full(len(texts), block)), pa.array(np.full(len(texts), seq, np.int32)),
                     pa.array(parts, pa.int32()), pa.array(first), pa.array(texts, pa.binary())], names=["path", "block", "seq", "part", "first", "text"])

    return placed.select("path", "block", "seq", "text", "inside", "depth", "surplus", arrays.alias("array")).mapInArrow(run, _PARTS)


def _records(parts: DataFrame, joint: str) -> DataFrame:
    """Rows ``(path, first, value)``, one per record; pieces of a record are joined in their order."""
    stored = store(parts.where(F.col("part") != WHOLE))
    order = W.partitionBy("path").orderBy("block", "seq", "part")
    owner = stored.select("path", "block", "seq", "part", F.sum((F.col("part") == TAIL).cast("long")).over(order).alias("record"))
    pieces = stored.join(owner, ["path", "block", "seq", "part"]).groupBy("path", "record").agg(
        F.bool_or("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "seq", "part", F.col("text").cast("string").alias("text")))).alias("pieces"))
    joined = pieces.select("path", "first", F.array_join(F.transform("pieces", lambda p: p["text"]), joint).alias("value"))
    return parts.where(F.col("part") == WHOLE).select("path", "first", F.col("text").cast("string").alias("value")).unionByName(joined)


def _lines(spark: SparkSession, paths, separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(paths).select(
        file_path().alias("path"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _names(header: str, sep: str) -> list[str]:
    """Names of a header's columns as Spark's reader gives them: empty ones numbered, repeated ones with their place."""
    import csv

    given = next(csv.reader([header], delimiter=sep), [])
    lower = [g.lower() for g in given]
    return [f"_c{i}" if not g else f"{g}{i}" if lower.count(g.lower()) > 1 else g for i, g in enumerate(given)]


def csv_records(spark: SparkSession, paths: Sequence[str], sep: str, latin: bool, options: Mapping, chunk_bytes: int = CHUNK_BYTES) -> list[DataFrame]:
    """Columns of text of CSV files with line breaks inside quotes: one table for the files of each header."""
    scan = CsvScan(sep)
    chunks = store(_packed(_lines(spark, paths, "\n"), scan, b"\n", chunk_bytes))
    records = store(_records(_cut(chunks, scan, F.lit(False)), "\n").select(
        "path", "first", F.regexp_replace(F.decode(F.col("value").cast("binary"), "ISO-8859-1") if latin else F.col("value"), r"\r$", "").alias("value")))
    # One row per file, no more than the file listing that Spark keeps anyway.
    headers: dict[str, list[str]] = {}
    for r in records.where("first").collect():
        headers.setdefault(r["value"], []).append(r["path"])
    told = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", **{k: str(v) for k, v in options.items()}}
    tables = []
    for header, files in headers.items():
        names = _names(header, sep)
        if not names:
            continue
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        rows = records.where(~F.col("first") & (F.col("value") != ""))
        rows = rows if len(headers) == 1 else rows.where(F.col("path").isin(files))
        tables.append(rows.select(F.from_csv("value", schema, told).alias("_row")).select("_row.*"))
    return tables


def json_records(spark: SparkSession, paths: Sequence[str], arrays: Sequence[str], folder: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write the records of JSON documents to ``folder``, one per line. Of the files in ``arrays`` these are the elements."""
    scan = JsonScan()
    chunks = store(_packed(_lines(spark, paths, "}"), scan, b"}", chunk_bytes))
    is_array = F.col("path").isin(list(arrays)) if len(arrays) < len(paths) else F.lit(True)
    records = _records(_cut(chunks, scan, is_array), "").select(F.trim(F.regexp_replace("value", r"[\r\n]+", " ")).alias("value"))
    records.where(F.col("value") != "").write.text(folder)
