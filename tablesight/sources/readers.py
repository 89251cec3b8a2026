"""Tables from files of any supported kind, with types found by content."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablesight.functions.nulls import col, na_tokens_to_null, nan_to_null
from tablesight.functions.storage import shared_folder
from tablesight.operators.typing import ColumnType, apply_types, infer_types
from tablesight.sources.feather import read_feather
from tablesight.sources.splits import csv_records, file_path, json_records
from tablesight.sources.xlsx import read_xlsx

# Characters that Windows code page 1252 has where ISO-8859-1 has control characters.
_C1 = "".join(chr(b) for b in range(0x80, 0xA0))
_CP1252 = "".join(bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(0x80, 0xA0))


def scan_text_files(spark: SparkSession, paths) -> DataFrame:
    """Rows ``(path, utf8, quoted_breaks, returns)`` per text file.

    The files are read as raw lines in splits, so a huge file is checked by many tasks. A line with an
    odd number of quotes means that a quoted value runs over its end; ``returns`` tells of carriage returns within a line.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(file_path().alias("path"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("quoted_breaks"),
        F.bool_or(F.contains(F.regexp_replace("value", r"\r$", ""), F.lit("\r"))).alias("returns"))


# Options under which records are not what ``splits`` takes them for.
_OTHER_RECORDS = {"quote", "escape", "comment", "linesep", "encoding", "charset", "multiline", "header", "mode", "unescapedquotehandling", "schema", "wholetext",
                  "allowcomments", "allowsinglequotes", "columnnameofcorruptrecord", "maxcolumns", "enforceschema", "ignoreleadingwhitespace"}


def _plain(options: Mapping) -> bool:
    return not _OTHER_RECORDS & {k.lower() for k in options}


def _decode_cp1252(df: DataFrame) -> DataFrame:
    """Replace the control characters that a single-byte read leaves by the characters meant."""
    return df.select(*[
        F.translate(col(f.name), _C1, _CP1252).alias(f.name) if isinstance(f.dataType, T.StringType) else col(f.name)
        for f in df.schema
    ])


def _csv(spark: SparkSession, paths, sep: str, multi_line: bool, latin: bool, options: Mapping) -> DataFrame:
    reader = (
        spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
        .option("mode", "PERMISSIVE").option("multiLine", multi_line)
        .option("encoding", "ISO-8859-1" if latin else "UTF-8").options(**options))
    df = reader.csv(paths)
    return _decode_cp1252(df) if latin else df


def read_csv(spark: SparkSession, path, sep: str = ",", infer: bool = True, scan: bool = True,
             types: Sequence[ColumnType] | None = None, **options) -> DataFrame:
    """CSV files with a header: strings first, then missing values, then types by content.

    ``scan`` looks at the files once to find out which are not UTF-8 and which have line breaks inside
    quotes; the records of the latter are found split by split. Only with carriage returns as further line ends, or
    with options that change what a record is, such files are read unsplit. With ``types`` (from ``detect_types``) nothing is inferred.
    """
    kinds: dict[tuple[bool, bool, bool], list[str]] = {}
    if scan:
        # One row per file, no more than the file listing that Spark keeps anyway.
        for r in scan_text_files(spark, path).collect():
            split = bool(r["quoted_breaks"]) and not r["returns"] and _plain(options)
            kinds.setdefault((split, bool(r["quoted_breaks"]), not r["utf8"]), []).append(r["path"])
    parts: list[DataFrame] = []
    for (split, multi_line, latin), files in kinds.items():
        if split:
            tables = csv_records(spark, files, sep, latin, options)
            parts += [_decode_cp1252(t) for t in tables] if latin else tables
        else:
            parts.append(_csv(spark, path if len(kinds) == 1 else files, sep, multi_line, latin, options))
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else _csv(spark, path, sep, False, False, options)
    raw = na_tokens_to_null(raw)
    if types is not None:
        return apply_types(raw, types)
    return infer_types(raw) if infer else raw


# How the first line of a JSON file begins.
_OTHER, _LIST, _BRACE, _OBJECT = range(4)


def scan_json_files(spark: SparkSession, paths) -> DataFrame:
    """Rows ``(path, lines, bad, array, utf8)`` per JSON file: whether it holds one object per line, and how many lines are not.

    A file is a document when it begins with ``[`` or when its lines are no objects of their own but begin one together;
    a single bad line among good ones does not make it a document. Lines are counted in sums of fixed width, per split and then per
    file: a text among them would have every task sort its lines.
    """
    text = spark.read.text(paths).select(
        file_path().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        F.trim(F.regexp_replace("value", r"^\x{FEFF}", "")).alias("value")).where("value != ''")
    is_object = F.startswith("value", F.lit("{")) & F.try_parse_json("value").isNotNull()
    begins = F.when(F.startswith("value", F.lit("[")), _LIST).when(F.col("value") == "{", _BRACE).when(F.startswith("value", F.lit("{")), _OBJECT).otherwise(_OTHER)
    # Numbers of rows rise within a split, so the smallest sum is that of its first line and tells how it begins.
    per_split = text.groupBy("path", "block").agg(
        F.min(F.col("at") * 4 + begins).alias("first"), F.count_if(is_object).alias("good"), F.count_if(~is_object).alias("bad"),
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    found = per_split.groupBy("path").agg(
        F.min_by("first", "block").alias("first"), F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.bool_and("utf8").alias("utf8"))
    first = F.pmod(F.col("first"), F.lit(4))
    whole = first.isin(_LIST, _BRACE) | ((F.col("good") == 0) & (first == _OBJECT))
    return found.select("path", (~whole).alias("lines"), F.when(whole, 0).otherwise(F.col("bad")).alias("bad"), (first == _LIST).alias("array"), "utf8")


def read_json(spark: SparkSession, path, lines: bool | None = None, infer: bool = True, bad_lines: str = "drop", **options) -> DataFrame:
    """JSON files: one object per line, or one document per file, decided file by file when not told.

    A document's elements (or, if it is no array, its values) are found split by split, written one per line and read as lines.
    Lines that are no JSON object are counted in a warning and dropped, or kept as text in the column
    that ``bad_lines`` names.
    """
    def load(paths, as_lines: bool) -> DataFrame:
        if not as_lines:
            return spark.read.options(**options).json(paths, multiLine=True)
        keep = "_bad_line" if bad_lines == "drop" else bad_lines
        raw = spark.read.options(**options).option("columnNameOfCorruptRecord", keep).json(paths)
        if keep not in raw.columns:
            return raw
        # Read again as text: Spark answers no query on nothing but its own column of bad lines.
        told = {**options, "columnNameOfCorruptRecord": keep}
        parsed = spark.read.text(paths).where("trim(value) != ''").select(F.from_json("value", raw.schema, told).alias("_row")).select("_row.*")
        return parsed.where(col(keep).isNull()).drop(keep) if bad_lines == "drop" else parsed

    if lines is None:
        # One row per file, no more than the file listing that Spark keeps anyway.
        found = scan_json_files(spark, path).collect()
        documents = [r["path"] for r in found if not r["lines"]]
        split = [r for r in found if not r["lines"] and r["utf8"]] if _plain(options) else []
        records = [r["path"] for r in found if r["lines"]]
        bad = {r["path"]: r["bad"] for r in found if r["bad"]}
        if bad:
            warnings.warn(f"lines that are no JSON object: {bad}", stacklevel=2)
        parts = [load(p, k) for p, k in ((records, True), (sorted(set(documents) - {r["path"] for r in split}), False)) if p]
        if split:
            folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
            json_records(spark, [r["path"] for r in split], [r["path"] for r in split if r["array"]], folder)
            parts.append(spark.read.options(**options).json(folder))
        if not parts:
            raise ValueError(f"no JSON content in {path}")
        raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    else:
        raw = load(path, lines)
    raw = nan_to_null(raw)
    return infer_types(raw) if infer else raw


def read_parquet(spark: SparkSession, path, nan: str = "null", spread: bool = False, **options) -> DataFrame:
    """Parquet files. ``nan="null"`` reads NaN as missing; ``nan="keep"`` is for files without any, where
    filters on floating point columns then reach the files. ``spread`` see ``spread_rows``.
    """
    raw = spark.read.options(**options).parquet(*([path] if isinstance(path, str) else path))
    raw = spread_rows(raw) if spread else raw
    return nan_to_null(raw) if nan == "null" else raw


# Rows of a task that does costly work per row.
SPREAD_ROWS = 100_000


def spread_rows(scan: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """Give every core some rows, and a task no more than about ``rows``, when a plain read has too few partitions for that.

    Meant for a few large row groups in front of costly per-row work such as parsing pages, whose longest task would grow with the
    table. The rows are counted by the files' footers. A read that already has enough partitions is left as it is: no shuffle.
    """
    wanted = max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // rows))
    return scan if scan.rdd.getNumPartitions() >= wanted else scan.repartition(wanted)


def _tsv(spark, path, **options):
    return read_csv(spark, path, sep="\t", **options)


def _json_lines(spark, path, **options):
    return read_json(spark, path, lines=True, **options)


def _typed(reader: Callable) -> Callable:
    def read(spark, path, infer: bool = True, **options):
        raw = na_tokens_to_null(reader(spark, path, **options))
        return infer_types(raw) if infer else raw
    return read


_XLSX, _FEATHER = _typed(read_xlsx), (lambda spark, path, **o: nan_to_null(read_feather(spark, path, **o)))

READERS: dict[str, Callable[..., DataFrame]] = {
    ".csv": read_csv, ".tsv": _tsv, ".tab": _tsv, ".json": read_json, ".jsonl": _json_lines, ".ndjson": _json_lines,
    ".parquet": read_parquet, ".pq": read_parquet, ".xlsx": _XLSX, ".feather": _FEATHER,
}

# Order in which a context naming several files is searched.
CONTEXT_ORDER = (
    ("df_excel_path", _XLSX), ("df_tsv_path", _tsv), ("df_parquet_path", read_parquet),
    ("df_feather_path", _FEATHER), ("df_json_lines_path", _json_lines), ("df_json_path", read_json),
    ("df_csv_path", read_csv), ("df_path", None),
)


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read a file by its extension."""
    tail = path.rstrip("/").lower()
    for extension, reader in READERS.items():
        if tail.endswith(extension):
            return reader(spark, path, **options)
    raise ValueError(f"unsupported file type: {path}")


def read_context(spark: SparkSession, context: Mapping[str, str], **options) -> DataFrame:
    """Read the first file that a context names, in the fixed order of kinds."""
    for key, reader in CONTEXT_ORDER:
        if context.get(key):
            return (reader or read_any)(spark, context[key], **options)
    raise ValueError("the context names no data file")


def parse_dates(df: DataFrame, threshold: float = 0.6, columns: Sequence[str] = ()) -> DataFrame:
    """Read string columns as dates when enough of their values parse; named columns always."""
    return infer_types(df, date_threshold=threshold, date_columns=list(columns), numeric_threshold=1.0)
