"""Excel workbooks: first sheet as a table of strings.

Spark lists the files. A task opens one workbook at a time and streams its sheet, row by row, into batches; only the workbook's shared
strings are held. Where tasks can't open a path themselves, Spark reads the file as one value. A sheet holds at most about a million rows,
which bounds the work per file.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from contextlib import closing
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesight.sources.feather import can_open, files_under, open_file

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Numbers of the built-in date formats.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
_EPOCH, _EPOCH_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)


def _xml(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _strings(book) -> list[str]:
    root = _xml(book, "xl/sharedStrings.xml")
    if root is None:
        return []
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root.iter(f"{_MAIN}si")]


def _date_styles(book) -> list[bool]:
    root = _xml(book, "xl/styles.xml")
    if root is None:
        return []
    custom = {
        int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt")
        if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.IGNORECASE)
    }
    cells = root.find(f"{_MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in cells] if cells is not None else []
    return [i in _DATE_FORMATS or i in custom for i in ids]


def _first_sheet(book) -> tuple[str, bool]:
    root = _xml(book, "xl/workbook.xml")
    sheet = next(root.iter(f"{_MAIN}sheet"))
    rels = _xml(book, "xl/_rels/workbook.xml.rels")
    target = next(r.get("Target") for r in rels if r.get("Id") == sheet.get(f"{_REL}id"))
    properties = root.find(f"{_MAIN}workbookPr")
    is_1904 = properties is not None and properties.get("date1904") in ("1", "true")
    return (target.lstrip("/") if target.startswith("/") else f"xl/{target}"), is_1904


def _number(text: str, as_date: bool, is_1904: bool) -> str:
    value = float(text)
    if as_date:
        moment = (_EPOCH_1904 if is_1904 else _EPOCH) + dt.timedelta(days=value)
        return (moment + dt.timedelta(microseconds=500)).strftime("%Y-%m-%d %H:%M:%S")
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def sheet_rows(source) -> Iterator[list[str | None]]:
    """Rows of the first sheet as text, read as they are asked for; empty cells are None. ``source`` is a path or the file's bytes."""
    with closing(io.BytesIO(source) if isinstance(source, bytes) else open_file(source)) as file, zipfile.ZipFile(file) as book:
        strings, dates = _strings(book), _date_styles(book)
        path, is_1904 = _first_sheet(book)
        with book.open(path) as stream:
            sheet = None
            for event, node in ElementTree.iterparse(stream, ("start", "end")):
                if node.tag == f"{_MAIN}sheetData" and event == "start":
                    sheet = node
                if node.tag != f"{_MAIN}row" or event == "start":
                    continue
                row: list[str | None] = []
                for cell in node.iter(f"{_MAIN}c"):
                    at = _column_index(cell.get("r")) if cell.get("r") else len(row)
                    row.extend([None] * (at + 1 - len(row)))
                    row[at] = _cell(cell, strings, dates, is_1904)
                sheet.clear()  # else the rows read so far stay in it
                yield row


def _cell(cell, strings, dates, is_1904) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    node = cell.find(f"{_MAIN}v")
    if node is None or node.text is None:
        return None
    if kind == "s":
        return strings[int(node.text)]
    if kind == "b":
        return "True" if node.text == "1" else "False"
    if kind == "e":
        return None
    if kind in ("str", "d"):
        return node.text
    style = int(cell.get("s", 0))
    return _number(node.text, style < len(dates) and dates[style], is_1904)


def _names(header: list[str | None]) -> list[str]:
    """Column names of a header row: unnamed ones get a number, repeated ones a suffix."""
    seen: dict[str, int] = {}
    out = []
    for i, h in enumerate(header):
        name = h if h not in (None, "") else f"Unnamed: {i}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(name if n == 0 else f"{name}.{n}")
    return out


def read_xlsx(spark: SparkSession, path) -> DataFrame:
    """All workbooks under a path as strings; columns are the union of their headers."""
    files = files_under(spark, path, "*.xlsx").select("path")
    one = files.first()
    if one is not None and not can_open(one["path"]):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content")
    elif one is not None:
        # One task per workbook: they are listed as rows, not read as splits.
        files = files.repartition(max(min(files.count(), 10_000), 1), "path")
    source = files.columns[0]

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch[source]:
                names = _names(next(sheet_rows(content), []))
                yield pd.DataFrame({"position": range(len(names)), "name": names})

    found = files.mapInPandas(headers, "position int, name string").groupBy("name").agg(
        F.min("position").alias("position")).orderBy("position", "name").collect()
    columns = [r["name"] for r in found]
    if not columns:
        raise ValueError(f"no workbook with a header under {path}")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch[source]:
                lines = sheet_rows(content)
                names = _names(next(lines, []))
                block: list[dict] = []
                for line in lines:
                    if any(v is not None for v in line):
                        block.append(dict(zip(names, line)))
                    if len(block) == 10_000:
                        yield pd.DataFrame(block, columns=columns, dtype=object)
                        block = []
                if block:
                    yield pd.DataFrame(block, columns=columns, dtype=object)

    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    return files.mapInPandas(rows, schema)
