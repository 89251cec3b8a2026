import csv
import io
import json
import random

import pytest
from hypothesis import given, settings, strategies as st

from tablesight.functions.storage import shared_folder
from tablesight.sources import readers, splits
from tablesight.sources.splits import CsvScan, JsonScan, csv_records, json_records


def put_together(scan, pieces, end, joint, array):
    """What the distributed steps do, one piece after the other."""
    inside, depth, open_record, records = False, 0, None, []
    for text in pieces:
        head, whole, tail = scan.cut(text, inside, depth, array)
        if head is not None:
            assert open_record is not None
            open_record = open_record + joint + head
        if whole or tail is not None or (head is not None and not goes_on(scan, text, inside, depth)):
            if open_record is not None:
                records.append(open_record)
                open_record = None
        records += whole
        if tail is not None:
            open_record = tail
        end_out, end_in, depth_out, depth_in = scan.ends(text)
        depth += depth_in if inside else depth_out
        inside = bool(end_in if inside else end_out)
    return records + ([open_record] if open_record is not None else [])


def goes_on(scan, text, inside, depth):
    end_out, end_in, depth_out, depth_in = scan.ends(text)
    return bool(end_in if inside else end_out) if isinstance(scan, CsvScan) else depth + (depth_in if inside else depth_out) > 0


cells = st.text(alphabet='ab",\n é', max_size=6)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(cells, min_size=2, max_size=3), min_size=1, max_size=8), st.integers(1, 5))
def test_csv_chunks_of_any_size_give_the_same_records(rows, lines_each):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    lines = out.getvalue()[:-1].encode().split(b"\n")
    pieces = [b"\n".join(lines[i:i + lines_each]) for i in range(0, len(lines), lines_each)]
    records = put_together(CsvScan(","), pieces, b"\n", b"\n", False)
    assert [next(csv.reader(io.StringIO(r.decode(), newline=""))) for r in records] == rows


values = st.recursive(st.none() | st.integers() | st.text(alphabet='a"\\{}[], \n', max_size=5),
                      lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(alphabet='k"}', max_size=2), v, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=2), values, max_size=3), max_size=6), st.sampled_from([None, 1]), st.integers(1, 4), st.booleans())
def test_json_chunks_of_any_size_give_the_same_elements(rows, indent, each, array):
    text = json.dumps(rows, indent=indent) if array else "\n".join(json.dumps(r, indent=indent) for r in rows) + "\n"
    parts = text.encode().split(b"}")
    parts = [p + b"}" for p in parts[:-1]] + [parts[-1]]
    pieces = [b"".join(parts[i:i + each]) for i in range(0, len(parts), each)]
    records = put_together(JsonScan(), pieces, b"}", b"", array)
    assert [json.loads(r) for r in records if r.strip()] == rows


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "3000")
    yield
    for n, v in zip(names, old):
        spark.conf.set(n, v)


@pytest.mark.parametrize("newline, chunk", [("\n", 40), ("\r\n", 100_000)])
def test_csv_file_in_many_splits(spark, tmp_path, small_splits, newline, chunk):
    rng = random.Random(3)
    rows = [[str(k), rng.choice(["plain", "two\nlines", 'say "hi", then\n\n"go"', "", '""', "x" * 2000 + "\n" * 5]), f"é{k}"] for k in range(60)]
    path = tmp_path / "a.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write("﻿")
        writer = csv.writer(f, lineterminator=newline)
        writer.writerows([["id", "no te", "id"], *rows])
    [df] = csv_records(spark, [str(path)], ",", False, {}, chunk)
    assert df.columns == ["id0", "no te", "id2"]
    plain = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(path))
    assert df.collect() and rows_of(df) == rows_of(plain)
    assert splits._lines(spark, [str(path)], "\n").rdd.getNumPartitions() > 5


def test_csv_files_with_other_headers_and_stray_quotes(spark, tmp_path):
    (tmp_path / "1.csv").write_text('a,b\n1,"x\ny"\n5" disk,"open\n, ""q"""\n"p"q,r\n\n7,8')
    (tmp_path / "2.csv").write_text('b,c\n"1\n2",3\n4\n')
    (tmp_path / "3.csv").write_text('a,b\n')
    got = readers.read_csv(spark, str(tmp_path), infer=False)
    assert sorted((tuple(r[c] for c in "abc") for r in got.collect()), key=repr) == sorted(
        [("1", "x\ny", None), ('5" disk', 'open\n, "q"', None), ('"p"q', "r", None), ("7", "8", None), (None, "1\n2", "3"), (None, "4", None)], key=repr)


def test_empty_and_blank_csv(spark, tmp_path):
    (tmp_path / "1.csv").write_text("")
    (tmp_path / "2.csv").write_text("\n\n")
    assert csv_records(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")], ",", False, {}) == []


@pytest.mark.parametrize("indent, chunk", [(None, 60), (2, 100_000)])
def test_json_documents_in_many_splits(spark, tmp_path, small_splits, indent, chunk):
    rng = random.Random(4)
    rows = [{"id": k, "s": rng.choice(["}{", '"', "\\", "a\nb", "[,]", "é" * 900]), "n": {"l": [k], "m": "},{"}, "e": []} for k in range(60)]
    array, single, sequence = tmp_path / "a.json", tmp_path / "b.json", tmp_path / "c.json"
    array.write_text(json.dumps(rows, indent=indent))
    single.write_text(json.dumps({**rows[0], "id": 1000}, indent=2))
    sequence.write_text("\n".join(json.dumps({**r, "id": r["id"] + 2000}, indent=2) for r in rows[:9]))
    files = [f"file://{p}" for p in (array, single, sequence)]
    folder = f"{shared_folder(spark)}/{tmp_path.name}"
    json_records(spark, files, files[:1], folder, chunk)
    got = {r["id"]: r.asDict(recursive=True) for r in spark.read.json(folder).collect()}
    want = {r["id"]: r for r in [*rows, {**rows[0], "id": 1000}, *({**r, "id": r["id"] + 2000} for r in rows[:9])]}
    assert len(got) == len(want) and all(got[k]["s"] == want[k]["s"] and got[k]["n"]["l"] for k in want)
    plain = spark.read.option("multiLine", True).json(files[0])
    assert rows_of(plain) == rows_of(spark.read.json(folder).where("id < 1000").select(plain.columns))


def test_json_that_is_cut_off_or_empty(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"a": 1},\n {"a": 2')
    (tmp_path / "b.json").write_text("[ ]")
    (tmp_path / "c.json").write_text('[{"a": 3}]')
    df = readers.read_json(spark, str(tmp_path), infer=False)
    assert sorted((r["a"] for r in df.collect()), key=repr) == [1, 3, None]
