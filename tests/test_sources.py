import io
import zipfile

import pyarrow as pa
import pyarrow.feather
import pytest
from conftest import values
from pyspark.sql import functions as F

from tablesight.operators.hooks import chain, first_success, run_sql
from tablesight.sources import catalog, documents, feather, readers, sinks
from tablesight.sources.synthetic import synthetic_sales


def write(path, content, encoding="utf-8"):
    path.write_bytes(content.encode(encoding) if isinstance(content, str) else content)
    return str(path)


def test_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,when,note,amount\n1,2024-01-02,"a ""b"", c",1.5\n2,2024-01-03,NA,\n')
    df = readers.read_any(spark, path)
    assert df.dtypes == [("id", "bigint"), ("when", "timestamp_ntz"), ("note", "string"), ("amount", "double")]
    assert values(df, "id", "note", "amount") == [(1, 'a "b", c', 1.5), (2, None, None)]
    assert readers.read_csv(spark, path, infer=False).dtypes[0] == ("id", "string")


def test_csv_types_are_found_once(spark, tmp_path):
    from tablesight.operators.typing import detect_types

    path = write(tmp_path / "a.csv", "id,v\n1,x\n")
    types = detect_types(readers.read_csv(spark, path, infer=False))
    assert readers.read_csv(spark, path, types=types, scan=False).dtypes == [("id", "bigint"), ("v", "string")]


@pytest.mark.parametrize("encoding, text", [
    ("utf-8", "café €"), ("utf-8-sig", "café €"), ("latin-1", "café ñ"), ("cp1252", "café € “q”")])
def test_encodings(spark, tmp_path, encoding, text):
    path = write(tmp_path / "a.csv", f"name,n\n{text},1\n", encoding)
    df = readers.read_any(spark, path)
    assert df.columns == ["name", "n"] and df.first()["name"] == text


def test_a_folder_of_different_files(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    write(folder / "1.csv", "id,note\n1,plain\n")
    write(folder / "2.csv", "id,note\n2,é\n", "latin-1")
    write(folder / "3.csv", 'id,note\n3,"two\nlines"\n')
    write(folder / "4.csv", 'note,id,more\n"“x\ny”",4,m\n', "cp1252")
    write(folder / "5.csv", "")
    assert values(readers.read_any(spark, str(folder)), "id", "note", "more") == [
        (1, "plain", None), (2, "é", None), (3, "two\nlines", None), (4, "“x\ny”", "m")]


def test_tsv(spark, tmp_path):
    path = write(tmp_path / "a.tsv", "a\tb\n1,5\tx\n")
    assert values(readers.read_any(spark, path)) == [("1,5", "x")]


def test_json(spark, tmp_path):
    lines = write(tmp_path / "l.json", '{"a": 1, "d": "2024-01-02"}\n\n{"a": 2, "b": {"c": 3}}\n')
    array = write(tmp_path / "d.json", '[\n {"a": 1},\n {"a": 2, "z": "x"}\n]')
    single = write(tmp_path / "s.json", '{\n "a": 5\n}')
    assert values(readers.read_any(spark, lines), "a", "b.c") == [(1, None), (2, 3)]
    assert values(readers.read_any(spark, array)) == [(1, None), (2, "x")]
    assert values(readers.read_any(spark, single)) == [(5,)]
    assert values(readers.read_any(spark, write(tmp_path / "x.jsonl", '{"a": 1}\n{"a": 2}\n'))) == [(1,), (2,)]
    folder = tmp_path / "mix.json"
    folder.mkdir()
    write(folder / "1.json", '{"a": 1}\n{"a": 2}')
    write(folder / "2.json", '[{"a": 3}, {"a": 4, "b": true}]')
    assert values(readers.read_any(spark, str(folder)), "a") == [(1,), (2,), (3,), (4,)]


SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>when</t></is></c><c r="E1" t="s"><v>0</v></c></row>
<row r="2"><c r="A2"><v>1</v></c><c r="B2" t="s"><v>2</v></c><c r="C2" s="1"><v>45293.5</v></c><c r="D2" t="b"><v>1</v></c></row>
<row r="3"/>
<row r="4"><c r="A4"><v>2.5</v></c><c r="B4" t="str"><v>calc</v></c><c r="C4" s="2"><v>45294</v></c><c r="D4" t="b"><v>0</v></c><c r="E4" t="e"><v>#N/A</v></c></row>
</sheetData></worksheet>"""


def workbook(path, sheet=SHEET):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="First" sheetId="7" r:id="rId9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId9" Target="worksheets/data.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r></si><si><t>x &amp; y</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts>'
                   '<cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/data.xml", sheet)
    return str(path)


def test_excel(spark, tmp_path):
    df = readers.read_any(spark, workbook(tmp_path / "b.xlsx"))
    assert df.columns == ["id", "name", "when", "Unnamed: 3", "id.1"][:2] + ["when"] + df.columns[3:]
    assert [(r["id"], r["name"], str(r["when"])) for r in df.orderBy("id").collect()] == [
        (1.0, "x & y", "2024-01-02 12:00:00"), (2.5, "calc", "2024-01-03 00:00:00")]


def test_feather(spark, tmp_path):
    table = pa.table({"i": pa.array([1, 2], pa.int32()), "s": pa.array(["a", None]), "f": [1.5, float("nan")], "c": pa.array(["x", "y"]).dictionary_encode()})
    pyarrow.feather.write_feather(table, str(tmp_path / "a.feather"))
    pyarrow.feather.write_feather(table, str(tmp_path / "b.feather"), compression="uncompressed")
    df = readers.read_any(spark, str(tmp_path / "a.feather"))
    assert values(df) == [(1, "a", 1.5, "x"), (2, None, None, "y")]
    assert readers._FEATHER(spark, str(tmp_path)).count() == 4


def test_feather_batches_are_shared_by_tasks(spark, tmp_path):
    df = spark.range(0, 5000, 1, 3).selectExpr("id", "cast(id % 7 AS string) AS s", "id * 0.5 AS f", "CASE WHEN id % 5 > 0 THEN array(id) END AS a")
    feather.write_feather(df, str(tmp_path / "t"))
    feather.write_feather(df, str(tmp_path / "t"))  # again: files are replaced
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == [f"part-0000{k}.feather" for k in range(3)]
    read = feather.read_feather(spark, str(tmp_path / "t"))
    assert read.dtypes == df.dtypes and values(read) == values(df)
    pruned = feather.read_feather(spark, str(tmp_path / "t"), ["f", "id"])
    assert pruned.columns == ["f", "id"] and values(pruned, "id") == values(df, "id")


def test_large_feather_file_is_many_partitions(spark, tmp_path):
    table = pa.table({"i": range(1000)})
    pyarrow.feather.write_feather(table, str(tmp_path / "a.feather"), chunksize=10)
    read = feather.read_feather(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and sorted(r["i"] for r in read.collect()) == list(range(1000))


def test_files_that_only_spark_can_open(spark, tmp_path, monkeypatch):
    from tablesight.sources import xlsx

    pyarrow.feather.write_feather(pa.table({"i": [1, 2], "s": ["a", None]}), str(tmp_path / "a.feather"))
    workbook(tmp_path / "b.xlsx")
    wanted = values(xlsx.read_xlsx(spark, str(tmp_path)))
    for module in (feather, xlsx):
        monkeypatch.setattr(module, "can_open", lambda path: False)
    assert values(feather.read_feather(spark, str(tmp_path), ["s"])) == [("a",), (None,)]
    assert values(xlsx.read_xlsx(spark, str(tmp_path))) == wanted and len(wanted) == 2


def test_sheet_is_streamed():
    from tablesight.sources.xlsx import sheet_rows

    rows = "".join(f'<row><c><v>{k}</v></c></row>' for k in range(50_000))
    file = io.BytesIO()
    workbook(file, f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>')
    assert sum(int(r[0]) for r in sheet_rows(file.getvalue())) == sum(range(50_000))


def test_context_order(spark, tmp_path):
    csv = write(tmp_path / "a.csv", "a\n1\n")
    tsv = write(tmp_path / "a.tsv", "b\n1\n")
    assert readers.read_context(spark, {"df_csv_path": csv, "df_tsv_path": tsv}).columns == ["b"]
    assert readers.read_context(spark, {"df_path": csv}).columns == ["a"]
    with pytest.raises(ValueError):
        readers.read_context(spark, {})
    with pytest.raises(ValueError):
        readers.read_any(spark, "a.pkl")


def test_catalog(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    for name in ("b.csv", "a.xlsx", "report.html", "plotly_index.html", "x.unknown"):
        write(tmp_path / "s1" / name, "abc")
    files = catalog.list_files(spark, str(tmp_path)).withColumn("session", F.lit("s1"))
    assert values(files, "name", "extension", "size")[0] == ("a.xlsx", ".xlsx", 3)
    assert catalog.allowed_uploads(files).count() == 4
    groups = catalog.artifact_groups(files, base_url=" https://h/ ")
    assert dict(values(groups, "name", "kind"))["x.unknown"] == "other"
    assert catalog.preferred_entry(files, ["session"]).first()["preferred_entry"].endswith("plotly_index.html")
    chosen = catalog.choose_dataset(files, ["session"], "path", "name")
    assert chosen.first()["dataset"].endswith("b.csv")


def test_documents(spark, tmp_path):
    write(tmp_path / "a.html", "<p>Hello <b>you</b></p>")
    write(tmp_path / "b.txt", "plain é", "latin-1")
    write(tmp_path / "c.json", '{"k": 1}')
    write(tmp_path / "d.json", "{broken")
    write(tmp_path / "e.md", " \n ")
    write(tmp_path / "f.csv", "not a document")
    docs = documents.read_documents(spark, str(tmp_path))
    (tmp_path / "in here").mkdir()
    write(tmp_path / "in here" / "b.txt", "other")
    docs = documents.read_documents(spark, str(tmp_path))
    named = documents.document_text(docs).withColumn("doc", F.regexp_extract("doc", "([^/]*/[^/]*)$", 1))
    at = tmp_path.name
    assert values(named) == sorted([(f"{at}/a.html", "Hello\nyou"), (f"{at}/b.txt", "plain é"), (f"{at}/c.json", '{\n  "k": 1\n}'), ("in here/b.txt", "other")])
    chunks = documents.chunk_documents(docs)
    assert chunks.select("chunk_id").distinct().count() == 4
    assert documents.chunk_all([chunks, chunks.drop("chunk_no")]).count() == 8


def test_synthetic_table(spark):
    df = synthetic_sales(spark)
    assert df.count() == 500 and df.columns == ["Year", "Category", "Value"]
    row = df.agg(F.min("Year"), F.max("Year"), F.countDistinct("Category"), F.min("Value")).first()
    assert row[0] >= 2015 and row[1] <= 2024 and row[2] == 10 and row[3] >= 0
    assert df.exceptAll(synthetic_sales(spark)).count() == 0
    assert df.exceptAll(synthetic_sales(spark, seed=8)).count() > 400


def test_sinks(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS t, 'a \"q\"' AS s, CAST(NULL AS INT) AS n")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert readers.read_csv(spark, str(tmp_path / "c")).first()["s"] == 'a "q"'
    sinks.write_json(df, str(tmp_path / "j"))
    line = spark.read.text(str(tmp_path / "j")).first()[0]
    assert '"t":"2024-01-02T03:04:05.000"' in line and '"n":null' in line
    manifest = sinks.save_charts({"one": df, "two": df}, str(tmp_path / "charts"))
    assert values(manifest, "chart") == [("one",), ("two",)]
    assert spark.read.parquet(manifest.first()["path"]).count() == 1
    with pytest.raises(ValueError):
        sinks.save_charts({}, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        sinks.save_index(spark.createDataFrame([(None,)], "embedding array<float>"), str(tmp_path / "i"))
    with pytest.raises(FileNotFoundError):
        sinks.load_index(spark, str(tmp_path / "nowhere"))
    for n in (2, 1):
        sinks.append_history(spark.sql(f"SELECT {n} AS asked_at, 'q{n}' AS question"), str(tmp_path / "h"))
    assert [r["question"] for r in sinks.read_history(spark, str(tmp_path / "h")).collect()] == ["q1", "q2"]
    name = df.select(sinks.result_name(F.lit("discovery"), F.lit("What is it?"), F.col("t"))).first()[0]
    assert name == "orchestration_discovery_what_is_it_20240102_030405"
    insight = spark.sql("SELECT 'v' AS visualization_id, named_struct('png_path', 'p') AS references, 'u' AS chart_url")
    sinks.write_insights(insight, str(tmp_path / "ins"), links=["chart_url"])
    assert spark.read.json(str(tmp_path / "ins")).first()["references"]["chart_url"] == "u"


def test_hooks(spark):
    df = spark.range(3)
    assert chain(df, lambda d: d.where("id > 0"), None, lambda d: d.withColumn("x", F.lit(1))).count() == 2

    def fails(d):
        return d.select("nope")

    found = first_success(df, {"B": lambda d: d.where("id = 1"), "A": fails, "C": fails})
    assert found.variant == "B" and len(found.errors) == 1 and found.result.count() == 1
    with pytest.raises(RuntimeError, match="all variants failed"):
        first_success(df, {"A": fails})
    assert run_sql(spark, "SELECT sum(id) AS s FROM t", {"t": df}).first()["s"] == 3
    assert run_sql(spark, "SELECT sum(id) AS s FROM {t}", {"t": df}).first()["s"] == 3


def test_bad_lines_do_not_make_a_document(spark, tmp_path):
    folder = tmp_path / "with space"
    folder.mkdir()
    write(folder / "lines.json", "\n".join(f'{{"a": {i}}}' for i in range(2000)) + "\n{broken\n")
    write(folder / "document.json", '{\n "a": 7000\n}')
    write(folder / "list.json", '[{"a": 8000},\n {"a": 9000}]')
    with pytest.warns(UserWarning, match="no JSON object"):
        rows = readers.read_json(spark, str(folder))
    assert rows.columns == ["a"] and values(rows) == [(i,) for i in sorted([*range(2000), 7000, 8000, 9000], key=lambda x: repr((x,)))]
    with pytest.warns(UserWarning):
        kept = readers.read_json(spark, str(folder), bad_lines="bad")
    assert values(kept.where("bad IS NOT NULL"), "bad") == [("{broken",)]


def test_encoded_paths(spark, tmp_path):
    for folder in ("c x", "c+y%"):
        (tmp_path / folder).mkdir()
    write(tmp_path / "c x" / "one.csv", "a,b\n1,é\n")
    write(tmp_path / "c x" / "two.csv", "a,b\n2,é\n", "latin-1")
    write(tmp_path / "c+y%" / "three.csv", 'a,b\n3,"x\ny"\n')
    rows = readers.read_csv(spark, [str(tmp_path / "c x"), str(tmp_path / "c+y%")])
    assert values(rows, "a", "b") == [(1, "é"), (2, "é"), (3, "x\ny")]


def test_all_rows_of_the_newest_run(spark, tmp_path):
    for day, n in ((1, 3), (2, 5)):
        rows = spark.range(n).withColumn("session_id", F.lit("s"))
        sinks.append_results(rows, str(tmp_path / "r"), run_at=F.lit(f"2024-01-0{day}").cast("timestamp"))
    assert sinks.latest_results(spark, str(tmp_path / "r")).count() == 5


def test_json_scan_sorts_no_lines(spark, tmp_path):
    texts = {"a": '\n \n{"x": 1}\n{"x": 2}\n{', "b": '﻿[{"x": 1},\n{"x": 2}]', "c": '{\n"x": 1}', "d": '{"x":\n1}', "e": 'no\n{"x": 1}'}
    for name, content in texts.items():
        (tmp_path / f"{name}.json").write_text(content)
    found = readers.scan_json_files(spark, str(tmp_path))
    assert "Sort" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["path"][-6]: tuple(r)[1:] for r in found.collect()} == {
        "a": (True, 1, False, True), "b": (False, 0, True, True), "c": (False, 0, False, True), "d": (False, 0, False, True), "e": (True, 1, False, True)}
