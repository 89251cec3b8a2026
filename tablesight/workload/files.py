"""Writing the given tables to files of each kind and reading them back."""

from __future__ import annotations

import io
import uuid
import warnings
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from tablesight.functions.storage import shared_folder, with_global_rank
from tablesight.operators.charts import run_report
from tablesight.operators.vectors import nearest_to
from tablesight.sources import catalog, documents, feather, readers, sinks
from tablesight.workload.registry import query


def _folder(df) -> str:
    return f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"


@query("source_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def source_csv(t):
    orders = t("orders")
    path = _folder(orders) + ".csv"
    sinks.write_csv(orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")), path)
    return readers.read_any(orders.sparkSession, path)


@query("source_tsv_quoted", "SELECT event_id, event_type, props || chr(10) || '\"' || event_type || '\"' AS note FROM events")
def source_tsv_quoted(t):
    events = t("events").select("event_id", "event_type", F.concat("props", F.lit('\n"'), "event_type", F.lit('"')).alias("note"))
    path = _folder(events) + ".tsv"
    events.write.option("header", True).option("sep", "\t").option("escape", '"').csv(path)
    return readers.read_any(events.sparkSession, path)


@query("source_json_lines", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def source_json_lines(t):
    events = t("events")
    path = _folder(events) + ".json"
    sinks.write_json(events.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), path)
    return readers.read_any(events.sparkSession, path).select(*events.columns)


@query("source_parquet", "SELECT * FROM supplier WHERE s_acctbal > 1000")
def source_parquet(t):
    suppliers = t("supplier")
    path = _folder(suppliers) + ".parquet"
    suppliers.write.parquet(path)
    return readers.read_any(suppliers.sparkSession, path).where("s_acctbal > 1000")


@query("source_feather", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 25")
def source_feather(t):
    """Files of many record batches, of which tasks read their own and only the wanted columns."""
    lines = t("lineitem")
    path = _folder(lines)
    feather.write_feather(lines, path)
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
    return feather.read_feather(lines.sparkSession, path, columns).where("l_quantity > 25")


def _workbooks(batches: Iterator[pa.RecordBatch], path: str, header: list[str]) -> Iterator[pa.RecordBatch]:
    """Writes the rows of a task as one workbook, the cells as text or numbers."""
    def cell(value) -> str:
        if value is None:
            return "<c/>"
        return f"<c><v>{value}</v></c>" if isinstance(value, (int, float)) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    main, relations = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows = [f"<row>{''.join(map(cell, header))}</row>"]
    for batch in batches:
        rows += [f"<row>{''.join(map(cell, row))}</row>" for row in zip(*(c.to_pylist() for c in batch.columns))]
    if len(rows) > 1:
        file = io.BytesIO()
        with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as book:
            book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{relations}"><sheets><sheet name="A" sheetId="1" r:id="r1"/></sheets></workbook>')
            book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                          '<Relationship Id="r1" Target="worksheets/a.xml"/></Relationships>')
            book.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(rows)}</sheetData></worksheet>')
        yield feather.put_file(path, f"part-{TaskContext.get().partitionId():05d}.xlsx", file.getvalue())


@query("source_excel", """
    SELECT o_orderkey, o_orderpriority || ' & <' || o_orderstatus || '>' AS note, CASE WHEN o_custkey % 2 = 0 THEN o_totalprice END AS price FROM orders""")
def source_excel(t):
    """Workbooks of one block of keys each, streamed row by row into typed columns."""
    orders = t("orders").select("o_orderkey", F.concat("o_orderpriority", F.lit(" & <"), "o_orderstatus", F.lit(">")).alias("note"),
                                F.when(F.col("o_custkey") % 2 == 0, F.col("o_totalprice")).alias("price"))
    path, header = _folder(orders), orders.columns
    blocks = orders.repartitionByRange(max(1, orders.count() // 5_000), "o_orderkey")
    blocks.mapInArrow(lambda batches: _workbooks(batches, path, header), "file string").count()
    return readers.READERS[".xlsx"](orders.sparkSession, path)


@query("source_json_document", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def source_json_document(t):
    """Arrays over many lines, as other programs write them; each file is read by many tasks."""
    orders = t("orders").drop("o_orderdate")
    path = _folder(orders) + ".json"
    sinks.write_json_documents(orders, path)
    return readers.read_any(orders.sparkSession, path).select(*orders.columns)


@query("source_json_mixed", """
    SELECT event_id, event_type, NULL AS bad FROM events UNION ALL SELECT NULL, NULL, '{"event_id": ' FROM events WHERE event_id % 1000 = 0""")
def source_json_mixed(t):
    """Lines of which some are cut off, beside a document: good lines stay, bad ones are told."""
    events = t("events").select("event_id", "event_type")
    path = _folder(events) + " of events.json"
    line = F.to_json(F.struct("event_id", "event_type"))
    good = F.when(F.col("event_id") % 2 == 0, line).otherwise(F.concat(F.lit(" "), line))
    lines = F.when(F.col("event_id") % 1000 == 0, F.concat(good, F.lit('\n{"event_id": '))).otherwise(good)
    early = F.col("event_id") % 1000 < 20
    events.where(~early | (F.col("event_id") % 1000 == 0)).select(lines.alias("value")).write.text(path)
    sinks.write_json_documents(events.where(early & (F.col("event_id") % 1000 != 0)), path, mode="append")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return readers.read_json(events.sparkSession, path, bad_lines="bad").select("event_id", "event_type", "bad")


@query("source_csv_mixed", """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || chr(10) || '"x"' ELSE c_name || 'é' END AS name FROM customer""")
def source_csv_mixed(t):
    """UTF-8, Latin-1 and quoted line breaks in files whose names hold blanks."""
    customers = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit('\n"x"'))).otherwise(
        F.concat("c_name", F.lit("é"))).alias("name"))
    path = _folder(customers) + " of customers.csv"
    for rest, encoding in ((0, "UTF-8"), (1, "ISO-8859-1"), (2, "UTF-8")):
        customers.where(F.col("c_custkey") % 3 == rest).write.mode("append").option("header", True).option("escape", '"').option(
            "encoding", encoding).csv(path)
    return readers.read_any(customers.sparkSession, path)


@query("source_long_ids", """
    SELECT (1234567890123456789 + o_orderkey)::BIGINT AS id, ('98765432109876543210' || lpad(o_orderkey::VARCHAR, 10, '0')) AS long_id FROM orders""")
def source_long_ids(t):
    """Identifiers of 19 and of 30 digits keep them all."""
    orders = t("orders").select(
        (F.lit(1234567890123456789) + F.col("o_orderkey")).alias("id"),
        F.concat(F.lit("98765432109876543210"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("long_id"))
    path = _folder(orders) + ".csv"
    sinks.write_csv(orders, path)
    return readers.read_any(orders.sparkSession, path).select("id", F.col("long_id").cast("string").alias("long_id"))


@query("documents_index", """
    SELECT 'md' AS kind, doc_id, 0 AS chunk_no, 'note ' || doc_id AS chunk_text FROM documents
    UNION ALL SELECT 'json', doc_id, 0, '{ "doc": ' || doc_id || ' }' FROM documents
    UNION ALL SELECT 'html', doc_id, 0, 'page ' || doc_id FROM documents""")
def documents_index(t):
    """Files of several kinds with the same names: one index of all their chunks, each with its own id."""
    docs = t("documents").select("doc_id", F.col("doc_id").cast("string").alias("k"))
    kinds = {"md": F.concat(F.lit("note "), "k"), "json": F.concat(F.lit('{"doc": '), "k", F.lit("}")),
             "html": F.concat(F.lit("<p>page</p> "), "k")}
    parts = [docs.select("doc_id", F.lit(kind).alias("kind"), F.concat(F.lit(f"/{kind}/"), "k", F.lit(f"/note.{kind}")).alias("doc"),
                         text.alias("text"), F.lit("").alias("path")) for kind, text in kinds.items()]
    files = documents.chunk_all(parts)
    chunks = documents.chunk_documents(files)
    per_id = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.first("doc").alias("doc"), F.first("chunk_no").alias("chunk_no"),
                                            F.first("chunk_text").alias("chunk_text")).where("n = 1")
    return per_id.select(F.regexp_extract("doc", r"^/(\w+)/", 1).alias("kind"), F.regexp_extract("doc", r"/(\d+)/", 1).cast("bigint").alias("doc_id"),
                         "chunk_no", F.regexp_replace("chunk_text", r"\s+", " ").alias("chunk_text"))


@query("session_results", """
    SELECT lang AS session_id, doc_id FROM documents WHERE doc_id % 2 = 1""")
def session_results(t):
    """Two runs of many rows per session; all rows of the newer one come back."""
    docs = t("documents").select(F.col("lang").alias("session_id"), "doc_id")
    path = _folder(docs)
    for rest in (0, 1):
        sinks.append_results(docs.where(F.col("doc_id") % 2 == rest), path, run_at=F.lit(f"2024-01-0{rest + 1}").cast("timestamp"))
    return sinks.latest_results(docs.sparkSession, path).select("session_id", "doc_id")


@query("vector_index", """
    SELECT vec_id, round(list_distance(embedding::DOUBLE[], list_value(""" + ", ".join(["0.1::DOUBLE"] * 64) + """)) ** 2, 8) AS distance
    FROM embeddings ORDER BY distance, vec_id LIMIT 5""")
def vector_index(t):
    vectors = t("embeddings")
    path = _folder(vectors)
    sinks.save_index(vectors, path)
    near = nearest_to(sinks.load_index(vectors.sparkSession, path), "embedding", [0.1] * 64, "vec_id")
    return near.select("vec_id", F.round("distance", 8).alias("distance"))


@query("file_catalog", """
    SELECT o_orderkey // 1000 AS block, 'other' AS kind, '.txt' AS extension, 1 AS files, sum(length(o_orderkey::VARCHAR) + 1)::BIGINT AS bytes FROM orders GROUP BY 1""")
def file_catalog(t):
    """Files of one block of keys each, with their sizes; their contents are not read."""
    orders = t("orders").select(F.expr("o_orderkey div 1000").alias("block"), F.col("o_orderkey").cast("string").alias("value"))
    path = _folder(orders)
    orders.repartition("block").write.partitionBy("block").text(path)
    files = catalog.artifact_groups(catalog.list_files(orders.sparkSession, path, pattern="*.txt"))
    block = F.regexp_extract("path", r"block=(\d+)", 1).cast("bigint").alias("block")
    return files.groupBy(block, "kind", "extension").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query("documents_from_files", """
    SELECT doc_id // 20 AS block, 'txt' AS kind, md5(string_agg(text || chr(10), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1""")
def documents_from_files(t):
    """Texts written to files of twenty documents each and read back, one row per file."""
    docs = t("documents").select(F.expr("doc_id div 20").alias("block"), "doc_id", "text")
    path = _folder(docs)
    docs.repartition("block").sortWithinPartitions("block", "doc_id").select("block", F.col("text").alias("value")).write.partitionBy("block").text(path)
    read = documents.read_documents(docs.sparkSession, path, "*.txt")
    return read.select(F.regexp_extract("path", r"block=(\d+)", 1).cast("bigint").alias("block"), "kind", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("insight_files", """
    SELECT 'viz_' || c_custkey AS visualization_id, 'Balance of ' || c_name AS title, '/charts/' || c_custkey || '.png' AS png_path,
        '/charts/' || c_custkey || '.html' AS html_path, [c_mktsegment, c_nationkey::VARCHAR] AS evidence FROM customer""")
def insight_files(t):
    """Insights written as records whose links lie in ``references``, and read back."""
    key = F.col("c_custkey").cast("string")
    insights = t("customer").select(
        F.concat(F.lit("viz_"), key).alias("visualization_id"), F.concat(F.lit("Balance of "), "c_name").alias("title"),
        F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("evidence"),
        F.struct(F.concat(F.lit("/charts/"), key, F.lit(".png")).alias("png_path")).alias("references"),
        F.concat(F.lit("/charts/"), key, F.lit(".html")).alias("html_path"))
    path = _folder(insights) + ".json"
    sinks.write_insights(insights, path, links=["html_path"])
    return readers.read_json(insights.sparkSession, path, lines=True, infer=False).select("visualization_id", "title", "references.png_path", "references.html_path", "evidence")


@query("question_history", """
    SELECT row_number() OVER (ORDER BY conv_id, turn) AS position, conv_id, turn FROM conversations WHERE role = 'user'""")
def question_history(t):
    asked = t("conversations").where("role = 'user'").select("conv_id", "turn", F.struct("conv_id", "turn").alias("asked_at"))
    path = _folder(asked)
    sinks.append_history(asked.where("turn = 0"), path)
    sinks.append_history(asked.where("turn <> 0"), path)
    history = sinks.read_history(asked.sparkSession, path)
    return with_global_rank(history, [F.col("asked_at")], "position", start=1).select("position", "conv_id", "turn")


@query("chart_store", """
    SELECT 'status' AS chart, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY ALL
    UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY ALL""")
def chart_store(t):
    orders = t("orders")
    charts = run_report(orders, {"charts": [
        {"name": "status", "type": "pie", "color": "o_orderstatus"}, {"name": "priority", "type": "pie", "color": "o_orderpriority"}]})
    saved = {r["chart"]: r["path"] for r in sinks.save_charts(charts, _folder(orders)).collect()}
    read = {name: orders.sparkSession.read.parquet(path) for name, path in saved.items()}
    rows = [read[n].select(F.lit(n).alias("chart"), F.col(c).alias("label"), F.col("count").alias("n"))
            for n, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))]
    return rows[0].unionByName(rows[1])


@query("json_documents", """
    SELECT 'doc_' || page_id || '.json' AS doc, 0 AS chunk_no, '{ "page": ' || page_id || ', "link": "' || url || '" }' AS chunk_text FROM pages""")
def json_documents(t):
    docs = t("pages").select(
        F.concat(F.lit("doc_"), F.col("page_id").cast("string"), F.lit(".json")).alias("doc"), F.lit("").alias("path"), F.lit("json").alias("kind"),
        F.to_json(F.struct(F.col("page_id").alias("page"), F.col("url").alias("link"))).alias("text"))
    return documents.chunk_documents(docs).select("doc", "chunk_no", "chunk_text")
