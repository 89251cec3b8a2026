import time

import pytest
from conftest import values
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tablesight.functions.text import file_name, report_file_name, slug, stem, suffix
from tablesight.operators import figures, html, text


def windows(words, size, overlap):
    return [" ".join(words[i:i + size]) for i in range(0, len(words), size - overlap)]


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}.txt", t) for i, t in enumerate(texts)], "doc string, text string")


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 700])
def test_chunks(spark, n):
    words = [f"w{i}" for i in range(n)]
    out = text.chunk(docs(spark, " \n".join(words)), "doc", "text").orderBy("chunk_no").collect()
    assert [r["chunk_text"] for r in out] == windows(words, 256, 40)
    assert [r["chunk_id"] for r in out] == [f"d0.txt_{i}" for i in range(len(out))]


def test_chunk_parameters(spark):
    with pytest.raises(ValueError):
        text.chunk(docs(spark, "a"), "doc", "text", 5, 5)
    assert text.chunk(docs(spark, " a  b "), "doc", "text", 0).first()["chunk_text"] == " a  b "
    assert text.chunk(docs(spark, None, " \u00a0\u2003 ", "\u00a0a\u3000b"), "doc", "text").select("chunk_text").collect() == [("a b",)]
    long = text.chunk(docs(spark, "x" * 3000), "doc", "text").first()
    assert len(long["chunk_text"]) == 3000


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(2, 7), st.integers(0, 5))
def test_chunks_of_lines_equal_chunks_of_the_text(spark, lengths, size, overlap):
    overlap = min(overlap, size - 1)
    lines = [" ".join(f"w{i}.{j}" for j in range(n)) for i, n in enumerate(lengths)]
    frame = spark.createDataFrame(list(enumerate(lines, start=-1)), "line_no bigint, line string")
    out = text.chunk_lines(frame, "t.csv", size, overlap).orderBy("chunk_no").collect()
    assert [r["chunk_text"] for r in out] == windows("\n".join(lines).split(), size, overlap)


def test_offsets_cross_blocks(spark):
    for step in (40_000, 10**12):
        df = spark.range(0, 10 * step, step).withColumn("n", F.lit(2))
        out = text.with_offset(df, "id", "n").orderBy("id").collect()
        assert [r["offset"] for r in out] == list(range(0, 20, 2))


def test_table_lines_keep_missing_cells(spark):
    df = spark.createDataFrame([(0, "a", None), (1, None, 2.5)], "i int, s string, v double")
    assert values(text.table_lines(df, "i", ["s", "v"]), "line_no", "line") == [(-1, "s | v"), (0, "a | "), (1, " | 2.5")]


def test_images(spark):
    captions = spark.createDataFrame([("img/a.png", "A cat"), ("b.png", "$1 \\ B")], "image string, caption string")
    md = docs(spark, "x ![one](img/a.png) y ![](deep/b.png) ![z](c.png)", "none", "![](img/a.png)")
    assert values(text.replace_images(md, "doc", "text", captions)) == [
        ("d0.txt", "x **Image:** A cat y **Image:** $1 \\ B [Image not found: c.png]"), ("d1.txt", "none"),
        ("d2.txt", "**Image:** A cat")]


def test_names(spark):
    df = spark.createDataFrame([("/a/b.tar.GZ",), ("C:\\x\\y.Csv",), (".hidden",), ("plain",)], "p string")
    p = F.col("p")
    assert df.select(suffix(p), stem(p), file_name(p)).collect() == [
        (".gz", "b.tar", "b.tar.GZ"), (".csv", "y", "y.Csv"), ("", ".hidden", ".hidden"), ("", "plain", "plain")]
    q = spark.createDataFrame([("What's  the Sum? of-x",), (" ",), (None,)], "q string")
    assert [r[0] for r in q.select(slug(F.col("q"))).collect()] == ["whats_the_sum_of-x", "orchestration_request", "orchestration_request"]
    assert [r[0] for r in q.select(report_file_name(F.col("q"))).collect()] == ["what_s_the_sum_of_x.html", "report.html", "report.html"]


PAGE = """<html><head><title> Main &amp; title </title><meta name="d" content=" about "><style>p{}</style></head>
<body><h1>Big <b>head</b></h1><script>var x = 1;</script><p>Text <!-- no --> here<h3></h3><img alt=" pic " src="x">
<div aria-label="label" title="tip" data-k="v1" data-empty="">end</div></body></html>"""


def extract(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    return [(r["text"], r["source"]) for r in figures.extract_html(df, "id", "html").orderBy("id").collect()]


def test_page_text(spark):
    lines = ["Main & title", "about", "Big head", "Main & title", "Big", "head", "Text", "here", "end", "pic", "label", "tip", "v1"]
    assert extract(spark, PAGE) == [("\n".join(lines), "text")]


def test_tables_of_a_page(spark):
    df = spark.createDataFrame([("<table><tr><th>a</th><td>b <i>c</i></td></tr><tr></tr><tr><td>d</table><table></table>",)], "html string")
    row = html.page_parts(df.withColumn("id", F.lit(1)), "id", "html").first()
    assert row["tables"] == ["a | b c\nd"]


def test_broken_pages(spark):
    assert extract(spark, "", None, "<p", "</div></div>", "<b>x<i>y</b>z")[-1] == ("x\ny\nz", "text")


CALL = ('<script>Plotly.newPlot("c", [{"type":"bar","name":"N","y":[1,2,3]}, {"marker":{"type":"dot"}}], '
        '{"title":{"text":" T "},"xaxis":{"title":"X"}}, {});</script>')
SCRIPT = '<script type="application/json">{"figure":{"data":[{"x":[1]}],"layout":{"title":"L","yaxis":{"title":{"text":"Y"}}}}}</script>'


def test_charts_of_a_page(spark):
    assert extract(spark, CALL.replace(',"xaxis":{"title":"X"}', ""))[0] == (
        "Title: T\nTrace 1, type=bar, name=N, points=3\nTrace 2, type=dot", "charts")
    assert extract(spark, SCRIPT)[0] == ("Title: L\nY-axis: Y\nTrace 1, points=1", "charts")
    assert extract(spark, "<script>not json</script>")[0] == ("", "charts")


def test_large_pages_use_patterns_over_the_whole_source(spark):
    filler = "<!-- " + "x" * 600_000 + " -->"
    late = '<script>var l={"title":"Late","yaxis":{"title":"Amount"},"type":"pie","name":"b"},m={name:"a",type:"odd"}</script>'
    assert extract(spark, filler + late) == [("Title: Late\nY-axis: Amount\nData series: a, b\nChart types: pie", "charts")]


def test_attribute_figures(spark):
    df = spark.createDataFrame([(['{"data":[{"name":"s"}],"layout":{"title":"A"}}', "short text", "x" * 300, '{"title":"Only"}'],)], "f array<string>")
    assert df.select(figures.attribute_summary(F.col("f"))).first()[0] == "Title: A\nTrace 1, name=s\n\nshort text\n\n" + "x" * 300 + "\n\nTitle: Only"


@pytest.mark.parametrize("page, tables", [
    ("<table><tr><td>a<td>b<tr><td>c<td>d</table>", ["a | b\nc | d"]),
    ("<table><tr><th>h</th><td>1</td></tr></table><table><tr><td>2", ["h | 1", "2"]),
    ("<table><tr><td>x<table><tr><td>in<td>ner</table>y<td>z</table>", ["x in ner y | z", "in | ner"]),
    ("<table><tr><td><p>a<p>b<td><ul><li>c<li>d</ul></table>", ["a b | c d"]),
])
def test_omitted_end_tags(page, tables):
    assert html._parse(page)[8] == tables


def test_headings_and_items_end_at_the_next():
    title, meta, headings, visible, *_ = html._parse("<h1>one<h2>two</h2><p>text<ul><li>a<li>b</ul>")
    assert headings == ["one", "two"] and visible == ["one", "two", "text", "a", "b"]


@pytest.mark.parametrize("piece", ["<p>x ", "<div>x ", "<span>x ", "<table><tr><td>x ", "<b>x</i> "])
def test_unclosed_tags_take_linear_time(piece):
    def seconds(n):
        start = time.perf_counter()
        html._parse(piece * n) if "table" not in piece else html._Page().feed(piece * n)
        return time.perf_counter() - start

    seconds(200)
    assert seconds(40_000) < 12 * max(seconds(8_000), 0.02)


def test_runs_of_comments_and_quoted_tags_are_read_at_once(monkeypatch):
    calls = []
    for name in ("parse_comment", "parse_starttag"):
        plain = getattr(html.HTMLParser, name)
        monkeypatch.setattr(html.HTMLParser, name, lambda self, *a, plain=plain, name=name: calls.append(name) or plain(self, *a))
    page = "<p title='t &amp; u'>one" + "<!-- a - b -->\n" * 50 + "two<script>var x = '<!-- c --><!-- d -->';</script><!-- -- odd -->"
    title, _, _, visible, _, _, titles, *_ = html._parse(page)
    assert (title, visible, titles) == (None, ["one", "two"], ["t & u"])
    assert html._parse(page)[9] == ["\nvar x = '<!-- c --><!-- d -->';"]
    assert calls == ["parse_comment"] * 2  # the odd comment, in both readings


def test_parts_are_handed_on_before_a_batch_of_pages_ends(spark, monkeypatch):
    monkeypatch.setattr(html, "PAGES_AT_ONCE", 10)
    pages = spark.range(7, numPartitions=1).withColumn("html", F.when(F.col("id") != 3, F.concat(F.lit("<p>page "), F.col("id").cast("string"))))
    assert values(html.page_parts(pages, "id", "html").select("id", "visible"), "id", "visible") == [(i, [f"page {i}"] if i != 3 else []) for i in range(7)]


def test_costly_rows_get_tasks_by_their_number(spark):
    from tablesight.sources.readers import spread_rows

    assert spread_rows(spark.range(1000, numPartitions=4), rows=10).rdd.getNumPartitions() == 100
    assert spread_rows(spark.range(1000, numPartitions=100), rows=10).rdd.getNumPartitions() == 100
