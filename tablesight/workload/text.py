"""Documents, pages and questions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesight.functions.text import SPACE_CLASS
from tablesight.operators import figures, html, questions, records, text
from tablesight.workload.registry import query

_SPACE = SPACE_CLASS  # the same expression is valid in both engines


@query("chunk_words", f"""
    WITH w AS (SELECT doc_id::VARCHAR AS doc, list_filter(string_split_regex(text, '{_SPACE}'), lambda x: x <> '') AS words FROM documents),
    s AS (SELECT doc, words, unnest(range(0, len(words), 216)) AS start FROM w WHERE len(words) > 0),
    c AS (SELECT doc, (start // 216)::INT AS chunk_no, array_to_string(words[start + 1 : start + 256], ' ') AS body FROM s)
    SELECT doc, doc || '_' || chunk_no AS chunk_id, chunk_no, md5(body) AS chunk_text FROM c""")
def chunk_words(t):
    return text.chunk(t("documents", spread=True), "doc_id", "text").withColumn("chunk_text", F.md5("chunk_text"))


_PART_LINE = "concat_ws(' | ', p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)"


@query("table_lines", f"""
    SELECT -1::BIGINT AS line_no, 'p_partkey | p_name | p_brand | p_type | p_size | p_retailprice' AS line
    UNION ALL SELECT p_partkey, {_PART_LINE} FROM part""")
def table_lines(t):
    return text.table_lines(t("part"), "p_partkey")


@query("chunk_table", f"""
    WITH l AS (SELECT -1 AS n, 'p_partkey | p_name | p_brand | p_type | p_size | p_retailprice' AS line
               UNION ALL SELECT p_partkey, {_PART_LINE} FROM part),
    w AS (SELECT string_split_regex(string_agg(line, chr(10) ORDER BY n), '{_SPACE}') AS words FROM l),
    s AS (SELECT words, unnest(range(0, len(words), 216)) AS start FROM w),
    c AS (SELECT (start // 216)::INT AS chunk_no, array_to_string(words[start + 1 : start + 256], ' ') AS body FROM s)
    SELECT 'part.csv' AS doc, 'part.csv_' || chunk_no AS chunk_id, chunk_no, body AS chunk_text FROM c""")
def chunk_table(t):
    return text.chunk_lines(text.table_lines(t("part"), "p_partkey"), "part.csv")


@query("row_json", """
    SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def row_json(t):
    return t("nation").select("n_nationkey", text.row_json(t("nation"), pretty=False).alias("json"))


@query("image_captions", """
    SELECT doc_id, 'See **Image:** Picture of ' || lang || ' text and [Image not found: none.png] in ' || source AS body FROM documents""")
def image_captions(t):
    docs = t("documents").select("doc_id", F.concat(
        F.lit("See ![pic](img/"), "lang", F.lit(".png) and ![](none.png) in "), "source").alias("body"))
    captions = t("documents").select("lang").distinct().select(
        F.concat(F.lit("img/"), "lang", F.lit(".png")).alias("image"), F.concat(F.lit("Picture of "), "lang", F.lit(" text")).alias("caption"))
    return text.replace_images(docs, "doc_id", "body", captions)


@query("token_cost", f"""
    WITH n AS (SELECT conv_id, role, len(list_filter(string_split_regex(text, '{_SPACE}'), lambda x: x <> '')) AS n FROM conversations),
    s AS (SELECT conv_id, coalesce(sum(n) FILTER (role <> 'assistant'), 0)::DOUBLE AS a, coalesce(sum(n) FILTER (role = 'assistant'), 0)::DOUBLE AS b FROM n GROUP BY 1)
    SELECT conv_id, a * 1.5 AS input_tokens, b * 1.5 AS output_tokens, (a + b) * 1.5 AS total_tokens,
           round(a * 1.5 * 0.00000015 + b * 1.5 * 0.0000006, 10) AS cost FROM s""")
def token_cost(t):
    return text.token_cost(t("conversations"), "conv_id", "role", "text").withColumn("cost", F.round("cost", 10))


@query("html_title_meta", r"""
    SELECT page_id, replace(replace(replace(replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS title,
           len(regexp_extract_all(html, '<meta [^>]*content="[^"]')) AS metas FROM pages""")
def html_title_meta(t):
    return html.page_parts(t("pages", spread=True), "page_id", "html").select(
        "page_id", "title", F.size("meta").cast("bigint").alias("metas"))


@query("html_headings", r"""
    SELECT page_id, replace(replace(replace(replace(trim(unnest(regexp_extract_all(html, '<h[1-6]>([^<]+)</h', 1))), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS heading
    FROM pages""")
def html_headings(t):
    return html.page_parts(t("pages", spread=True), "page_id", "html").select("page_id", F.explode("headings").alias("heading"))


@query("html_text")
def html_text(t):
    return figures.extract_html(t("pages", spread=True), "page_id", "html")


@query("html_page_text", r"""
    SELECT o_orderkey, 'Order ' || o_orderkey || chr(10) || 'about ' || o_orderstatus || chr(10) || 'Head & tail' || chr(10) || 'Order ' || o_orderkey || chr(10) ||
        'Head & tail' || chr(10) || 'of ' || o_custkey || chr(10) || 'bold' || chr(10) || 'text' || chr(10) || 'a chart' || chr(10) || 'tip' || chr(10) || 'd' || o_orderkey AS text FROM orders""")
def html_page_text(t):
    """Title, meta, headings, visible text and attributes in their order; scripts, styles and comments are not text."""
    key = F.col("o_orderkey").cast("string")
    page = [F.lit(part) if isinstance(part, str) else part for part in ("<html><head><title>Order ", key, "</title><meta name='d' content='about ", F.col("o_orderstatus"), "'><style>p {}</style></head><body data-id='d", key,
                 "'><h1>Head &amp; tail</h1><!-- no --><script>var x = '<p>';</script><p title='tip'>of ", F.col("o_custkey").cast("string"), "<b> bold</b> text<img alt='a chart'></body></html>")]
    pages = t("orders", spread=True).select("o_orderkey", F.concat(*page).alias("html"))
    return figures.extract_html(pages, "o_orderkey", "html").select("o_orderkey", "text")


@query("html_tables", """
    SELECT c_custkey, 0 AS position, CASE c_custkey % 3 WHEN 2 THEN c_custkey || ' ' || c_name || ' | end' ELSE c_custkey || ' | ' || c_name || chr(10) || 'second' END AS rows FROM customer
    UNION ALL SELECT c_custkey, 1, c_name FROM customer WHERE c_custkey % 3 = 2""")
def html_tables(t):
    """Tables with all end tags, without them, and within each other."""
    key, name = F.col("c_custkey").cast("string"), F.col("c_name")
    page = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("<table><tr><td>"), key, F.lit("</td><td>"), name, F.lit("</td></tr><tr><td>second</td></tr></table>")))
        .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("<table><tr><td>"), key, F.lit("<td><p>"), name, F.lit("<tr><td>second")))
        .otherwise(F.concat(F.lit("<table><tr><td>"), key, F.lit("<table><tr><td>"), name, F.lit("</table><td>end</table>"))))
    parts = html.page_parts(t("customer", spread=True).select("c_custkey", page.alias("html")), "c_custkey", "html")
    return parts.select("c_custkey", F.posexplode("tables").alias("position", "rows"))


@query("html_attributes", """
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Title: About ' || c_name || chr(10) || 'Trace 1, type=bar, name=s' || c_custkey || ', points=2'
        ELSE c_name || repeat(' and more', 40) END AS summary FROM customer""")
def html_attributes(t):
    """Figures in data attributes, and attributes of any length that are no figure."""
    key, name = F.col("c_custkey").cast("string"), F.col("c_name")
    figure = F.concat(F.lit('{"data":[{"type":"bar","name":"s'), key, F.lit('","y":[1,2]}],"layout":{"title":"About '), name, F.lit('"}}'))
    value = F.when(F.col("c_custkey") % 2 == 0, figure).otherwise(F.concat(name, F.repeat(F.lit(" and more"), 40)))
    page = F.concat(F.lit("<div data-chart='"), value, F.lit("'></div>"))
    parts = html.page_parts(t("customer", spread=True).select("c_custkey", page.alias("html")), "c_custkey", "html")
    return parts.select("c_custkey", figures.attribute_summary(F.col("figures")).alias("summary"))


@query("page_ladder", """
    SELECT c_custkey, 'Title: Balance' || chr(10) || 'Trace 1, type=pie, name=s' || c_custkey AS summary FROM customer""")
def page_ladder(t):
    """Short and very long pages go through the same steps."""
    pad = F.when(F.col("c_custkey") % 50 == 0, F.repeat(F.lit("<!-- long -->"), 50_000)).otherwise("")
    page = F.concat(F.lit("<html>"), pad, F.lit('<script type="application/json">{"data":[{"type":"pie","name":"s'), F.col("c_custkey").cast("string"),
                    F.lit('"}],"layout":{"title":"Balance"}}</script></html>'))
    pages = t("customer", spread=True).select("c_custkey", page.alias("html"))
    return figures.extract_html(pages, "c_custkey", "html").select("c_custkey", F.col("text").alias("summary"))


_FIGURE = ('{"data":[{"type":"bar","name":"', '","y":[1,2,3]},{"type":"line","x":[1,2]}],"layout":{"title":{"text":"Values of ',
           '"},"xaxis":{"title":"day"}}}')


@query("figure_scripts", """
    SELECT event_id, 'Title: Values of ' || event_type || chr(10) || 'X-axis: day' || chr(10) || 'Trace 1, type=bar, name=' || user_id
           || ', points=3' || chr(10) || 'Trace 2, type=line, points=2' AS text, 'charts' AS source FROM events""")
def figure_scripts(t):
    page = F.concat(F.lit('<html><script type="application/json">' + _FIGURE[0]), F.col("user_id").cast("string"),
                    F.lit(_FIGURE[1]), "event_type", F.lit(_FIGURE[2] + "</script></html>"))
    return figures.extract_html(t("events", spread=True).select("event_id", page.alias("html")), "event_id", "html")


@query("figure_calls", """
    SELECT event_id, 'Title: ' || event_type || chr(10) || 'Y-axis: amount' || chr(10) || 'Trace 1, type=scatter, points=2' AS summary FROM events""")
def figure_calls(t):
    page = F.concat(F.lit('<script>Plotly.newPlot("chart", [{"type":"scatter","x":[1,2]}], {"title":"'), "event_type",
                    F.lit('","yaxis":{"title":{"text":"amount"}}}, {"responsive":true})</script>'))
    return t("events", spread=True).select("event_id", figures.plot_call_summary(page).alias("summary"))


@query("figure_patterns", """
    SELECT event_id, 'Title: ' || event_type || chr(10) || 'X-axis: when' || chr(10) || 'Data series: s' || user_id || chr(10) || 'Chart types: bar' AS summary FROM events""")
def figure_patterns(t):
    page = F.concat(F.lit('var c={"title":"'), "event_type", F.lit('","xaxis":{"title":"when"},"type":"bar","other":1,"name":"s'),
                    F.col("user_id").cast("string"), F.lit('"}'))
    return t("events", spread=True).select("event_id", figures.pattern_summary(page).alias("summary"))


@query("json_block", """
    SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'error') THEN '{"value": ' || event_id || ', "kind": "' || event_type || '"}' END AS json,
           CASE event_type WHEN 'click' THEN 'fenced' WHEN 'view' THEN 'braced' WHEN 'error' THEN 'fenced' END AS json_source,
           CASE event_type WHEN 'purchase' THEN 'no JSON object could be read' WHEN 'signup' THEN 'missing required key: kind' END AS json_error FROM events""")
def json_block(t):
    body = F.concat(F.lit('{"value": '), F.col("event_id").cast("string"), F.lit(', "kind": "'), "event_type", F.lit('"}'))
    fenced = F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n``` done"))
    reply = (
        F.when(F.col("event_type").isin("click", "error"), fenced)
        .when(F.col("event_type") == "view", F.concat(F.lit("Result "), body, F.lit(" end")))
        .when(F.col("event_type") == "signup", F.lit('{"value": 1}')).otherwise("{broken: [}"))
    return records.json_blocks(t("events", spread=True).select("event_id", reply.alias("reply")), "reply", ["value", "kind"]).drop("reply")


def _insight_documents(t):
    """One JSON document per page with two insights of different shape and two narrative sections."""
    key = F.col("page_id").cast("string")
    body = F.concat(
        F.lit('{"insights": [{"id": "viz_'), key, F.lit('", "name": "Chart '), key,
        F.lit('", "insight": "up", "evidence": ["a", "b"], "references": {"png_path": "x.png"}}, '
              '{"visualization_id": "second", "title": "Other chart", "primary_insight": "down", "caveats": ["c"]}, 5], '
              '"narrative_sections": [{"heading": "OTHER-chart!", "body": "About the other"}, {"heading": "Intro", "body": "Hello"}, '
              '{"heading": "End", "body": "Bye"}]}'))
    return t("pages", spread=True).select("page_id", body.alias("json"))


@query("insight_records", """
    SELECT page_id, 0 AS position, 'viz_' || page_id AS visualization_id, 'Chart ' || page_id AS title, 'up' AS primary_insight,
           'a,b' AS evidence, '' AS caveats, 'x.png' AS png_path FROM pages
    UNION ALL SELECT page_id, 1, 'second', 'Other chart', 'down', '', 'c', NULL FROM pages""")
def insight_records(t):
    return records.insights(_insight_documents(t), "page_id", "json").select(
        "page_id", "position", "visualization_id", "title", "primary_insight",
        F.array_join("supporting_evidence", ",").alias("evidence"), F.array_join("caveats", ",").alias("caveats"),
        F.col("references.png_path").alias("png_path"))


@query("insight_narratives", """
    SELECT page_id, 'Chart ' || page_id AS title, '' AS narrative FROM pages
    UNION ALL SELECT page_id, 'Other chart', 'About the other' FROM pages""")
def insight_narratives(t):
    from tablesight.operators.matching import attach_narratives

    docs = _insight_documents(t)
    found = records.insights(docs, "page_id", "json")
    return attach_narratives(found, records.narrative_sections(docs, "page_id", "json"), "page_id").select(
        "page_id", "title", "narrative")


@query("nlq_aggregate", """
    SELECT 'mean' AS function, 'c_acctbal' AS "column", 'c_mktsegment' AS filter_column, 'HOUSEHOLD' AS filter_value,
           round(avg(c_acctbal), 4) AS value, count(*) AS rows FROM customer WHERE c_mktsegment = 'HOUSEHOLD'""")
def nlq_aggregate(t):
    out = questions.answer(t("customer"), "What is the average acctbal for c_mktsegment household?", "customer.csv")
    return out.withColumn("value", F.round("value", 4)).drop("answer")


@query("nlq_sentence", """
    SELECT 'Based on the data in orders.csv:' || chr(10) || chr(10) || 'The max of ''o_totalprice'' for all data is: **'
           || format('{:,.2f}', max(o_totalprice)) || '**' || chr(10) || chr(10) || '(Calculated from ' || count(*) || ' rows)' AS answer FROM orders""")
def nlq_sentence(t):
    return questions.answer(t("orders"), "Show me the highest totalprice", "orders.csv").select("answer")


@query("sum_shortcut", "SELECT 'o_totalprice' AS \"column\", round(sum(o_totalprice), 2) AS value FROM orders")
def sum_shortcut(t):
    texts = t("orders").select(F.col("o_totalprice").cast("string").alias("o_totalprice"), "o_orderkey")
    return questions.sum_shortcut(texts, "What is the sum of o totalprice").select("column", F.round("value", 2).alias("value"))
