"""Catalogs, health and matching over lists that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesight.operators import matching, monitor
from tablesight.sources.catalog import allowed_uploads, artifact_groups, choose_dataset, latest, preferred_entry
from tablesight.streaming import windowed_health, windowed_totals
from tablesight.workload.registry import query

# Extension that each document stands for, by source number.
_KINDS = ("csv", "pdf", "html", "json", "txt", "xlsx", "md", "png", "dat", "")
_KIND_SQL = "list_extract([" + ", ".join(f"'{k}'" for k in _KINDS) + "], (replace(source, 'src', '')::INT % 10 + 1))"
_PATH_SQL = f"('/up/' || lang || '/Doc_' || doc_id || CASE WHEN {_KIND_SQL} = '' THEN '' ELSE '.' || {_KIND_SQL} END)"
_FILES = f"""files AS (SELECT doc_id, lang AS session, {_PATH_SQL} AS path, CASE WHEN {_KIND_SQL} = '' THEN '' ELSE '.' || {_KIND_SQL} END AS ext,
              n_chars AS size FROM documents)"""
_NATURE = """CASE WHEN ext IN ('.csv', '.xlsx', '.xls') THEN 'structured' WHEN ext IN ('.pdf', '.html', '.htm', '.txt', '.md') THEN 'unstructured'
             WHEN ext = '.json' THEN 'flexible' ELSE 'unknown' END"""


def uploads(t):
    """A file list: one path per document, grouped by language."""
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    kind = F.get(kinds, F.regexp_replace("source", "src", "").cast("int") % 10)
    ending = F.when(kind == "", "").otherwise(F.concat(F.lit("."), kind))
    path = F.concat(F.lit("/up/"), "lang", F.lit("/Doc_"), F.col("doc_id").cast("string"), ending)
    return t("documents").select("doc_id", F.col("lang").alias("session"), path.alias("path"), F.col("n_chars").alias("size"))


@query("source_classes", f"""
    WITH {_FILES} SELECT path, ext AS extension, {_NATURE} AS data_nature, CASE ext WHEN '.csv' THEN 'text/csv' WHEN '.pdf' THEN 'application/pdf'
        WHEN '.html' THEN 'text/html' WHEN '.json' THEN 'application/json' WHEN '.txt' THEN 'text/plain' WHEN '.md' THEN 'text/markdown'
        WHEN '.png' THEN 'image/png' WHEN '.xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'
        ELSE 'application/octet-stream' END AS media_type FROM files""")
def source_classes(t):
    return monitor.classify_sources(uploads(t).select("path"), "path")


@query("catalog_summary", f"""
    WITH {_FILES}, c AS (SELECT *, {_NATURE} AS nature FROM files)
    SELECT session, count(*) AS total, count_if(size > 1000)::BIGINT AS existing, count_if(nature = 'structured')::BIGINT AS structured,
           count_if(nature = 'unstructured')::BIGINT AS unstructured, count_if(nature = 'flexible')::BIGINT AS flexible,
           count_if(nature = 'unknown')::BIGINT AS unknown FROM c GROUP BY 1""")
def catalog_summary(t):
    sources = monitor.classify_sources(uploads(t), "path").withColumn("exists", F.col("size") > 1000)
    return monitor.catalog_summary(sources, ["session"], "exists")


@query("upload_mix", f"""
    WITH {_FILES}, c AS (SELECT doc_id % 50 AS session, {_NATURE} AS nature FROM files),
    g AS (SELECT session, count(*) AS files, bool_or(nature = 'structured') AS s, bool_or(nature = 'unstructured') AS u, bool_or(nature = 'flexible') AS f FROM c GROUP BY 1)
    SELECT session, files, CASE WHEN s AND u THEN 'mixed' WHEN s THEN 'structured' WHEN u THEN 'unstructured' WHEN f THEN 'flexible' ELSE 'unknown' END AS primary_data_nature FROM g""")
def upload_mix(t):
    sources = monitor.classify_sources(uploads(t), "path").withColumn("session", F.col("doc_id") % 50)
    return monitor.upload_mix(sources, ["session"])


@query("upload_class", """
    WITH g AS (SELECT source, sum(n_chars * 500)::BIGINT AS bytes, count(*) AS files FROM documents GROUP BY 1)
    SELECT source, bytes, files, CASE WHEN bytes < 15000000 THEN 'inline_batch' WHEN files = 1 AND bytes < 50000000 THEN 'files_api_single'
           ELSE 'files_api_individual' END AS upload_class FROM g""")
def upload_class(t):
    return monitor.upload_class(t("documents").select("source", (F.col("n_chars") * 500).alias("size")), ["source"], "size")


@query("allowed_uploads", f"""
    WITH {_FILES} SELECT path, CASE WHEN ext IN ('.html', '.pdf', '.json') THEN ext[2:] ELSE 'other' END AS kind,
           'https://host/files' || path AS public_url FROM files
    WHERE ext IN ('.csv', '.xlsx', '.xls', '.json', '.txt', '.pdf', '.html', '.htm', '.md')""")
def allowed(t):
    files = monitor.classify_sources(uploads(t).select("path"), "path")
    return artifact_groups(allowed_uploads(files), base_url="https://host/files/").select("path", "kind", "public_url")


@query("dataset_choice", f"""
    WITH {_FILES} SELECT session, path AS dataset FROM files WHERE ext IN ('.csv', '.xlsx') AND size > 500
    QUALIFY row_number() OVER (PARTITION BY session ORDER BY CASE ext WHEN '.csv' THEN 0 ELSE 1 END, doc_id) = 1""")
def dataset_choice(t):
    files = uploads(t).withColumn("exists", F.col("size") > 500)
    return choose_dataset(files, ["session"], "path", "doc_id", "exists")


@query("preferred_entry", """
    SELECT user_id, CASE WHEN bool_or(event_type = 'click') THEN '/out/' || user_id || '/plotly_index.html' ELSE '/out/' || user_id || '/report.html' END AS preferred_entry
    FROM events WHERE event_type IN ('click', 'view') GROUP BY 1""")
def entry_page(t):
    name = F.when(F.col("event_type") == "click", "plotly_index.html").when(F.col("event_type") == "view", "report.html").otherwise("data.json")
    files = t("events").select("user_id", name.alias("name")).withColumn(
        "path", F.concat(F.lit("/out/"), F.col("user_id").cast("string"), F.lit("/"), "name"))
    return preferred_entry(files, ["user_id"])


@query("latest_results", """
    SELECT user_id, event_id, event_type, value, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""")
def latest_results(t):
    return latest(t("events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], "ts")


def session_rows(t):
    """One monitoring row per user: files by event type, slowest answer, first errors."""
    events = t("events")
    kinds = events.groupBy("user_id", "event_type").agg((F.max("value") >= 150).alias("there"))
    files = kinds.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("event_type").alias("name"), F.col("there").alias("exists")))).alias("files"))
    totals = events.groupBy("user_id").agg(
        F.max("value").alias("latency_ms"), F.when(F.col("user_id") % 2 == 0, "RAG").otherwise("table").alias("processing_type"),
        F.coalesce(F.bool_or(F.col("event_type") == "signup") & (F.col("user_id") % 3 == 0), F.lit(False)).alias("rag_index_present"))
    errors = monitor.first_errors(events, "user_id", "event_id", F.col("props"), (F.col("event_type") == "error") & (F.col("value") > 50))
    return totals.join(files, "user_id").join(errors, "user_id", "left")


_HEALTH = """
    k AS (SELECT user_id, event_type, max(value) >= 150 AS there FROM events GROUP BY ALL),
    f AS (SELECT user_id, avg(there::INT) AS availability, string_agg(event_type, ', ' ORDER BY event_type) FILTER (NOT there) AS gone FROM k GROUP BY 1),
    e AS (SELECT user_id, count(*) AS n, string_agg('Error: ' || props, '; ' ORDER BY event_id) FILTER (r <= 5) AS listed FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type = 'error' AND value > 50) GROUP BY 1),
    l AS (SELECT user_id, max(value) AS latency, user_id % 2 = 0 AND NOT (bool_or(event_type = 'signup') AND user_id % 3 = 0) AS noindex FROM events GROUP BY 1),
    s AS (SELECT l.user_id, availability, gone, listed, latency, noindex, greatest(0, least(100, 100 - (1 - availability) * 40 - CASE WHEN latency > 300 THEN 20 ELSE 0 END
          - CASE WHEN noindex THEN 20 ELSE 0 END - least(20, coalesce(n, 0) * 5))) AS score
          FROM l JOIN f USING (user_id) LEFT JOIN e USING (user_id))"""


@query("health_score", f"""
    WITH {_HEALTH} SELECT user_id, round(availability, 6) AS availability, round(score, 6) AS health_score,
        CASE WHEN score >= 80 THEN 'healthy' WHEN score >= 50 THEN 'degraded' ELSE 'failing' END AS status FROM s""")
def health_score(t):
    return monitor.health(session_rows(t), 300).select(
        "user_id", F.round("availability", 6).alias("availability"), F.round("health_score", 6).alias("health_score"), "status")


@query("alerts", f"""
    WITH {_HEALTH} SELECT user_id, concat_ws('; ', 'Missing files: ' || gone, CASE WHEN latency > 300 THEN 'High answer latency: ' || latency || ' ms > 300 ms' END,
        CASE WHEN noindex THEN 'RAG index not found after qualitative processing' END, listed) AS alerts FROM s""")
def alerts(t):
    return monitor.health(session_rows(t), 300).select("user_id", F.array_join("alerts", "; ").alias("alerts"))


@query("window_health", """
    WITH w AS (SELECT ts::DATE::TIMESTAMP AS a, user_id % 10 AS node, count(*) AS events, count_if(event_type = 'error')::BIGINT AS errors, max(value) AS latency_ms
               FROM events GROUP BY ALL), s AS (SELECT *, 100 - CASE WHEN latency_ms > 100 THEN 20 ELSE 0 END - least(20, errors * 5) AS score FROM w)
    SELECT a AS window_start, a + INTERVAL 1 DAY AS window_end, node, events, errors, latency_ms, score::DOUBLE AS health_score,
           CASE WHEN score >= 80 THEN 'healthy' WHEN score >= 50 THEN 'degraded' ELSE 'failing' END AS status FROM s""")
def window_health(t):
    events = t("events").withColumn("node", F.col("user_id") % 10)
    return windowed_health(events, "ts", "value", F.col("event_type") == "error", ["node"], threshold_ms=100)


@query("window_totals", """
    SELECT ts::DATE::TIMESTAMP AS window_start, ts::DATE::TIMESTAMP + INTERVAL 1 DAY AS window_end, event_type, count(*) AS events, round(sum(value), 2) AS value
    FROM events GROUP BY ALL""")
def window_totals(t):
    return windowed_totals(t("events"), "ts", "value", ["event_type"]).withColumn("value", F.round("value", 2))


def step_log(t):
    """Events as steps: signups are root nodes, errors failed, views are still running."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("completed")
    return t("events").select(
        F.col("user_id").alias("session_id"), F.when(F.col("event_type") == "signup", "ROOT").otherwise(F.col("event_type")).alias("step_id"),
        status.alias("status"), F.col("value").alias("cost"), F.length("props").cast("bigint").alias("input_tokens"),
        F.col("event_id").alias("output_tokens"))


@query("step_summary", """
    SELECT user_id AS session_id, count_if(event_type IN ('click', 'purchase'))::BIGINT AS completed_steps, count_if(event_type = 'error')::BIGINT AS failed_steps,
           count(*) AS total_steps, round(sum(value), 2) AS total_cost, sum(length(props))::BIGINT AS total_input_tokens, sum(event_id)::BIGINT AS total_output_tokens
    FROM events WHERE event_type <> 'signup' GROUP BY 1""")
def step_summary(t):
    return monitor.step_summary(step_log(t)).withColumn("total_cost", F.round("total_cost", 2))


@query("run_summary", """
    WITH g AS (SELECT user_id, count(*) AS requested, count_if(event_type <> 'error')::BIGINT AS created, sum(value) AS seconds FROM events GROUP BY 1)
    SELECT user_id, requested, created, round(seconds, 2) AS seconds, round(created / requested, 8) AS success_rate, round(created / seconds, 8) AS charts_per_second,
           CASE WHEN created = 0 THEN 'failed' WHEN created < requested THEN 'partial_success' ELSE 'success' END AS status FROM g""")
def run_summary(t):
    runs = t("events").withColumn("made", F.col("event_type") != "error")
    out = monitor.run_summary(runs, ["user_id"], "made", "value")
    return out.withColumns({"seconds": F.round("seconds", 2), "success_rate": F.round("success_rate", 8),
                            "charts_per_second": F.round("charts_per_second", 8)})


@query("final_answers", """
    WITH s AS (SELECT conv_id, max(text) FILTER (turn = 0 AND conv_id % 2 = 0) AS own FROM conversations GROUP BY 1),
    r AS (SELECT conv_id, max(text) AS found FROM conversations WHERE role = 'assistant' GROUP BY 1)
    SELECT conv_id AS session_id, md5(coalesce(own, found)) AS final_answer, 'quantitative' AS primary_classification, 'None' AS secondary_classification
    FROM s LEFT JOIN r USING (conv_id)""")
def final_answers(t):
    turns = t("conversations").withColumnRenamed("conv_id", "session_id")
    sessions = turns.groupBy("session_id").agg(
        F.max(F.when((F.col("turn") == 0) & (F.col("session_id") % 2 == 0), F.col("text"))).alias("answer")).withColumns({
            "primary_classification": F.lit("quantitative"), "secondary_classification": F.lit("")})
    steps = turns.select("session_id", F.col("text").alias("output"),
                         F.when(F.col("role") == "assistant", "rag_processing").otherwise("planning").alias("step_id"))
    return monitor.answers(sessions, steps).withColumn("final_answer", F.md5("final_answer"))


@query("manifest_check", f"""
    WITH {_FILES} SELECT session, round(avg((size > 1000)::INT), 8) AS availability FROM files GROUP BY 1""")
def manifest_check(t):
    files = uploads(t)
    checked = matching.check_manifest(files.select("session", "path"), files.where(F.col("size") > 1000), "path")
    return matching.availability(checked, ["session"]).withColumn("availability", F.round("availability", 8))


@query("asset_match", """
    WITH a AS (SELECT c_custkey, '/charts/' || c_mktsegment || '_' || n_name || '_' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.html' ELSE '.svg' END AS path
               FROM customer JOIN nation ON c_nationkey = n_nationkey),
    m AS (SELECT n_name, min_by(path, c_custkey) FILTER (path LIKE '%.html') AS html_path, min_by(path, c_custkey) FILTER (path LIKE '%.png') AS png_path,
                 min_by(path, c_custkey) FILTER (path LIKE '%.svg') AS svg_path
          FROM nation LEFT JOIN a ON contains(lower(regexp_replace(path, '^.*/|\\.[a-z]+$', '', 'g')), lower(n_name)) GROUP BY 1)
    SELECT n_name, CASE WHEN n_name LIKE 'A%' THEN 'given.html' ELSE html_path END AS html_path, png_path, svg_path FROM m""")
def asset_match(t):
    nations = t("nation").select("n_nationkey", "n_name")
    ending = F.when(F.col("c_custkey") % 3 == 0, ".png").when(F.col("c_custkey") % 3 == 1, ".html").otherwise(".svg")
    files = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(
        F.lit("/charts/"), "c_mktsegment", F.lit("_"), "n_name", F.lit("_"), F.col("c_custkey").cast("string"), ending).alias("path"))
    given = nations.where(F.startswith("n_name", F.lit("A"))).select(
        "n_name", F.lit("given.html").alias("html_path"), F.lit(None).cast("string").alias("png_path"), F.lit("").alias("svg_path"))
    return matching.match_assets(nations.select(F.lower("n_name").alias("key"), "n_name"), "n_name", files, "path", given, "c_custkey").drop("key")


@query("chart_keep", """
    WITH done AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) || '_' || p_size AS id FROM part WHERE p_size < 20)
    SELECT p_partkey FROM part WHERE EXISTS (FROM done WHERE contains(lower(replace('Chart ' || p_name || ' ' || p_size, ' ', '_')), id)
        OR contains(lower(replace(p_brand || ' ' || split_part(p_name, ' ', 1) || ' ' || p_size || ' view', ' ', '_')), id))""")
def chart_keep(t):
    first = F.split("p_name", " ")[0]
    done = t("part").where("p_size < 20").select(F.concat(F.lower(first), F.lit("_"), F.col("p_size").cast("string")).alias("chart_id"))
    charts = t("part").select("p_partkey", F.concat(F.lit("Chart "), "p_name", F.lit(" "), F.col("p_size").cast("string")).alias("name"),
                              F.concat("p_brand", F.lit(" "), first, F.lit(" "), F.col("p_size").cast("string"), F.lit(" view")).alias("title"))
    return matching.keep_successful(charts, "name", "title", done, "chart_id").select("p_partkey")


@query("chart_results", """
    SELECT n_nationkey, n_name, customers FROM nation LEFT JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS customers FROM customer
        WHERE c_acctbal > 9900 GROUP BY 1) USING (n_nationkey)""")
def chart_results(t):
    results = t("customer").where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    return matching.with_results(t("nation").select("n_nationkey", "n_name"), results, "n_nationkey")


@query("chart_urls", """
    SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'https://charts/promo' END AS chart_url, 'https://charts/promo' AS combined_url FROM part""")
def chart_urls(t):
    urls = t("part").where("p_type = 'PROMO'").select(F.col("p_type").alias("name"), F.lit("https://charts/promo").alias("url")).distinct()
    return matching.attach_urls(t("part").select("p_partkey", F.col("p_type").alias("title")), urls).drop("title")


@query("missing_formats", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'html' WHEN 'O' THEN 'png,svg' ELSE '' END AS missing FROM orders""")
def missing_formats(t):
    expected = F.array(F.lit("html"), F.lit("png"), F.lit("svg"))
    made = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("svg"), F.lit("png"))).when(
        F.col("o_orderstatus") == "O", F.array(F.lit("html"))).otherwise(expected)
    return t("orders").select("o_orderkey", F.array_join(matching.missing_formats(expected, made), ",").alias("missing"))
