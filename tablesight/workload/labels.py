"""Labels of questions and requests over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesight.functions.text import letters_and_digits, report_file_name, slug
from tablesight.operators import labels
from tablesight.workload.registry import query


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


# Requests that each turn stands for: its own text behind one of several openings.
_OPENINGS = ("Summarize ", "How many ", "Plot a chart of ", "Write a report on ", "Explain the average of ", "")
_REQUEST = "(CASE turn % 6 " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(_OPENINGS)) + " END || text)"


def _requests(t):
    opening = F.lit("")
    for i, words in enumerate(_OPENINGS):
        opening = F.when(F.col("turn") % 6 == i, words).otherwise(opening)
    return t("conversations").select("conv_id", "turn", "role", F.concat(opening, F.col("text")).alias("request"))


@query("intent_label", f"""
    SELECT conv_id, turn, CASE WHEN {_any('q', labels.QUALITATIVE)} AND NOT {_any('q', labels.QUANTITATIVE)} THEN 'qualitative'
                               ELSE 'quantitative' END AS intent
    FROM (SELECT conv_id, turn, lower(trim({_REQUEST})) AS q FROM conversations)""")
def intent_label(t):
    return _requests(t).select("conv_id", "turn", labels.intent(F.col("request")).alias("intent"))


@query("output_mode", f"""
    SELECT conv_id, turn, CASE WHEN r AND NOT c THEN 'report' WHEN c AND NOT r THEN 'plotly' WHEN s THEN 'plotly' ELSE 'report' END AS mode
    FROM (SELECT conv_id, turn, {_any('q', labels.REPORT_WORDS)} AS r, {_any('q', labels.CHART_WORDS)} OR s AS c, s
          FROM (SELECT conv_id, turn, lower({_REQUEST}) AS q, role = 'user' AS s FROM conversations))""")
def output_mode(t):
    mode = labels.output_mode(F.col("request"), F.col("role") == "user")
    return _requests(t).select("conv_id", "turn", mode.alias("mode"))


@query("export_mode", """
    SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'report_only' WHEN 1 THEN 'plotly_only' ELSE 'both' END AS mode FROM conversations""")
def export_mode(t):
    wanted = F.when(F.col("turn") % 3 == 0, " Report").when(F.col("turn") % 3 == 1, "CHART ")
    return t("conversations").select("conv_id", "turn", labels.export_mode(wanted).alias("mode"))


@query("route_steps", f"""
    SELECT conv_id, turn, CASE WHEN intent = 'qualitative' THEN 'retrieval,monitoring'
        WHEN files AND (kind <> 'None' OR {_any('q', labels.ROUTE_CHART_WORDS)} OR NOT indexed) THEN 'processing,charts,monitoring'
        WHEN files THEN 'processing,retrieval,monitoring' WHEN kind <> 'None' THEN 'charts,monitoring'
        ELSE 'retrieval,monitoring' END AS steps
    FROM (SELECT *, CASE WHEN {_any('q', labels.QUALITATIVE)} AND NOT {_any('q', labels.QUANTITATIVE)} THEN 'qualitative' ELSE 'quantitative' END AS intent
          FROM (SELECT conv_id, turn, lower({_REQUEST}) AS q, role = 'user' AS files, conv_id % 2 = 0 AS indexed,
                       CASE conv_id % 4 WHEN 1 THEN 'Chart' ELSE 'None' END AS kind FROM conversations))""")
def route_steps(t):
    secondary = F.when(F.col("conv_id") % 4 == 1, "Chart").otherwise("None")
    steps = labels.route(F.col("request"), labels.intent(F.col("request")), secondary,
                         F.col("role") == "user", F.col("conv_id") % 2 == 0)
    return _requests(t).select("conv_id", "turn", F.array_join(steps, ",").alias("steps"))


@query("slugs", r"""
    SELECT p_partkey, left(regexp_replace(regexp_replace(lower('Show: ' || p_name || '  (by ' || p_brand || ')!'), '[^\w\s-]', '', 'g'), '\s+', '_', 'g'), 50) AS slug,
           regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '.html' AS file,
           regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS key FROM part""")
def slugs(t):
    request = F.concat(F.lit("Show: "), "p_name", F.lit("  (by "), "p_brand", F.lit(")!"))
    return t("part").select("p_partkey", slug(request).alias("slug"),
                            report_file_name(F.concat("p_name", F.lit(" / "), "p_brand")).alias("file"),
                            letters_and_digits(F.col("p_brand")).alias("key"))
