"""Descriptions of charts embedded in web pages: plot calls, JSON scripts, data attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablesight.functions.nulls import col
from tablesight.operators.html import blank_to_null, page_parts, page_text

# How plot calls and their settings look in page source.
PLOT_CALL = r"(?s)Plotly\.newPlot\s*\(\s*[^,]+,\s*(\[.*?\])\s*,\s*(\{.*?\})\s*[,\)]"
TITLE_PATTERNS = (
    r'"title"\s*:\s*\{\s*"text"\s*:\s*"([^"]+)"',
    r'"title"\s*:\s*"([^"]+)"',
    r'title\s*:\s*\{\s*text\s*:\s*"([^"]+)"',
    r'title\s*:\s*"([^"]+)"',
)
AXIS_PATTERNS = (
    ("X-axis", r'"xaxis"\s*:\s*\{[^}]*"title"\s*:\s*(?:"([^"]+)"|\{"text"\s*:\s*"([^"]+)")'),
    ("Y-axis", r'"yaxis"\s*:\s*\{[^}]*"title"\s*:\s*(?:"([^"]+)"|\{"text"\s*:\s*"([^"]+)")'),
    ("X-axis", r'xaxis\s*:\s*\{[^}]*title\s*:\s*(?:"([^"]+)"|\{text\s*:\s*"([^"]+)")'),
    ("Y-axis", r'yaxis\s*:\s*\{[^}]*title\s*:\s*(?:"([^"]+)"|\{text\s*:\s*"([^"]+)")'),
)
NAME_PATTERNS = (r'"name"\s*:\s*"([^"]+)"', r'name\s*:\s*"([^"]+)"')
TYPE_PATTERNS = (r'"type"\s*:\s*"([^"]+)"', r'type\s*:\s*"([^"]+)"')
KNOWN_TYPES = ("bar", "scatter", "line", "pie", "heatmap", "box", "histogram", "surface", "mesh3d")
POINT_FIELDS = ("y", "x", "values", "z")

_VARIANTS = "array<variant>"


def _text_or_nested(value: Column, path: str) -> Column:
    """A title given either as a string or as ``{text: ...}``."""
    nested = F.try_variant_get(value, f"{path}.text", "string")
    plain = F.transform(F.array(F.try_variant_get(value, path, "string")), lambda p: F.when(~F.startswith(p, F.lit("{")), p))[0]
    return F.coalesce(nested, plain)


def describe_figure(data: Column, layout: Column) -> Column:
    """Lines on title, axes and traces of one figure, given as VARIANT values."""
    labelled = lambda label, v: F.concat(F.lit(f"{label}: "), blank_to_null(F.trim(v)))

    def trace(t: Column, i: Column) -> Column:
        points = F.coalesce(*[F.size(F.try_variant_get(t, f"$.{f}", _VARIANTS)) for f in POINT_FIELDS])
        kind = F.coalesce(F.try_variant_get(t, "$.type", "string"), F.try_variant_get(t, "$.marker.type", "string"))
        return F.concat_ws(
            ", ", F.concat(F.lit("Trace "), (i + 1).cast("string")), F.concat(F.lit("type="), kind),
            F.concat(F.lit("name="), F.try_variant_get(t, "$.name", "string")),
            F.concat(F.lit("points="), points.cast("string")))

    is_object = lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    traces = F.coalesce(F.try_variant_get(data, "$", _VARIANTS), F.array().cast(_VARIANTS))
    lines = F.concat(
        F.array(labelled("Title", _text_or_nested(layout, "$.title")),
                labelled("X-axis", _text_or_nested(layout, "$.xaxis.title")),
                labelled("Y-axis", _text_or_nested(layout, "$.yaxis.title"))),
        F.transform(traces, lambda t, i: F.when(is_object(t), trace(t, i))))
    return F.array_join(F.array_compact(lines), "\n")


def _figures(jsons: Column) -> Column:
    """Descriptions of JSON texts with ``data`` and ``layout``, at the top or under ``figure``.

    Each step binds its result to the next one's variable, so that a text is parsed only once.
    """
    parsed = F.transform(jsons, lambda j: F.try_parse_json(j))
    part = lambda v, name: F.coalesce(
        F.try_variant_get(v, f"$.{name}", "variant"), F.try_variant_get(v, f"$.figure.{name}", "variant"))
    halves = F.transform(parsed, lambda v: F.struct(part(v, "data").alias("d"), part(v, "layout").alias("l"), v.alias("v")))
    return F.transform(halves, lambda h: F.struct(describe_figure(h["d"], h["l"]).alias("text"), h["v"].alias("v")))


def _join_blocks(blocks: Column) -> Column:
    return F.array_join(F.filter(blocks, lambda b: b != ""), "\n\n")


def plot_call_summary(html: Column) -> Column:
    """Description of every plot call in page source; calls whose arguments are not JSON are left out."""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(PLOT_CALL), F.lit(1)).alias("d"),
                         F.regexp_extract_all(html, F.lit(PLOT_CALL), F.lit(2)).alias("l"))
    parsed = F.transform(pairs, lambda p: F.struct(
        F.try_parse_json(p["d"]).alias("d"), _parse_object(p["l"]).alias("l")))
    return _join_blocks(F.transform(parsed, lambda p: describe_figure(p["d"], p["l"])))


def _parse_object(json: Column) -> Column:
    """A JSON object whose closing braces may have been cut off."""
    missing = F.length(F.regexp_replace(json, r"[^{]", "")) - F.length(F.regexp_replace(json, r"[^}]", ""))
    return F.coalesce(F.try_parse_json(json), F.try_parse_json(F.concat(json, F.repeat(F.lit("}"), missing))))


def script_summary(scripts: Column) -> Column:
    """Description of figures in script blocks, each given as type, line break, content."""
    split = F.transform(scripts, lambda s: F.struct(
        F.lower(F.substring_index(s, "\n", 1)).alias("kind"), F.regexp_replace(s, r"^[^\n]*\n", "").alias("body")))
    usable = lambda s: (s["kind"] == "") | F.contains(s["kind"], F.lit("json")) | F.contains(
        s["kind"], F.lit("javascript"))
    bodies = F.transform(F.filter(split, usable), lambda s: s["body"])
    return _join_blocks(F.transform(_figures(bodies), lambda f: f["text"]))


def attribute_summary(figures: Column) -> Column:
    """Description of figures in data attributes; text that is not JSON is kept as it is."""
    def one(a: Column, f: Column) -> Column:
        title = F.concat(F.lit("Title: "), F.try_variant_get(f["v"], "$.title", "string"))
        return F.when(f["v"].isNull(), a).otherwise(
            F.when(f["text"] != "", f["text"]).otherwise(F.coalesce(title, F.lit(""))))
    return _join_blocks(F.zip_with(figures, _figures(figures), one))


def pattern_summary(html: Column) -> Column:
    """Description of a page from patterns alone, over its whole source."""
    first = lambda p: F.nullif(F.regexp_extract(html, p, 1), F.lit(""))
    title = F.coalesce(*[first(p) for p in TITLE_PATTERNS])
    axes = [F.concat(F.lit(f"{label}: "), F.coalesce(
        F.nullif(F.regexp_extract(html, p, 1), F.lit("")), F.nullif(F.regexp_extract(html, p, 2), F.lit(""))))
        for label, p in AXIS_PATTERNS]
    found = lambda patterns: F.array_sort(F.array_distinct(F.concat(*[
        F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in patterns])))
    names = found(NAME_PATTERNS)
    kinds = F.array_intersect(found(TYPE_PATTERNS), F.array(*[F.lit(t) for t in KNOWN_TYPES]))
    listed = lambda label, a: F.when(F.size(a) > 0, F.concat(F.lit(label), F.array_join(a, ", ")))
    return F.array_join(F.array_compact(F.array(
        F.concat(F.lit("Title: "), title), *axes, listed("Data series: ", names), listed("Chart types: ", kinds))), "\n")


def figure_summary(html: Column) -> Column:
    """What a page of any length says about its charts: calls, else scripts, else attributes, else patterns."""
    return F.coalesce(blank_to_null(plot_call_summary(html)), blank_to_null(script_summary(F.col("scripts"))),
                      blank_to_null(attribute_summary(F.col("figures"))), pattern_summary(html))


def extract_html(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Rows ``(key, text, source)``: page text, else its tables, else a description of its charts."""
    parts = page_parts(pages, key, html)
    known = parts.select(
        col(key), blank_to_null(page_text()).alias("_text"), blank_to_null(F.array_join("tables", "\n\n")).alias("_tables"),
        "source", "scripts", "figures")
    has_text, has_tables = F.col("_text").isNotNull(), F.col("_tables").isNotNull()
    return known.select(
        col(key),
        F.when(has_text, F.col("_text")).when(has_tables, F.col("_tables")).otherwise(
            figure_summary(F.coalesce("source", F.lit("")))).alias("text"),
        F.when(has_text, "text").when(has_tables, "tables").otherwise("charts").alias("source"))
