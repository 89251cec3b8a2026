"""JSON inside text: blocks from free text, and insight records of uneven shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablesight.functions.nulls import col

# Fixed value: a fenced JSON object in model output.
FENCED = r"(?is)```json\s*(\{.*\})\s*```"
# Where a document may keep its list of insights, in order.
INSIGHT_LISTS = ("per_chart_insights", "insights", "items", "charts")


def fenced_block(text: Column) -> Column:
    """Content of a fenced JSON object whose braces are balanced, else NULL."""
    block = F.nullif(F.regexp_extract(text, FENCED, 1), F.lit(""))
    opened = F.length(F.regexp_replace(block, r"[^{]", ""))
    closed = F.length(F.regexp_replace(block, r"[^}]", ""))
    return F.when(opened == closed, block)


def braced_block(text: Column) -> Column:
    """Text from the first opening to the last closing brace, else NULL."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def json_blocks(df: DataFrame, text: str, required: Sequence[str] = ()) -> DataFrame:
    """Adds ``json``, ``json_source`` (fenced or braced) and ``json_error``.

    The fenced block is used when it parses, else the braced one. A missing required key is an error; so
    is text without a block that parses.
    """
    fenced, braced = fenced_block(col(text)), braced_block(col(text))
    is_object = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    out = df.withColumns({"_f": fenced, "_b": braced}).withColumns({
        "_fok": F.coalesce(is_object(F.try_parse_json("_f")), F.lit(False)),
        "_bok": F.coalesce(is_object(F.try_parse_json("_b")), F.lit(False))})
    source = F.when(F.col("_fok"), "fenced").when(F.col("_bok"), "braced")
    json = F.when(F.col("_fok"), F.col("_f")).when(F.col("_bok"), F.col("_b"))
    missing = F.array_except(F.array(*[F.lit(k) for k in required]).cast("array<string>"), F.json_object_keys(json))
    error = (
        F.when(json.isNull(), "no JSON object could be read")
        .when(F.size(missing) > 0, F.concat(F.lit("missing required key: "), F.get(missing, F.lit(0)))))
    valid = error.isNull()
    return out.select(*[col(c) for c in df.columns], F.when(valid, json).alias("json"),
                      F.when(valid, source).alias("json_source"), error.alias("json_error"))


def accepted(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("json_error").isNull())


def rejected(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("json_error").isNotNull())


def insights(docs: DataFrame, doc: str, json: str) -> DataFrame:
    """One row per insight of each JSON document, with the fallback names of its fields resolved.

    A document is a list of insights, an object holding one under a known name, or a single insight.
    Documents of any other shape give no rows.
    """
    parsed = docs.select(col(doc), F.try_parse_json(col(json)).alias("v"))
    at = lambda path, kind: F.try_variant_get("v", path, kind)
    single = F.when(at("$.visualization_id", "variant").isNotNull() & at("$.title", "variant").isNotNull(),
                    F.array(F.col("v")))
    items = F.coalesce(at("$", "array<variant>"), *[at(f"$.{n}", "array<variant>") for n in INSIGHT_LISTS], single)
    rows = parsed.select(col(doc), F.posexplode(items).alias("position", "x"))
    rows = rows.where(F.startswith(F.schema_of_variant("x"), F.lit("OBJECT")))

    def text(default: str, *names: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_variant_get("x", f"$.{n}", "string"), F.lit("")) for n in names], F.lit(default))

    def texts(*names: str) -> Column:
        lists = [F.try_variant_get("x", f"$.{n}", "array<string>") for n in names]
        return F.coalesce(*[F.when(F.size(v) > 0, v) for v in lists], F.array().cast("array<string>"))

    ref = lambda n: F.try_variant_get("x", f"$.references.{n}", "string").alias(n)
    return rows.select(
        col(doc), "position",
        text("viz", "visualization_id", "id", "viz_id").alias("visualization_id"),
        text("Untitled", "title", "name").alias("title"),
        text("", "primary_insight", "insight").alias("primary_insight"),
        texts("supporting_evidence", "evidence").alias("supporting_evidence"),
        text("", "decision_relevance", "so_what").alias("decision_relevance"),
        texts("caveats", "limitations").alias("caveats"),
        F.struct(ref("html_path"), ref("png_path"), ref("svg_path")).alias("references"),
        text("", "narrative").alias("narrative"))


def narrative_sections(docs: DataFrame, doc: str, json: str) -> DataFrame:
    """One row ``(doc, position, heading, body)`` per narrative section of each JSON document."""
    parsed = docs.select(col(doc), F.try_parse_json(col(json)).alias("v"))
    items = F.try_variant_get("v", "$.narrative_sections", "array<variant>")
    rows = parsed.select(col(doc), F.posexplode(items).alias("position", "x"))
    plain = F.when(F.startswith(F.schema_of_variant("x"), F.lit("STRING")), F.try_variant_get("x", "$", "string"))
    return rows.select(
        col(doc), "position", F.try_variant_get("x", "$.heading", "string").alias("heading"),
        F.coalesce(F.try_variant_get("x", "$.body", "string"), plain, F.lit("")).alias("body"))
