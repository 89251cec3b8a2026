"""Matches between lists of charts, insights, narratives, files and addresses, written as joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tablesight.functions.nulls import col, join_on
from tablesight.functions.text import letters_and_digits, stem, suffix

# File types of an insight's assets.
ASSET_SUFFIXES = {"html_path": (".html",), "png_path": (".png", ".jpg", ".jpeg"), "svg_path": (".svg",)}

# Needles of up to this size, with what a node takes, become one automaton in every executor.
AUTOMATON_BYTES = 16 * 1024 * 1024
NODE_BYTES = 64
GRAM = 3


def containing(hay: DataFrame, text: str, needles: DataFrame, needle: str, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Pairs of rows in which the needle occurs in the text. Needles must be distinct; null and empty ones match nothing.

    Up to ``automaton_bytes`` of needles go to every executor as one automaton, which finds all of them in a single pass over
    a text; nothing but the pairs is shuffled. More needles are found by their rarest substring of three characters. Both columns are compared as
    they are; fold case before.
    """
    known = needles.where(F.length(col(needle)) > 0)
    size = known.agg(F.coalesce(F.sum(F.octet_length(col(needle)) + NODE_BYTES), F.lit(0))).first()[0]
    return (_by_automaton if size <= automaton_bytes else _by_rare_gram)(hay, text, known, needle)


def _by_automaton(hay: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    # At most ``automaton_bytes`` of text, as just measured.
    shared = hay.sparkSession.sparkContext.broadcast([r[0] for r in needles.select(col(needle)).collect()])

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for word in shared.value:
            automaton.add_word(word, word)
        automaton.make_automaton()
        some = len(automaton) > 0
        for batch in batches:
            yield pd.Series([sorted({word for _, word in automaton.iter(t)}) if some and t else [] for t in batch], dtype=object)

    hits = hay.withColumn("_key", F.explode(found(col(text))))
    if needles.columns == [needle]:
        return hits.withColumnRenamed("_key", needle)
    return hits.join(needles, F.col("_key") == col(needle)).drop("_key")


def _by_rare_gram(hay: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Every needle is looked for where its rarest gram occurs; a needle with a gram that no text holds is nowhere."""

    def grams(df: DataFrame, name: str, lengths) -> DataFrame:
        starts = lambda n: F.transform(
            F.sequence(F.lit(1), F.length(col(name)) - n + 1), lambda i: F.substring(col(name), i, n))
        sizes = df.withColumn("_n", F.explode(lengths)).where(F.length(col(name)) >= F.col("_n"))
        return sizes.withColumn("_gram", F.explode(F.array_distinct(starts(F.col("_n"))))).drop("_n")

    # Shorter needles are grams themselves, so there are at most three lengths.
    of_needle = F.least(F.length(col(needle)), F.lit(GRAM))
    lengths = needles.agg(F.collect_set(of_needle)).scalar()
    keys = grams(needles, needle, F.array(of_needle))
    in_texts = grams(hay.select(col(text)), text, lengths).groupBy("_gram").agg(F.count(F.lit(1)).alias("_texts"))
    chosen = (keys.select(col(needle).alias("_needle"), "_gram").join(in_texts, "_gram", "left").groupBy("_needle")
              .agg(F.min_by("_gram", F.struct(F.coalesce("_texts", F.lit(0)), "_gram")).alias("_gram")))
    wanted = needles.join(chosen, col(needle) == F.col("_needle")).drop("_needle")
    return grams(hay, text, lengths).join(wanted, "_gram").where(F.contains(col(text), col(needle))).drop("_gram")


def with_results(charts: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Each chart with its result by id; charts without one stay."""
    return charts.join(results, key, "left")


def keep_successful(charts: DataFrame, name: str, title: str, done: DataFrame, done_id: str) -> DataFrame:
    """Charts whose name or title contains the id of a chart that was made."""
    ids = done.select(col(done_id).alias("_id")).distinct()
    form = lambda c: F.replace(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(" "), F.lit("_"))
    texts = charts.select(F.explode(F.array_distinct(F.array(form(name), form(title)))).alias("_text")).distinct()
    hits = containing(texts, "_text", ids, "_id").select("_text").distinct()
    named = charts.withColumns({"_name": form(name), "_title": form(title)})
    found = lambda c: named.join(hits.withColumnRenamed("_text", c), c, "left_semi")
    by_name = found("_name")
    by_title = named.join(hits.withColumnRenamed("_text", "_name"), "_name", "left_anti").join(
        hits.withColumnRenamed("_text", "_title"), "_title", "left_semi")
    return by_name.unionByName(by_title).select(*[col(c) for c in charts.columns])


def match_assets(insights: DataFrame, key: str, files: DataFrame, path: str, explicit: DataFrame | None = None,
                 order: str | None = None) -> DataFrame:
    """Adds ``html_path``, ``png_path`` and ``svg_path`` to rows with an id.

    An explicit table ``(key, html_path, png_path, svg_path)`` wins; else the first file in ``order``
    whose name contains the id, whatever the case.
    """
    rank = col(order) if order else col(path)
    listed = files.select(col(path).alias("_path"), F.lower(stem(col(path))).alias("_stem"),
                          suffix(col(path)).alias("_suffix"), rank.alias("_rank"))
    ids = insights.select(F.lower(col(key)).alias("_id")).distinct()
    matches = containing(listed, "_stem", ids, "_id")
    best = matches.groupBy("_id").agg(*[
        F.min_by("_path", F.when(F.col("_suffix").isin(*exts), F.struct("_rank", "_path"))).alias(f"_{name}")
        for name, exts in ASSET_SUFFIXES.items()
    ])
    out = insights.join(best, F.lower(col(key)) == F.col("_id"), "left")
    if explicit is None:
        picked = {name: F.col(f"_{name}") for name in ASSET_SUFFIXES}
    else:
        given = explicit.select(col(key).alias("_ekey"), *[F.col(n).alias(f"_e_{n}") for n in ASSET_SUFFIXES])
        out = out.join(given, col(key) == F.col("_ekey"), "left")
        picked = {name: F.coalesce(F.nullif(f"_e_{name}", F.lit("")), F.col(f"_{name}")) for name in ASSET_SUFFIXES}
    return out.withColumns(picked).select(
        *[col(c) for c in insights.columns if c not in ASSET_SUFFIXES], *ASSET_SUFFIXES)


def missing_assets(matched: DataFrame) -> DataFrame:
    """Rows without any file."""
    return matched.where(F.coalesce(*ASSET_SUFFIXES).isNull())


def attach_narratives(insights: DataFrame, sections: DataFrame, doc: str) -> DataFrame:
    """Each insight's narrative: by position when a document has as many sections, else by heading.

    A heading given twice counts with its last body; an insight without a match keeps its own text.
    """
    counts = sections.groupBy(col(doc)).agg(F.count(F.lit(1)).alias("_sections"))
    sizes = insights.groupBy(col(doc)).agg(F.count(F.lit(1)).alias("_insights"))
    same = join_on(sizes, counts, [doc], "inner").select(
        col(doc), (F.col("_sections") == F.col("_insights")).alias("_aligned"))
    rows = join_on(insights, same, [doc])
    by_position = sections.select(col(doc), "position", F.col("body").alias("_by_position"))
    by_heading = sections.where(F.col("heading").isNotNull()).groupBy(
        col(doc), letters_and_digits(F.col("heading")).alias("_norm")).agg(F.max_by("body", "position").alias("_by_heading"))
    rows = join_on(rows, by_position, [doc, "position"])
    rows = join_on(rows.withColumn("_norm", letters_and_digits(F.col("title"))), by_heading, [doc, "_norm"])
    text = F.when(F.coalesce("_aligned", F.lit(False)), F.col("_by_position")).otherwise(
        F.coalesce("_by_heading", "narrative"))
    return rows.withColumn("narrative", text).select(*[col(c) for c in insights.columns])


def attach_urls(insights: DataFrame, urls: DataFrame, title: str = "title") -> DataFrame:
    """Adds ``chart_url`` by title and, when there is exactly one address, ``combined_url`` for all rows."""
    one = urls.agg(F.when(F.count(F.lit(1)) == 1, F.max("url"))).scalar()
    per_title = urls.groupBy(F.col("name").alias(title)).agg(F.max("url").alias("chart_url"))
    return join_on(insights, per_title, [title]).withColumn("combined_url", one)


def check_manifest(manifest: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Each manifest entry with ``extension`` and whether its file ``exists``."""
    there = files.select(col(path)).distinct().withColumn("_there", F.lit(True))
    checked = manifest.join(there, path, "left")
    return checked.select(
        *[col(c) for c in manifest.columns],
        suffix(F.coalesce(col(path), F.lit(""))).alias("extension"),
        F.coalesce("_there", F.lit(False)).alias("exists"))


def availability(checked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of existing files per group; 1.0 for an empty manifest."""
    ratio = F.coalesce(F.avg(F.col("exists").cast("double")), F.lit(1.0)).alias("availability")
    return checked.groupBy(*[col(b) for b in by]).agg(ratio) if by else checked.agg(ratio)


def missing_formats(expected: Column, created: Column) -> Column:
    """Formats that were asked for and not made."""
    return F.array_except(expected, created)
