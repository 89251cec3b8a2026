"""URL verdicts from a list of host and path rules, by hashed expressions.

Each URL is expanded into pairs of a host suffix and a path prefix. Pairs meet rules on a short prefix of
their digest; the full digest confirms a match, and the longest matching rule decides. DataFrame functions only.

Defined results: a null URL or one without ``://`` has an empty host and path and gets the default verdict
unless a rule fits those; repeated rows are judged one by one; an empty table gives no rows; of two equally long rules
that fit, or of one rule with both verdicts, ``block`` wins; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PREFIX_DIGITS = 8  # hexadecimal digits of the digest that the join uses
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host after the first ``://``, and the path up to a query or fragment."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _keyed(rules: DataFrame) -> DataFrame:
    """One row per distinct rule, with its digest and the shape of the expressions that can meet it."""
    host, path = F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))
    return (
        rules.select(F.translate(host, UPPER, LOWER).alias("r_host"), path.alias("r_path"), "verdict")
        .groupBy("r_host", "r_path").agg(F.max(F.col("verdict") == "block").alias("r_block"))
        .select("r_host", "r_path", "r_block", _digest(F.col("r_host"), F.col("r_path")).alias("r_digest"),
                _labels(F.col("r_host")).alias("labels"), F.length("r_path").alias("chars"))
        .withColumn("r_prefix", F.substring("r_digest", 1, PREFIX_DIGITS)))


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = "allow") -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row. ``rules`` has ``host``, ``path`` and ``verdict``.

    Only expressions of a shape that some rule has (labels of its host, characters of its path) can match, so
    only these are made. The shapes are collected: their number is bounded by the lengths of host names and
    paths, not by the number of rules or URLs.
    """
    keyed = _keyed(rules)
    shapes = [(r.labels, r.chars) for r in keyed.select("labels", "chars").distinct().collect()]
    host, path = host_and_path(F.col("url"))
    rows = (
        urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
        .select("id", host.alias("host"), path.alias("path"))
        .withColumn("row", F.monotonically_increasing_id()))
    parts = F.split("host", r"\.", -1)
    expressions = [
        F.when((F.size(parts) >= labels) & (F.length("path") >= chars), F.struct(
            F.array_join(F.slice(parts, -labels, labels), ".").alias("x_host"),
            F.substring("path", 1, chars).alias("x_path")))
        for labels, chars in shapes]
    made = F.filter(F.array(*expressions), lambda e: e.isNotNull()) if expressions else F.lit(None).cast(
        "array<struct<x_host:string,x_path:string>>")
    digest = _digest(F.col("e.x_host"), F.col("e.x_path"))
    found = (
        rows.withColumn("e", F.explode_outer(made)).withColumn("digest", digest)
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
        .join(keyed, F.col("prefix") == F.col("r_prefix"), "left"))
    length = F.length("r_host") + F.length("r_path")
    best = F.max(F.when(F.col("digest") == F.col("r_digest"), F.struct(
        length.alias("length"), F.col("r_block").alias("block"), F.concat("r_host", "r_path").alias("rule"))))
    return (
        found.groupBy("row", "id", "host", "path").agg(best.alias("best"))
        .select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
                F.when(F.col("best.block"), "block").when(~F.col("best.block"), "allow").otherwise(default)
                .alias("verdict")))
