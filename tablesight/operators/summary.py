"""Condensed facts about a chart or a table: extremes, totals, indicators, findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from tablesight.functions.nulls import col, try_double
from tablesight.operators.charts import with_share
from tablesight.operators.stages import aggregate_all, aggregate_function
from tablesight.plans.spec import parse_measure

TOP = 5


def _per_label(df: DataFrame, x: str, y: str, agg: str) -> DataFrame:
    """Rows ``(label, value)``: one per x with an aggregate, one per row without."""
    known = df.where(col(x).isNotNull())
    if agg == "none":
        rows = known.select(col(x).cast("string").alias("label"), try_double(col(y)).alias("value"))
    else:
        rows = known.groupBy(col(x).cast("string").alias("label")).agg(
            aggregate_function(agg, col(y)).cast("double").alias("value"))
    return rows.where(F.col("value").isNotNull())


def chart_summary(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """One row of facts about a chart: its top and bottom labels, extremes, total or average, and the
    ratio of the first to the second. Without usable x and y only ``chart_type`` is set.
    """
    function, y = parse_measure(spec.get("y"))
    agg = function or str(spec.get("aggregation") or "none").lower()
    x, kind = spec.get("x"), spec.get("type")
    entry = "struct<label:string,value:double>"
    if not (x and y and x in df.columns and y in df.columns):
        nothing = {"x": "string", "y": "string", "agg": "string", "top": f"array<{entry}>",
                   "bottom": f"array<{entry}>", "max": entry, "min": entry,
                   "total_or_average": "double", "top_vs_second_ratio": "double"}
        return df.sparkSession.range(1).select(
            *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()], F.lit(kind).alias("chart_type"))

    values = _per_label(df, x, y, agg)
    total = F.sum("value") if agg in ("sum", "count") else F.avg("value")

    def ends(descending: bool):
        order = F.col("value").desc() if descending else F.col("value").asc()
        first = values.orderBy(order, F.col("label")).limit(TOP)
        sign = -F.col("value") if descending else F.col("value")
        packed = F.array_sort(F.collect_list(F.struct(sign.alias("s"), "label", "value")))
        return first.agg(F.transform(packed, lambda e: F.struct(e["label"], e["value"]))).scalar()

    facts = values.agg(total.alias("total_or_average"), F.count(F.lit(1)).alias("_n")).select(
        "total_or_average", "_n", ends(True).alias("top"), ends(False).alias("bottom"))
    usable = F.col("_n") > 0
    second = F.get("top", F.lit(1))["value"]
    return facts.select(
        F.when(usable, F.lit(x)).alias("x"), F.when(usable, F.lit(y)).alias("y"),
        F.when(usable, F.lit(agg)).alias("agg"),
        F.when(usable, F.col("top")).alias("top"), F.when(usable, F.col("bottom")).alias("bottom"),
        F.get("top", F.lit(0)).alias("max"), F.get("bottom", F.lit(0)).alias("min"),
        "total_or_average",
        F.when(F.col("_n") >= 2, F.try_divide(F.get("top", F.lit(0))["value"], second)).alias("top_vs_second_ratio"),
        F.lit(kind).alias("chart_type"))


def findings(summary: DataFrame) -> DataFrame:
    """Sentences with numbers for a chart summary: extremes, lead over the second, total."""
    amount = lambda v: F.format_number(v, 2)
    lines = F.array(
        F.format_string("%s has the highest %s (%s)", F.col("max.label"), F.col("y"), amount(F.col("max.value"))),
        F.when(F.col("top_vs_second_ratio").isNotNull(), F.format_string(
            "%s is %.1fx %s", F.get("top", F.lit(0))["label"], F.col("top_vs_second_ratio"),
            F.get("top", F.lit(1))["label"])),
        F.format_string("%s has the lowest %s (%s)", F.col("min.label"), F.col("y"), amount(F.col("min.value"))),
        F.format_string("%s of %s is %s", F.when(F.col("agg").isin("sum", "count"), "total").otherwise("average"),
                        F.col("y"), amount(F.col("total_or_average"))))
    return summary.where(F.col("x").isNotNull()).select(F.posexplode(F.array_compact(lines)).alias("position", "finding"))


def kpis(df: DataFrame, formulas: Mapping[str, str]) -> DataFrame:
    """Rows ``(name, formula, value)`` for indicators written as ``function(column)``; one pass in all."""
    columns = []
    for i, (name, formula) in enumerate(formulas.items()):
        function, measure = parse_measure(formula)
        function = function or formula.split("(", 1)[0].strip().lower()
        value = F.lit(1) if measure == "*" else col(measure)
        columns.append(aggregate_function("size" if measure == "*" else function, value).cast("double").alias(f"v{i}"))
    wide = df.agg(*columns)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(formula).alias("formula"), F.col(f"v{i}").alias("value"))
        for i, (name, formula) in enumerate(formulas.items())
    ])))


def top_performers(df: DataFrame, by: str, measure: str, n: int = 10, how: str = "sum") -> DataFrame:
    """Rows ``(rank, item, value, contribution)``: the ``n`` largest groups and their share of the total."""
    groups = df.groupBy(col(by).alias("item")).agg(aggregate_function(how, col(measure)).alias("value"))
    top = with_share(groups, "value", "contribution").orderBy(F.col("value").desc(), F.col("item")).limit(n)
    packed = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("s"), "item", "value", "contribution")))
    # At most n rows are left, so numbering them through an array is cheap.
    return top.agg(packed.alias("p")).select(F.posexplode("p").alias("i", "e")).select(
        (F.col("i") + 1).alias("rank"), "e.item", "e.value", "e.contribution")


def compare_groups(df: DataFrame, by: str, measures: Sequence[str], how: str = "mean") -> DataFrame:
    """Per group each measure's aggregate and its ratio to the same aggregate over everything."""
    overall = aggregate_all(df, measures, how).agg(
        F.first(F.struct(*[col(m).alias(f"m{i}") for i, m in enumerate(measures)]))).scalar()
    groups = df.groupBy(col(by)).agg(
        F.count(F.lit(1)).alias("rows"), *[aggregate_function(how, col(m)).alias(m) for m in measures])
    return groups.withColumn("_all", overall).withColumns({
        f"{m}_ratio": F.try_divide(col(m).cast("double"), F.col("_all")[f"m{i}"].cast("double"))
        for i, m in enumerate(measures)
    }).drop("_all")
