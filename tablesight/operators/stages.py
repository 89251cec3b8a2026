"""The fixed stages behind every chart: filter → compute → top-N → aggregate → pivot → sort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tablesight.functions.expressions import compute, is_in, predicate
from tablesight.functions.nulls import col, join_on, sum_or_zero
from tablesight.operators.quantiles import exact_quantiles
from tablesight.plans.spec import ChartSpec, SpecError

# A cross table has at most so many columns; more values of the head column have to be named, or gathered in one column.
MOST_HEADS = 10_000

_ANY_TYPE = ("count", "size", "min", "max", "nunique", "first", "last")


def filter_rows(df: DataFrame, conf: Mapping[str, Any] | None, params: Mapping[str, Any] | None = None) -> DataFrame:
    """Rows passing the predicate, the value lists and the closed ranges; unknown columns are skipped."""
    conf = conf or {}
    if conf.get("query"):
        df = df.where(predicate(conf["query"], df.schema, params))
    for name, allowed in (conf.get("in") or {}).items():
        if name in df.columns:
            df = df.where(is_in(col(name), list(allowed)))
    for name, (low, high) in (conf.get("range") or {}).items():
        if name in df.columns:
            df = df.where(col(name).between(low, high))
    return df


def add_computed(df: DataFrame, exprs: Mapping[str, str] | None, params: Mapping[str, Any] | None = None) -> DataFrame:
    """Add columns one after the other, so that a later one may use an earlier one."""
    for name, text in (exprs or {}).items():
        df = df.withColumn(name, compute(text, df.schema, params))
    return df


def top_n_overall(df: DataFrame, by: str, category: str, n: int) -> DataFrame:
    """Rows of the ``n`` categories with the largest totals; a null category can win."""
    winners = (
        df.groupBy(col(category).alias("_winner")).agg(sum_or_zero(col(by)).alias("_total"))
        .orderBy(F.col("_total").desc(), F.col("_winner").asc_nulls_last()).limit(n).select("_winner")
    )
    return df.join(winners, col(category).eqNullSafe(F.col("_winner")), "left_semi")


def top_n_per_group(df: DataFrame, by: str, category: str, group: str, n: int) -> DataFrame:
    """Rows of each group's ``n`` largest categories; null groups and categories are dropped."""
    rank = W.partitionBy("_group").orderBy(F.col("_total").desc(), F.col("_winner"))
    winners = (
        df.where(col(category).isNotNull() & col(group).isNotNull())
        .groupBy(col(group).alias("_group"), col(category).alias("_winner"))
        .agg(sum_or_zero(col(by)).alias("_total"))
        .withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= n)
        .select("_group", "_winner")
    )
    # The number of groups is not known, so the join strategy is left to the optimizer.
    return df.join(winners, (col(group) == F.col("_group")) & (col(category) == F.col("_winner")), "left_semi")


def aggregate_function(name: str, value: Column, order: Column | None = None) -> Column:
    """One named aggregate of a column."""
    name = str(name).lower()
    if name in ("first", "last"):
        if order is None:
            return F.first(value, True) if name == "first" else F.last(value, True)
        known = F.when(value.isNotNull(), order)
        return F.min_by(value, known) if name == "first" else F.max_by(value, known)
    functions = {
        "sum": sum_or_zero, "mean": F.avg, "avg": F.avg, "average": F.avg, "min": F.min, "max": F.max,
        "count": F.count, "size": lambda _: F.count(F.lit(1)), "std": F.stddev_samp, "var": F.var_samp,
        "nunique": F.countDistinct, "prod": F.product,
    }
    if name not in functions:
        raise SpecError(f"unknown aggregate function {name!r}")
    return functions[name](value)


def plan_measures(how: Any, measures: Sequence[str]) -> list[tuple[str, str, str]]:
    """(column, function, output name) triples for a function, a list by position, or a mapping."""
    if isinstance(how, str):
        return [(m, how, m) for m in measures]
    if isinstance(how, Mapping):
        nested = any(not isinstance(f, str) for f in how.values())
        return [
            (m, f, f"{m}_{f}" if nested else m)
            for m, fs in how.items() for f in ([fs] if isinstance(fs, str) else fs)
        ]
    if isinstance(how, (list, tuple)) and how:
        return [(m, how[min(i, len(how) - 1)], m) for i, m in enumerate(measures)]
    raise SpecError("aggregate.how must be a function name, a list or a mapping")


def _check(df: DataFrame, keys: Sequence[str], plan: Sequence[tuple[str, str, str]]) -> None:
    for k in keys:
        if k not in df.columns:
            raise SpecError(f"groupby '{k}' not in columns")
    for m, f, _ in plan:
        if m not in df.columns:
            raise SpecError(f"measure '{m}' not in columns")
        if f.lower() not in _ANY_TYPE and not isinstance(df.schema[m].dataType, T.NumericType):
            raise SpecError(f"{f} needs numbers, and '{m}' has none")


def aggregate(df: DataFrame, keys: Sequence[str], measures: Sequence[str], how: Any = "sum") -> DataFrame:
    """Group by ``keys`` (null keys kept) and aggregate. Counting a key itself yields column ``value``."""
    plan = plan_measures(how, measures)
    _check(df, keys, plan)
    plan = [(m, f, "value" if out in keys else out) for m, f, out in plan]
    order = F.col("_row_id") if "_row_id" in df.columns else None
    quick = [(m, f, out) for m, f, out in plan if f.lower() != "median"]
    columns = [aggregate_function(f, col(m), order).alias(out) for m, f, out in quick]
    grouped = df.groupBy(*[col(k) for k in keys])
    result = grouped.agg(*columns) if columns else df.select(*[col(k) for k in keys]).distinct()
    for m, f, out in plan:
        if f.lower() == "median":
            medians = exact_quantiles(df, [m], [0.5], keys).select(
                *[col(k) for k in keys], F.col("quantile").alias(out))
            result = join_on(result, medians, keys)
    return result.select(*[col(k) for k in keys], *[col(out) for _, _, out in plan])


def aggregate_all(df: DataFrame, measures: Sequence[str], how: Any = "sum") -> DataFrame:
    """Aggregate the whole table: one row, or with a list of functions one row per function."""
    if isinstance(how, (list, tuple)):
        plan = [(m, f, f"{m}_{f}") for f in how for m in measures]
        _check(df, [], plan)
        wide = _one_row(df, plan)
        rows = F.array(*[
            F.struct(F.lit(f).alias("func"), *[col(f"{m}_{f}").cast("double").alias(m) for m in measures])
            for f in how
        ])
        return wide.select(F.inline(rows))
    plan = plan_measures(how, measures)
    _check(df, [], plan)
    return _one_row(df, plan)


def _one_row(df: DataFrame, plan) -> DataFrame:
    order = F.col("_row_id") if "_row_id" in df.columns else None
    columns = []
    for m, f, out in plan:
        if f.lower() == "median":
            middle = exact_quantiles(df, [m], [0.5]).agg(F.max("quantile")).scalar()
            columns.append(F.any_value(middle).alias(out))
        else:
            columns.append(aggregate_function(f, col(m), order).alias(out))
    return df.agg(*columns)


def pivot(df: DataFrame, index: Sequence[str], columns: str, values: str, aggfunc: str = "sum",
          fill_value: Any = 0, heads: Sequence[Any] | None = None, most_heads: int = MOST_HEADS, other: str | None = None) -> DataFrame:
    """Cross table. Null keys are dropped; every other observed key stays; empty cells get ``fill_value``.

    The columns are ``heads``, or all observed keys: one per column of the result. Of more than ``most_heads`` keys the most frequent ones
    stay (ties: the smaller), and the rows of all others make the column ``other``; without such a name they are refused.
    """
    kept = df.where(col(columns).isNotNull())
    for k in index:
        kept = kept.where(col(k).isNotNull())
    plan = [(values, aggfunc, values)]
    _check(df, [*index, columns], plan)
    if heads is None:
        counted = kept.groupBy(col(columns).alias("_head")).agg(F.count(F.lit(1)).alias("_n"))
        frequent = counted.orderBy(F.desc("_n"), "_head").limit(most_heads + 1).select("_head")
        heads = [h[0] for h in frequent.orderBy("_head").collect()]
        if len(heads) > most_heads:
            if other is None:
                raise SpecError(f"{columns} has more than {most_heads} values: name the heads, or a column for the others")
            kept, heads = _gathered(kept, columns, frequent.limit(most_heads), other)
    cell = aggregate_function(aggfunc, col(values)) if aggfunc != "sum" else F.sum(col(values))
    # Aggregating per (index, column) first keeps the pivot itself on the small result.
    cells = kept.groupBy(*[col(k) for k in index], col(columns)).agg(cell.alias("_cell"))
    wide = cells.groupBy(*[col(k) for k in index]).pivot(columns, heads).agg(F.first("_cell"))
    names = [c for c in wide.columns if c not in index]
    if fill_value is None:
        return wide
    return wide.select(*[col(k) for k in index],
                       *[F.coalesce(col(c), F.lit(fill_value)).alias(c) for c in names])


def _gathered(df: DataFrame, name: str, frequent: DataFrame, other: str) -> tuple[DataFrame, list[str]]:
    """The table with all keys but the frequent ones replaced by ``other``, and the keys in order. As many as columns, so they are broadcast."""
    as_text = frequent.select(col("_head").cast("string").alias("_text"), "_head")
    heads = [h[0] for h in as_text.orderBy("_head").select("_text").collect()]
    known = df.join(F.broadcast(as_text.select("_text")), col(name).cast("string") == F.col("_text"), "left")
    return known.withColumn(name, F.coalesce("_text", F.lit(other))).drop("_text"), [*(h for h in heads if h != other), other]


def sort_rows(df: DataFrame, by: Sequence[str], ascending: bool = True) -> DataFrame:
    """Sort with missing values last; a key that is not a column leaves the table as it is."""
    if not by or any(b not in df.columns for b in by):
        return df
    return df.orderBy(*[col(b).asc_nulls_last() if ascending else col(b).desc_nulls_last() for b in by])


def before_aggregate(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """Filter, compute and top-N of a specification."""
    df = add_computed(filter_rows(df, spec.filter, spec.params), spec.compute, spec.params)
    t = spec.top_n
    if t and t.by in df.columns and t.category in df.columns:
        if t.scope == "per_group" and t.group in df.columns:
            df = top_n_per_group(df, t.by, t.category, t.group, t.n)
        else:
            df = top_n_overall(df, t.by, t.category, t.n)
    return df


def run_stages(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """All stages of a specification in their fixed order."""
    df = before_aggregate(df, spec)
    a = spec.aggregate
    if a and a.measures:
        df = aggregate(df, a.groupby, a.measures, a.how) if a.groupby else aggregate_all(df, a.measures, a.how)
    elif a and isinstance(a.how, Mapping):
        df = aggregate(df, a.groupby, [], a.how) if a.groupby else aggregate_all(df, [], a.how)
    if spec.pivot:
        p = spec.pivot
        df = pivot(df, p["index"], p["columns"], p["values"], p["aggfunc"], p["fill_value"], p.get("heads"))
    return sort_rows(df, spec.sort_by, spec.ascending)
