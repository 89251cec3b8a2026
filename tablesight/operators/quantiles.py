"""Exact quantiles without gathering a group in one task.

``percentile`` and ``median`` keep every distinct value of a group in one buffer. Here a first pass finds,
with a mergeable sketch, a narrow bracket of values around each wanted rank; the second pass counts what
lies below the bracket and only the values inside it, pre-aggregated on the map side. The bracket's
width follows from the sketch's error bound, and a rank outside it would fail the query, not change it.

Brackets that still hold many values are narrowed by rounds of histograms: values are counted per bin, and the bin that holds the rank is the next
bracket. Only when a bounded number of values is left they are put in order, so no window sorts a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from tablesight.functions.nulls import col, join_on
from tablesight.functions.storage import store

SKETCH_ACCURACY = 10_000
# The sketch is off by at most 1/accuracy of the rows; the bracket leaves several times that.
_MARGIN = 4.0 / SKETCH_ACCURACY
# Up to this many rows the bracket is the whole group: there the margin would be only a few ranks wide.
_SMALL_GROUP = 5 * SKETCH_ACCURACY
# Up to this many values of a bracket are put in order at once; more are first divided into bins.
SORTED_VALUES = 65_536
BINS = 1_024


def unpivot(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), as_type: str = "double",
            name: str = "column", value: str = "value") -> DataFrame:
    """One row per (row, column): the column's name and its value cast to one type."""
    cells = F.array(*[
        F.struct(F.lit(c).alias(name), col(c).cast(as_type).alias(value)) for c in columns])
    return df.select(*[col(k) for k in keys], F.inline(cells))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                    keys: Sequence[str] = ()) -> DataFrame:
    """Quantiles with linear interpolation: rows ``(*keys, column, probability, quantile)``.

    Three passes over the measures, each aggregated on the map side: brackets, rows below each bracket,
    values inside.
    """
    keys = list(keys)
    key_columns = [col(k) for k in keys]
    # NaN counts as missing. Only the sketch has to be told: NaN is above every bound compared with later.
    numbers = df.select(*key_columns, *[col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    # Target number k asks for one probability of one column.
    targets = [(i, float(p)) for i in range(len(columns)) for p in probabilities]
    sketches = numbers.groupBy(*key_columns).agg(*[x for i in range(len(columns)) for x in _sketch(i, probabilities)])
    brackets = sketches.select(*key_columns, *[
        _bracket(i, j, p, len(probabilities)).alias(f"_t{i * len(probabilities) + j}")
        for i in range(len(columns)) for j, p in enumerate(map(float, probabilities))])
    if keys:
        # Written once: it is read twice, and its size then tells the optimizer how to join it.
        brackets = store(brackets)

        def attach(rows: DataFrame) -> DataFrame:
            return join_on(rows, brackets, keys, "inner")

        at = lambda k, field: F.col(f"_t{k}.{field}")
    else:
        # One row for the whole table: as literals the bounds are cheap to compare and reach the files.
        found = brackets.first()
        at = lambda k, field: F.lit(found[k][field]).cast("double")

        def attach(rows: DataFrame) -> DataFrame:
            return rows

    attached = attach(numbers)
    below = attach(attached.groupBy(*key_columns).agg(*[
        F.count_if(F.col(f"_v{i}") < at(k, "lo")).alias(f"_n{k}") for k, (i, _) in enumerate(targets)]))
    wanted = below.select(*key_columns, F.inline(F.array(*[
        F.struct(F.lit(k).alias("_k"), F.lit(columns[i]).alias("column"), F.lit(p).alias("probability"),
                 at(k, "position").alias("_position"), F.col(f"_n{k}").alias("_below"))
        for k, (i, p) in enumerate(targets)])))

    hits = [F.col(f"_v{i}").between(at(k, "lo"), at(k, "hi")) for k, (i, _) in enumerate(targets)]
    entries = F.array(*[
        F.when(hit, F.struct(F.lit(k).alias("_k"), F.col(f"_v{i}").alias("_v")))
        for hit, (k, (i, _)) in zip(hits, enumerate(targets))])
    # In a large group nearly every row is dropped before it is unfolded.
    inside = attached.where(reduce(or_, hits)).select(*key_columns, F.inline(entries)).where("_k IS NOT NULL")
    counted = inside.groupBy(*key_columns, "_k", "_v").agg(F.count(F.lit(1)).alias("_c"))
    # Quantiles lie between the values at two neighbouring ranks: one search for each.
    ranks = F.array(*[F.struct(F.lit(i).alias("_side"), (f("_position") - F.col("_below")).cast("long").alias("_rank")) for i, f in ((0, F.floor), (1, F.ceil))])
    wanted = wanted.withColumn("_at", F.explode(ranks)).select("*", "_at.*").drop("_at")
    found = _values_at(counted, wanted, keys)
    # A target without values before its rank is missing here or NULL.
    names = [*key_columns, F.col("column"), F.col("probability")]
    out = found.groupBy(*names, "_position").agg(*[F.max(F.when(F.col("_side") == i, F.col("_value"))).alias(n) for i, n in ((0, "_a"), (1, "_z"))])
    covered = F.col("_a").isNotNull() & F.col("_z").isNotNull()
    part = F.col("_position") - F.floor("_position")
    return out.select(*names, F.when(covered, F.col("_a") + (F.col("_z") - F.col("_a")) * part).otherwise(
        F.raise_error(F.lit("quantile rank outside its bracket"))).alias("quantile"))


def _values_at(counted: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``wanted`` with ``_value``: of the counted values of its group and target, the one at ``_rank`` in ascending order.

    NULL where the values end before that rank. Every round divides the range of values by ``BINS``.
    """
    target = [*keys, "_k"]
    columns = [col(k) for k in target]
    counted = store(counted)
    size = counted.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if _many(size):
        state = store(join_on(wanted, size, target, "inner"))
        while _many(state):
            state = store(_narrowed(counted, state, target))
        left = join_on(counted, state, target, "inner").where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    else:
        left = join_on(counted, wanted, target, "inner")
    # At most SORTED_VALUES entries.
    known = [*columns, "_side", "_rank", "column", "probability", "_position"]
    ordered = left.groupBy(*known).agg(F.array_sort(F.collect_list(F.struct("_v", F.col("_c").alias("c")))).alias("_values"))
    return ordered.withColumn("_value", _entry_at(F.col("_values"), F.col("_rank"))["found"]["_v"])


def _narrowed(counted: DataFrame, state: DataFrame, target: Sequence[str]) -> DataFrame:
    """``state`` after one more round: the bin that holds the rank, and the rank within it."""
    columns = [col(k) for k in target]
    large = state.where(F.col("_n") > SORTED_VALUES).select(*columns, "_side", "_rank", "_lo", "_hi")
    values = join_on(counted, large, target, "inner").where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    # Halves before the difference: the range of two finite values need not be finite. Infinite bounds give the first or the last bin.
    place = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    place = F.when(F.col("_v") == F.col("_lo"), 0.0).when(F.col("_v") == F.col("_hi"), 1.0).when(F.isnan(place), 0.5).otherwise(place)
    bins = values.groupBy(*columns, "_side", "_rank", F.least(F.floor(place * BINS), F.lit(BINS)).alias("_bin")).agg(
        F.sum("_c").alias("c"), F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    # At most BINS + 1 entries.
    ordered = bins.groupBy(*columns, "_side", "_rank").agg(F.array_sort(F.collect_list(F.struct("_bin", "c", "n", "lo", "hi"))).alias("_bins"))
    entry = ordered.withColumn("_entry", _entry_at(F.col("_bins"), F.col("_rank"))).select(
        *columns, "_side", F.col("_entry.passed").alias("_passed"), *[F.col(f"_entry.found.{c}").alias(f"_{c}2") for c in ("n", "lo", "hi")])
    again = join_on(state, entry, [*target, "_side"])
    # A rank beyond all values keeps no value.
    gone = F.col("_passed").isNotNull() & F.col("_n2").isNull()
    new = {"_n": F.when(gone, 0).otherwise(F.coalesce("_n2", "_n")), "_rank": F.col("_rank") - F.coalesce("_passed", F.lit(0)),
           "_lo": F.when(~gone, F.coalesce("_lo2", "_lo")), "_hi": F.when(~gone, F.coalesce("_hi2", "_hi"))}
    return again.select(*[new[c].alias(c) if c in new else col(c) for c in state.columns])


def _many(state: DataFrame) -> bool:
    return (state.agg(F.max("_n")).first()[0] or 0) > SORTED_VALUES


def _entry_at(entries: Column, rank: Column) -> Column:
    """Of entries with counts ``c``, the one whose running count first exceeds the rank, and what the ones before it sum up to."""
    start = F.struct(F.lit(0).cast("long").alias("passed"), F.get(entries, F.lit(-1)).alias("found"))
    return F.aggregate(entries, start, lambda a, e: F.when(a["found"].isNotNull() | (rank < 0), a).when(
        a["passed"] + e["c"] > rank, F.struct(a["passed"].alias("passed"), e.alias("found"))).otherwise(
        F.struct((a["passed"] + e["c"]).alias("passed"), a["found"].alias("found"))))


def _sketch(i: int, probabilities: Sequence[float]) -> list[Column]:
    value = F.when(~F.isnan(f"_v{i}"), F.col(f"_v{i}"))
    around = [max(0.0, p - _MARGIN) for p in probabilities] + [min(1.0, p + _MARGIN) for p in probabilities]
    return [F.count(value).alias(f"_n{i}"), F.min(value).alias(f"_min{i}"), F.max(value).alias(f"_max{i}"),
            F.percentile_approx(value, around, SKETCH_ACCURACY).alias(f"_cuts{i}")]


def _bracket(i: int, j: int, probability: float, n_probabilities: int) -> Column:
    """The rank wanted and bounds between which its value lies for certain."""
    n, cuts = F.col(f"_n{i}"), F.col(f"_cuts{i}")
    small = n <= _SMALL_GROUP
    return F.struct(
        (F.lit(probability) * (n - 1)).alias("position"),
        F.when(small | F.lit(probability <= _MARGIN), F.col(f"_min{i}")).otherwise(cuts[j]).alias("lo"),
        F.when(small | F.lit(probability >= 1 - _MARGIN), F.col(f"_max{i}")).otherwise(
            cuts[n_probabilities + j]).alias("hi"))


def quantile_row(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """One row of structs: column → quantiles in the order of ``probabilities`` (NULL when all null)."""
    table = exact_quantiles(df, columns, probabilities)
    return table.agg(*[
        F.array(*[
            F.max(F.when((F.col("column") == c) & (F.col("probability") == float(p)), F.col("quantile")))
            for p in probabilities
        ]).alias(c) for c in columns
    ])


def value_counts(df: DataFrame, columns: Sequence[str], as_type: str = "string") -> DataFrame:
    """Rows ``(column, value, n)``: how often each value occurs, NULL included."""
    return unpivot(df, columns, as_type=as_type).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))


def modes(df: DataFrame, columns: Sequence[str], as_type: str = "string") -> DataFrame:
    """Rows ``(column, value, n)`` with each column's most frequent value, the smallest on ties."""
    counts = value_counts(df, columns, as_type).where(F.col("value").isNotNull())
    # The smallest (-n, value) per column: most frequent first, then the smallest value.
    first = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("minus"), "value")).alias("_first"))
    return first.select("column", "_first.value", (-F.col("_first.minus")).alias("n"))
