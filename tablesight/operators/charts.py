"""The data behind each chart type. Rendering is up to the caller."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from tablesight.functions.nulls import col, join_on, sum_or_zero, try_double
from tablesight.functions.storage import store
from tablesight.operators.stages import aggregate, aggregate_function, before_aggregate, run_stages, sort_rows
from tablesight.plans import ChartSpec, Guide, SchemaRoles, SpecError, make_spec, schema_roles

PREVIEW_ROWS = 50
TABLE_ROWS = 20
# Values of y and of x in a block of a heatmap's grid, and cells that one task makes.
_GRID_BLOCK, _GRID_LINES, _TASK_CELLS, _MOST_TASKS = 1_000, 100, 4_000_000, 10_000
OTHERS = "(others)"


def chart_data(df: DataFrame, spec: Mapping[str, Any] | ChartSpec, roles: SchemaRoles | None = None,
               aliases=()) -> DataFrame:
    """Rows that a chart of this specification shows."""
    if not isinstance(spec, ChartSpec):
        spec = make_spec(spec, roles or schema_roles(df), aliases)
    return _BUILDERS[spec.type](df, spec)


def preview(df: DataFrame, limit: int | None = None) -> DataFrame:
    """First rows of the table, shown when a chart's fields cannot be resolved."""
    return _head(df, PREVIEW_ROWS if limit is None else limit)


def _head(df: DataFrame, n: int) -> DataFrame:
    ordered = df.orderBy("_row_id") if "_row_id" in df.columns else df
    return ordered.limit(n).drop("_row_id")


def _missing(df: DataFrame, spec: ChartSpec, *fields: str | None) -> bool:
    columns = set(df.columns) | set(spec.compute)
    return any(f is None or f not in columns for f in fields)


def line(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """y per x, split by color, facets and frame, in the order of x."""
    how = spec.aggregate.how if spec.aggregate else "sum"
    if spec.x is None or (spec.y is None and not isinstance(how, Mapping)):
        return preview(df, spec.limit)
    if spec.aggregate and not spec.pivot:
        keys = tuple(dict.fromkeys((*spec.aggregate.groupby, *_split_keys(spec, spec.symbol))))
        spec = replace(spec, aggregate=replace(spec.aggregate, groupby=keys))
    data = run_stages(df, spec)
    if spec.sort_by:
        return data
    keys = [k for k in dict.fromkeys((spec.x, *_split_keys(spec, spec.symbol))) if k in data.columns]
    return sort_rows(data, keys)


def _split_keys(spec: ChartSpec, *more: str | None) -> tuple[str, ...]:
    return tuple(k for k in (spec.color, *spec.extra_keys, *more) if k)


def bar(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """One value per x and split, largest first. Rows are aggregated exactly once."""
    a = spec.aggregate
    if spec.x is None or (spec.y is None and not (a and a.how == "count")):
        return preview(df, spec.limit)
    if not a or not isinstance(a.how, str) or spec.pivot:
        return run_stages(df, spec)
    data = before_aggregate(df, spec)
    if spec.x not in data.columns:
        raise SpecError(f"x '{spec.x}' not in columns")
    keys = list(dict.fromkeys((spec.x, *a.groupby, *_split_keys(spec))))
    measure = a.measures[0] if a.measures else spec.y
    data = data.where(col(spec.x).isNotNull())
    if a.how == "count":
        counted = F.count(col(measure)) if measure in data.columns else F.count(F.lit(1))
        result = data.groupBy(*[col(k) for k in keys]).agg(counted.alias("value"))
    else:
        if measure not in data.columns:
            raise SpecError(f"measure '{measure}' not in columns")
        data = data.select(*[col(k) for k in keys], try_double(col(measure)).alias("_y")).where("_y IS NOT NULL")
        result = aggregate(data, keys, ["_y"], a.how).withColumnRenamed("_y", "value")
    if spec.sort_by:
        return sort_rows(result, spec.sort_by, spec.ascending)
    return result.orderBy(F.col("value").desc(), *[col(k).asc() for k in keys])


def collapse_bars(bars: DataFrame, x: str, value: str = "value") -> DataFrame:
    """Total per category over all splits, largest first."""
    label = F.coalesce(col(x).cast("string"), F.lit(""))
    number = try_double(col(value))
    return (
        bars.where(number.isNotNull()).groupBy(label.alias(x)).agg(F.sum(number).alias("value"))
        .orderBy(F.col("value").desc(), col(x))
    )


def scatter(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """The points with their encodings; rows are combined only when asked."""
    if spec.x is None or spec.y is None:
        return preview(df, spec.limit)
    data = run_stages(df, spec)
    wanted = (spec.x, spec.y, spec.color, spec.size, spec.symbol, *spec.extra_keys, *spec.hover)
    return data.select(*[col(c) for c in dict.fromkeys(w for w in wanted if w in data.columns)])


def trend_line(df: DataFrame, spec: Mapping[str, Any] | ChartSpec) -> DataFrame:
    """Least-squares line per trace of a scatter chart: slope, intercept, r2 and points used."""
    if not isinstance(spec, ChartSpec):
        spec = make_spec(spec, schema_roles(df))
    data = scatter(df, spec)
    keys = [k for k in dict.fromkeys((spec.color, spec.symbol, *spec.extra_keys)) if k and k in data.columns]
    x, y = _number(data, spec.x), _number(data, spec.y)
    return data.groupBy(*[col(k) for k in keys]).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def _number(df: DataFrame, name: str):
    if isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col(name).cast("timestamp")).cast("double") / 1e6
    return try_double(col(name))


def grid(sums: DataFrame, x: str, y: str, value: str, fill: float = 0.0) -> DataFrame:
    """Every pairing of the x and y values, with ``fill`` where nothing was observed.

    Both sides are dealt into blocks by their hash, and each x is matched with every block of y values. The pairs of blocks are
    spread over tasks by the number of cells they make, since the few bytes that go in say nothing of the product that comes out.
    """
    nx, ny = sums.agg(F.count_distinct(col(x)), F.count_distinct(col(y))).first()
    x_blocks, y_blocks = max(1, math.ceil(nx / _GRID_LINES)), max(1, math.ceil(ny / _GRID_BLOCK))
    tasks = max(1, min(x_blocks * y_blocks, math.ceil(nx * ny / _TASK_CELLS), _MOST_TASKS))

    def block(name: str, n: int):
        return F.pmod(F.xxhash64(col(name)), F.lit(n)).cast("int")

    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    observed = sums.select(
        col(x), block(y, y_blocks).alias("_j"),
        F.struct(col(y).alias("y"), F.coalesce(col(value).cast("double"), F.lit(fill)).alias("v")).alias("_cell"))
    # A null for every line and block plus the observed cells: one aggregation instead of a second join.
    empty = sums.select(col(x)).distinct().select(
        col(x), each(y_blocks).alias("_j"), F.lit(None).cast(observed.schema["_cell"].dataType).alias("_cell"))
    lines = (
        empty.unionByName(observed).groupBy(col(x), "_j").agg(F.collect_list("_cell").alias("_seen"))
        .withColumn("_i", block(x, x_blocks))
    )
    packed = (
        sums.select(col(y)).distinct().groupBy(block(y, y_blocks).alias("_j")).agg(F.collect_list(col(y)).alias("_ys"))
        .withColumn("_i", each(x_blocks))
    )
    if tasks > 1:
        lines, packed = (side.repartition(tasks, "_i", "_j") for side in (lines, packed))
    pairs = lines.join(packed, ["_i", "_j"])
    unseen = F.transform(F.array_except("_ys", F.col("_seen.y")), lambda v: F.struct(v.alias("y"), F.lit(fill).alias("v")))
    cells = pairs.select(col(x), F.explode(F.concat("_seen", unseen)).alias("_cell"))
    return cells.select(col(x), F.col("_cell.y").alias(y), F.col("_cell.v").alias(value))


def coarse_cells(sums: DataFrame, x: str, y: str, value: str, most_cells: int) -> DataFrame:
    """Sums per cell of a grid that has at most ``most_cells`` cells; a grid that has no more stays as it is.

    The axis with fewer values keeps them while they fit, the other is divided: numbers and times into ranges of equal width, known by
    where they begin; of other values those with the largest sums stay (ties: the smaller), the rest is ``OTHERS``.
    """
    nx, ny = sums.agg(F.count_distinct(col(x)), F.count_distinct(col(y))).first()
    if nx * ny <= most_cells:
        return sums
    side = max(1, math.isqrt(most_cells))
    few = max(1, min(nx, ny, side))
    sizes = {x: few if nx <= ny else max(1, most_cells // few), y: few if ny < nx else max(1, most_cells // few)}
    for name, n in ((x, nx), (y, ny)):
        if n > sizes[name]:
            label = _ranges if _is_scale(sums, name) else _largest
            sums = label(sums, name, value, sizes[name])
    return sums.groupBy(col(x), col(y)).agg(F.sum(col(value)).alias(value))


def _is_scale(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _ranges(sums: DataFrame, name: str, value: str, n: int) -> DataFrame:
    number, dtype = _number(sums, name), sums.schema[name].dataType
    lo, hi = sums.agg(F.min(number), F.max(number)).first()
    begin = F.lit(lo) + F.least(F.floor((number - lo) / (hi - lo) * n), F.lit(n - 1)) * ((hi - lo) / n)
    if not isinstance(dtype, T.NumericType):
        begin = F.timestamp_micros((begin * 1e6).cast("long")).cast("timestamp" if isinstance(dtype, T.TimestampType) else "timestamp_ntz")
    return sums.withColumn(name, begin)


def _largest(sums: DataFrame, name: str, value: str, n: int) -> DataFrame:
    # As many rows as an axis has values.
    top = (sums.groupBy(col(name).cast("string").alias("_key")).agg(F.sum(col(value)).alias("_sum"))
           .orderBy(F.desc("_sum"), "_key").limit(n - 1).select("_key"))
    known = sums.join(F.broadcast(top), col(name).cast("string") == F.col("_key"), "left")
    return known.withColumn(name, F.coalesce("_key", F.lit(OTHERS))).drop("_key")


def heatmap(df: DataFrame, spec: ChartSpec, most_cells: int | None = None) -> DataFrame:
    """Sum of the value in each cell of the full x × y grid of any size; null keys are dropped.

    Only a caller who names ``most_cells`` gets a grid of more cells made coarser, see ``coarse_cells``.
    """
    if _missing(df, spec, spec.x, spec.y, spec.value):
        return preview(df, spec.limit)
    data = run_stages(df, replace(spec, sort_by=()))
    if any(c not in data.columns for c in (spec.x, spec.y, spec.value)):
        return preview(df, spec.limit)
    sums = (
        data.where(col(spec.x).isNotNull() & col(spec.y).isNotNull())
        .groupBy(col(spec.x), col(spec.y)).agg(sum_or_zero(col(spec.value)).cast("double").alias(spec.value))
    )
    sums = store(sums)
    if most_cells is not None:
        sums = coarse_cells(sums, spec.x, spec.y, spec.value, most_cells)
    return grid(sums, spec.x, spec.y, spec.value).orderBy(col(spec.y), col(spec.x))


def hierarchy(df: DataFrame, path, value: str) -> DataFrame:
    """Sums at every level of a path: columns of the path, ``level`` (0 = everything) and ``value``."""
    path = list(path)
    parts = [F.coalesce(col(p).cast("string"), F.lit("Unknown")).alias(p) for p in path]
    leaves = df.groupBy(*parts).agg(sum_or_zero(col(value)).alias("_sum"))
    # The leaves are already summed, so the rollup repeats only those per level.
    return (
        leaves.rollup(*[col(p) for p in path])
        .agg(F.sum("_sum").alias("value"), F.grouping_id().alias("_gid"))
        .withColumn("level", (F.lit(len(path)) - F.bit_count("_gid")).cast("int"))
        .select(*[col(p) for p in path], "level", "value")
    )


def treemap(df: DataFrame, spec: ChartSpec) -> DataFrame:
    if spec.value is None:
        return preview(df, spec.limit)
    data = run_stages(df, replace(spec, sort_by=()))
    path = [p for p in spec.path if p in data.columns]
    if not path or spec.value not in data.columns:
        return preview(df, spec.limit)
    tree = hierarchy(data, path, spec.value)
    return sort_rows(tree, spec.sort_by or ("level", *path), spec.ascending)


def table(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """First rows after every stage."""
    limit = TABLE_ROWS if spec.limit is None else spec.limit
    data = run_stages(df, spec)
    return data.limit(limit).drop("_row_id") if spec.sort_by else _head(data, limit)


def histogram(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """Equal-width bins over the value range, the last one closed; empty bins are kept."""
    if spec.x is None:
        return preview(df, spec.limit)
    data = run_stages(df, replace(spec, sort_by=()))
    if spec.x not in data.columns:
        return preview(df, spec.limit)
    keys = [k for k in (spec.color, *spec.extra_keys) if k and k in data.columns and k != spec.x]
    y = spec.y if spec.y in data.columns else None
    return bins(data, spec.x, spec.nbins, y, spec.histfunc, keys)


def bins(df: DataFrame, x: str, nbins: int = 20, y: str | None = None, histfunc: str | None = None,
         keys=()) -> DataFrame:
    """Histogram rows ``(bin, low, high, center, *keys, value)``."""
    keys = list(keys)
    func = (histfunc or ("sum" if y else "count")).lower()
    rows = df.select(
        _number(df, x).alias("_v"), *[col(k) for k in keys],
        (try_double(col(y)) if y else F.lit(1.0)).alias("_y")).where("_v IS NOT NULL")
    # A constant column gets one unit around its value.
    flat = F.min("_v") == F.max("_v")
    span = rows.agg(F.struct(
        F.when(flat, F.min("_v") - 0.5).otherwise(F.min("_v")).alias("lo"),
        F.when(flat, F.max("_v") + 0.5).otherwise(F.max("_v")).alias("hi"))).scalar()

    def edge(i):
        return F.col("_s.lo") + i * F.col("_step")

    # The bounds are attached once as columns; the expressions below use them many times.
    step = ((F.col("_s.hi") - F.col("_s.lo")) / nbins).alias("_step")
    v, guess = F.col("_v"), F.col("_i")
    placed = rows.withColumn("_s", span).select("*", step).withColumn(
        "_i", F.least(F.floor((v - F.col("_s.lo")) / (F.col("_s.hi") - F.col("_s.lo")) * nbins), F.lit(nbins - 1)))
    # Values next to an edge go where the edge itself says, not where rounding put them.
    index = F.when(v < edge(guess), guess - 1).when(
        (v >= edge(guess + 1)) & (guess < nbins - 1), guess + 1).otherwise(guess)
    value = F.count(F.lit(1)) if func == "count" and not y else (
        F.count("_y") if func == "count" else aggregate_function(func, F.col("_y")))
    filled = placed.groupBy(index.cast("int").alias("bin"), *[col(k) for k in keys]).agg(value.alias("value"))

    if keys:
        # Every observed split gets all bins.
        splits = filled.select(*[col(k) for k in keys]).distinct()
        frame = splits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))))
    else:
        frame = df.sparkSession.range(nbins).select(F.col("id").cast("int").alias("bin"))
    out = join_on(frame, filled, ["bin", *keys])
    if func in ("count", "sum"):
        out = out.withColumn("value", F.coalesce("value", F.lit(0)))
    b = F.col("bin")
    # Without any value there are no bounds and no bins.
    bounded = out.withColumn("_s", span).where(F.col("_s.lo").isNotNull()).select("*", step)
    return bounded.select("bin", edge(b).alias("low"), edge(b + 1).alias("high"),
                          ((edge(b) + edge(b + 1)) / 2).alias("center"), *[col(k) for k in keys], "value")


def pie(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """Rows per name with their share; counted after filter and top-N, never after aggregation."""
    data = before_aggregate(df, spec)
    if spec.names is None or spec.names not in data.columns:
        return preview(df, spec.limit)
    keys = [spec.names, *[k for k in (spec.facet_row, spec.facet_col) if k and k != spec.names]]
    counts = data.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("count"))
    return with_share(counts, "count").orderBy(F.col("count").desc(), col(spec.names))


def with_share(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Add each row's part of the column's total."""
    total = df.agg(F.sum(col(value))).scalar()
    return df.withColumn(name, F.try_divide(col(value).cast("double"), total.cast("double")))


def with_group_value(df: DataFrame, by, measure: str, how: str = "sum", name: str | None = None) -> DataFrame:
    """Add the aggregate of a row's group to the row.

    The groups are aggregated first and joined back, so a group of any size is never held in one task.
    """
    by = [by] if isinstance(by, str) else list(by)
    name = name or f"{measure}_{how}"
    groups = df.groupBy(*[col(k) for k in by]).agg(aggregate_function(how, col(measure)).alias(name))
    return join_on(df, groups, by)


_BUILDERS = {
    "line": line, "bar": bar, "scatter": scatter, "heatmap": heatmap, "treemap": treemap,
    "table": table, "histogram": histogram, "pie": pie,
}


def run_report(df: DataFrame, guide: Mapping[str, Any] | Guide, materialise: bool = False) -> dict[str, DataFrame]:
    """Data of every chart of a guide by chart name. A chart that cannot be built is skipped with a warning.

    Charts on columnar files read only their own columns, so by default nothing is stored. With
    ``materialise`` the typed base table is written once to the shared folder, which pays off when
    reading it again is dear (text files with inferred types).
    """
    guide = guide if isinstance(guide, Guide) else Guide.from_dict(guide)
    if materialise and len(guide.charts) > 1:
        df = store(df)
    roles = schema_roles(df)
    result: dict[str, DataFrame] = {}
    for i, raw in enumerate(guide.charts, start=1):
        try:
            spec = make_spec(raw, roles, guide.columns, i)
            name = spec.name if spec.name not in result else f"{spec.name} ({i})"
            result[name] = chart_data(df, spec)
        except Exception as err:  # noqa: BLE001 - one bad chart must not stop the report
            warnings.warn(f"chart {i} ({raw.get('name') or raw.get('title')}) skipped: {err}", stacklevel=2)
    return result
