"""Statistical analysis of measures: distribution, relation, development over time, groups, tests."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tablesight.functions.nulls import col, join_on
from tablesight.operators.charts import bins
from tablesight.operators.clean import fences
from tablesight.operators.quantiles import modes, quantile_row
from tablesight.operators.stages import aggregate_function

GRANULARITIES = ("day", "week", "month", "quarter", "year")
# A skewed distribution has a third standardised moment beyond this.
SKEW_LIMIT = 0.5
# Excess kurtosis of a uniform distribution is -1.2, of a normal one 0.
FLAT_KURTOSIS = -1.0


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per measure: count, mean, median, mode, std, variance, min, max, range, q1, q3, iqr."""
    quart = quantile_row(df, columns, [0.25, 0.5, 0.75]).agg(
        F.first(F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(columns)]))).scalar()
    usual = modes(df, columns, as_type="double").agg(
        F.map_from_entries(F.collect_list(F.struct("column", "value")))).scalar()
    wide = df.agg(*[x for i, c in enumerate(columns) for x in (
        F.count(col(c)).alias(f"n{i}"), F.avg(col(c)).alias(f"mean{i}"), F.stddev_samp(col(c)).alias(f"std{i}"),
        F.min(col(c)).cast("double").alias(f"min{i}"), F.max(col(c)).cast("double").alias(f"max{i}"))])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"mean{i}").alias("mean"),
                 F.col(f"std{i}").alias("std"), F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"))
        for i, c in enumerate(columns)
    ])
    quartiles = F.create_map(*[v for i, c in enumerate(columns) for v in (F.lit(c), F.col("_quart")[f"c{i}"])])
    q = lambda i: F.col("_q")[i]
    looked_up = wide.select(F.inline(rows)).withColumns({"_quart": quart, "_usual": usual}).withColumn(
        "_q", quartiles[F.col("column")])
    return looked_up.select(
        "column", "count", "mean", q(1).alias("median"), F.col("_usual")[F.col("column")].alias("mode"), "std",
        "min", "max", (F.col("max") - F.col("min")).alias("range"), q(0).alias("q1"), q(2).alias("q3"),
        (q(2) - q(0)).alias("iqr"))


def distribution(df: DataFrame, column: str, nbins: int = 20) -> DataFrame:
    """One row ``(column, skewness, kurtosis, peaks, label)``; label is normal, skewed, bimodal or uniform.

    A peak is a bin higher than both neighbours and at least half as high as the highest one.
    """
    moments = df.agg(F.skewness(col(column)).alias("skewness"), F.kurtosis(col(column)).alias("kurtosis"))
    counts = bins(df, column, nbins).agg(F.array_sort(F.collect_list(F.struct("bin", "value"))).alias("h"))
    heights = counts.select(F.transform("h", lambda e: e["value"]).alias("h"))

    def is_peak(v: Column, i: Column) -> Column:
        left = F.when(i == 0, 0).otherwise(F.get("h", i - 1))
        right = F.coalesce(F.get("h", i + 1), F.lit(0))
        return (v > left) & (v >= right) & (v * 2 >= F.array_max("h"))

    peaks = heights.select(F.size(F.filter("h", is_peak)).alias("n")).scalar()
    out = moments.select(F.lit(column).alias("column"), "skewness", "kurtosis", peaks.alias("peaks"))
    label = (
        F.when(F.abs("skewness") > SKEW_LIMIT, "skewed").when(F.col("peaks") == 2, "bimodal")
        .when(F.col("kurtosis") < FLAT_KURTOSIS, "uniform").otherwise("normal"))
    return out.withColumn("label", label)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows ``(a, b, correlation, n)`` for every pair of measures, all in one aggregate."""
    pairs = list(combinations(columns, 2))
    number = lambda c: col(c).cast("double")
    wide = df.agg(*[x for i, (a, b) in enumerate(pairs) for x in (
        F.corr(number(a), number(b)).alias(f"r{i}"), F.regr_count(number(a), number(b)).alias(f"n{i}"))])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("correlation"),
                 F.col(f"n{i}").alias("n"))
        for i, (a, b) in enumerate(pairs)
    ])))


def period_number(date: Column, granularity: str) -> Column:
    """Running number of the calendar period a date lies in, so that neighbours differ by one."""
    if granularity == "year":
        return F.year(date)
    if granularity == "quarter":
        return F.year(date) * 4 + F.quarter(date)
    if granularity == "month":
        return F.year(date) * 12 + F.month(date)
    days = F.unix_date(date.cast("date"))
    if granularity == "week":
        return F.floor((days + 3) / 7).cast("int")  # weeks start on Monday; day 0 was a Thursday
    if granularity == "day":
        return days
    raise ValueError(f"granularity must be one of {', '.join(GRANULARITIES)}")


def periods(df: DataFrame, date: str, measure: str, granularity: str = "month", how: str = "sum",
            by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(*by, period, number, value)``: the measure aggregated per calendar period."""
    when = col(date)
    start = F.date_trunc(granularity, when).cast("date")
    return df.where(when.isNotNull()).groupBy(
        *[col(b) for b in by], start.alias("period"), period_number(when, granularity).alias("number"),
    ).agg(aggregate_function(how, col(measure)).cast("double").alias("value"))


def trend(df: DataFrame, date: str, measures: Sequence[str], granularity: str = "month", how: str = "sum",
          flat: float = 0.0) -> DataFrame:
    """Rows ``(measure, granularity, periods, slope, strength, direction)``: a line through the periods.

    Strength is the line's r2. All measures share one grouping of the data.
    """
    when = col(date)
    grouped = df.where(when.isNotNull()).groupBy(period_number(when, granularity).alias("number")).agg(
        *[aggregate_function(how, col(m)).cast("double").alias(f"m{i}") for i, m in enumerate(measures)])
    x = F.col("number").cast("double")
    wide = grouped.agg(F.count(F.lit(1)).alias("periods"), *[v for i in range(len(measures)) for v in (
        F.regr_slope(F.col(f"m{i}"), x).alias(f"slope{i}"), F.regr_r2(F.col(f"m{i}"), x).alias(f"r2{i}"))])
    rows = wide.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.lit(granularity).alias("granularity"), F.col("periods"),
                 F.col(f"slope{i}").alias("slope"), F.col(f"r2{i}").alias("strength"))
        for i, m in enumerate(measures)
    ])))
    direction = (F.when(F.col("slope") > flat, "increasing").when(F.col("slope") < -flat, "decreasing")
                 .otherwise("stable"))
    return rows.withColumn("direction", direction)


def growth(df: DataFrame, date: str, measure: str, granularity: str = "month", how: str = "sum",
           by: Sequence[str] = ()) -> DataFrame:
    """Adds the previous calendar period's value and the relative change; NULL where there is none.

    The previous period is found by its number, an equi join of the small per-period tables.
    """
    now = periods(df, date, measure, granularity, how, by)
    before = now.select(*[col(b) for b in by], (F.col("number") + 1).alias("number"), F.col("value").alias("previous"))
    joined = join_on(now, before, [*by, "number"])
    return joined.select(*[col(b) for b in by], "period", "value", "previous",
                         F.try_divide(F.col("value") - F.col("previous"), F.col("previous")).alias("growth"))


def season_slot(period: Column, granularity: str) -> Column:
    """Position of a period in its cycle: weekday, month or quarter of the year."""
    slots = {"day": F.weekday(period) + 1, "month": F.month(period), "quarter": F.quarter(period)}
    if granularity not in slots:
        raise ValueError("seasons need granularity day, month or quarter")
    return slots[granularity]


def decompose(df: DataFrame, date: str, measure: str, granularity: str = "month", how: str = "sum",
              half_window: int | None = None) -> DataFrame:
    """Rows ``(period, value, trend, seasonal, residual)``: moving average, mean deviation per slot, rest.

    The window runs over calendar periods after aggregation, never over the rows of the table.
    """
    half = half_window if half_window is not None else {"day": 3, "month": 6, "quarter": 2}[granularity]
    series = periods(df, date, measure, granularity, how)
    around = W.orderBy("number").rangeBetween(-half, half)
    with_trend = series.withColumn("trend", F.avg("value").over(around)).withColumn(
        "slot", season_slot(F.col("period"), granularity))
    slot = W.partitionBy("slot")
    return with_trend.withColumn("seasonal", F.avg(F.col("value") - F.col("trend")).over(slot)).select(
        "period", "value", "trend", "seasonal", (F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"))


def seasonality(df: DataFrame, date: str, measure: str, granularity: str = "month", how: str = "sum") -> DataFrame:
    """Rows ``(slot, periods, mean, index)``: the slot's mean and its ratio to the mean of all periods."""
    series = periods(df, date, measure, granularity, how).withColumn("slot", season_slot(F.col("period"), granularity))
    overall = series.agg(F.avg("value")).scalar()
    return series.groupBy("slot").agg(F.count(F.lit(1)).alias("periods"), F.avg("value").alias("mean")).withColumn(
        "index", F.try_divide("mean", overall))


def anomalies(df: DataFrame, measure: str, method: str = "zscore", limit: float = 3.0) -> DataFrame:
    """Rows whose measure is unusual, with their ``score`` (z-score, or distance to the fence in IQRs)."""
    if method == "zscore":
        s = df.agg(F.struct(F.avg(col(measure)).alias("m"), F.stddev_pop(col(measure)).alias("s"))).scalar()
        score = F.try_divide(col(measure) - F.col("_s.m"), F.col("_s.s"))
        return df.withColumn("_s", s).withColumn("score", score).drop("_s").where(F.abs("score") > limit)
    if method != "iqr":
        raise ValueError("method must be zscore or iqr")
    f, value = F.col("_f"), col(measure)
    width = f["q3"] - f["q1"]
    score = F.when(value > f["high"], F.try_divide(value - f["q3"], width)).when(
        value < f["low"], F.try_divide(value - f["q1"], width))
    marked = df.withColumn("_f", fences(df, [measure])["c0"]).withColumn("score", score)
    return marked.drop("_f").where(F.col("score").isNotNull())


def segments(df: DataFrame, rules: Mapping[str, str], measures: Sequence[str], default: str = "other") -> DataFrame:
    """Rows ``(segment, size, percentage, {measure}_total, {measure}_mean)``; the first matching rule labels a row."""
    label = F.lit(default)
    for name, text in reversed(list(rules.items())):
        label = F.when(F.expr(text), name).otherwise(label)
    sizes = df.withColumn("segment", label).groupBy("segment").agg(
        F.count(F.lit(1)).alias("size"),
        *[x for m in measures for x in (F.sum(col(m)).alias(f"{m}_total"), F.avg(col(m)).alias(f"{m}_mean"))])
    total = sizes.agg(F.sum("size")).scalar()
    return sizes.withColumn("percentage", F.col("size") * 100.0 / total)


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, value, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(2_000):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + term * d) or tiny)
        c = (1 + term / c) or tiny
        value *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (value - 1)


@F.udf(T.DoubleType())
def _f_tail(f, between, within):
    """Probability of an F value at least this large. Called on results of one row."""
    if f is None or not between or not within or within <= 0:
        return None
    return _beta_share(within / 2, between / 2, within / (within + between * f))


@F.udf(T.DoubleType())
def _t_quantile(probability, dof):
    """The t value that two-sided lies in ``1 - probability``, by bisection."""
    if probability is None or dof is None or dof <= 0:
        return None
    low, high = 0.0, 1e8
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _beta_share(dof / 2, 0.5, dof / (dof + middle * middle)) > probability else (low, middle)
    return (low + high) / 2


def welch_test(df: DataFrame, measure: str, group: str, a, b) -> DataFrame:
    """One row: means, t, degrees of freedom, Cohen's d, p and a 95 % interval of the difference, by Student's t."""
    side = lambda v: F.when(col(group) == v, col(measure).cast("double"))
    m = df.agg(*[x for n, v in (("a", a), ("b", b)) for x in (
        F.count(side(v)).alias(f"n_{n}"), F.avg(side(v)).alias(f"mean_{n}"), F.var_samp(side(v)).alias(f"var_{n}"))])
    sa, sb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    pooled = F.sqrt((F.col("var_a") + F.col("var_b")) / 2)
    dof = F.try_divide((sa + sb) * (sa + sb), sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1))
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(sa + sb))
    half = _t_quantile(F.lit(0.05), dof) * F.sqrt(sa + sb)
    return m.select("n_a", "n_b", "mean_a", "mean_b", t.alias("t"), dof.alias("df"),
                    F.try_divide(F.col("mean_a") - F.col("mean_b"), pooled).alias("effect_size"),
                    _f_tail(t * t, F.lit(1.0), dof).alias("p_value"),
                    (F.col("mean_a") - F.col("mean_b") - half).alias("low"), (F.col("mean_a") - F.col("mean_b") + half).alias("high"))


def anova(df: DataFrame, measure: str, group: str) -> DataFrame:
    """One row ``(groups, n, f, df_between, df_within, eta_squared, p_value)`` from the moments of each group.

    Group means are compared with the overall mean, so a common offset of all values changes nothing.
    """
    moments = df.where(col(measure).isNotNull() & col(group).isNotNull()).groupBy(col(group)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(col(measure)).alias("m"), F.var_pop(col(measure)).alias("v"))
    first = moments.agg(F.min("m")).scalar()
    mean = moments.agg(F.try_divide(F.sum(F.col("n") * (F.col("m") - first)), F.sum("n"))).scalar()
    away = F.col("m") - first - mean
    s = moments.agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * away * away).alias("between"))
    dfb, dfw = F.col("groups") - 1, F.col("n") - F.col("groups")
    f = F.try_divide(F.try_divide(F.col("between"), dfb), F.try_divide(F.col("within"), dfw))
    return s.select(
        "groups", "n", f.alias("f"), dfb.alias("df_between"), dfw.alias("df_within"),
        F.try_divide(F.col("between"), F.col("between") + F.col("within")).alias("eta_squared"),
        _f_tail(f, dfb.cast("double"), dfw.cast("double")).alias("p_value"))


def recommend_charts(profile_rows: DataFrame) -> DataFrame:
    """Chart suggestions ``(type, x, y, aggregation, rationale)`` from profile rows with roles."""
    lists = profile_rows.agg(
        *[F.array_sort(F.collect_list(F.when(F.col("role") == r, F.col("name")))).alias(f"{r}s")
          for r in ("time", "measure", "dimension")],
        F.array_sort(F.collect_list(F.when((F.col("type") == "categorical"), F.col("name")))).alias("categories"))

    def suggestion(kind, x, y, how, why):
        return F.struct(F.lit(kind).alias("type"), x.alias("x"), y.alias("y"), F.lit(how).alias("aggregation"),
                        F.lit(why).alias("rationale"))

    none = F.lit(None).cast("string")
    per = lambda names, f: F.transform(F.col(names), f)
    first = lambda names: F.get(names, F.lit(0))
    ideas = F.concat(
        F.when(F.size("times") > 0, per("measures", lambda m: suggestion(
            "line", first("times"), m, "sum", "development over time"))).otherwise(F.array()),
        F.when(F.size("categories") > 0, per("measures", lambda m: suggestion(
            "bar", first("categories"), m, "sum", "comparison of categories"))).otherwise(F.array()),
        per("measures", lambda m: suggestion("histogram", m, none, "none", "distribution of values")),
        per("categories", lambda c: suggestion("pie", c, none, "count", "parts of the whole")),
        F.when(F.size("measures") > 1, F.array(suggestion(
            "scatter", first("measures"), F.get("measures", F.lit(1)), "none", "relation of two measures"))
        ).otherwise(F.array()),
        F.when((F.size("categories") > 1) & (F.size("measures") > 0), F.array(suggestion(
            "heatmap", first("categories"), F.get("categories", F.lit(1)), "sum", "two categories at once"))
        ).otherwise(F.array()))
    return lists.select(F.inline(ideas))
