"""Chart specifications over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tablesight.operators.charts import (
    chart_data, collapse_bars, heatmap, run_report, trend_line, with_group_value, with_share)
from tablesight.operators.stages import aggregate, aggregate_all, filter_rows, pivot
from tablesight.operators.summary import chart_summary, compare_groups, findings, kpis, top_performers
from tablesight.plans import build_guide, make_spec, repair_guide, schema_roles
from tablesight.workload.registry import query


def rounded(df: DataFrame, digits: int = 2, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


BAR_SUM = {
    "type": "bar", "x": "l_returnflag", "y": "l_extendedprice", "color": "l_linestatus", "agg": "sum",
    "filter": {"range": {"l_quantity": [10, 40]}},
}


@query("chart_bar_sum", """
    SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS value
    FROM lineitem WHERE l_quantity BETWEEN 10 AND 40 GROUP BY ALL""")
def bar_sum(t):
    return rounded(chart_data(t("lineitem"), BAR_SUM), 2, "value")


@query("chart_bar_avg", """
    SELECT l_linestatus, l_returnflag, round(avg(l_extendedprice * (1 - l_discount)), 4) AS value
    FROM lineitem GROUP BY ALL""")
def bar_avg(t):
    spec = {"type": "bar", "x": "$l_linestatus", "y": "avg(net)", "color": "l_returnflag",
            "compute": {"net": "l_extendedprice * (1 - l_discount)"}}
    return rounded(chart_data(t("lineitem"), spec), 4, "value")


@query("chart_bar_count", """
    SELECT o_orderpriority, o_orderstatus, count(o_orderkey) AS value FROM orders GROUP BY ALL""")
def bar_count(t):
    return chart_data(t("orders"), {"type": "bar", "x": "o_orderpriority", "y": "count(o_orderkey)",
                                    "color": "o_orderstatus"})


@query("chart_bar_collapsed", """
    SELECT l_returnflag, round(sum(l_extendedprice), 2) AS value
    FROM lineitem WHERE l_quantity BETWEEN 10 AND 40 GROUP BY ALL""")
def bar_collapsed(t):
    return rounded(collapse_bars(chart_data(t("lineitem"), BAR_SUM), "l_returnflag"), 2, "value")


@query("chart_line_month", """
    SELECT date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice), 2) AS o_totalprice
    FROM orders GROUP BY 1""")
def line_month(t):
    spec = {"type": "line", "x": "month", "y": "o_totalprice",
            "compute": {"month": "to_date(date_trunc('month', o_orderdate))"}}
    return rounded(chart_data(t("orders"), spec), 2, "o_totalprice")


@query("chart_line_facets", """
    SELECT date_trunc('year', o_orderdate)::DATE AS year_start, o_orderstatus, o_orderpriority,
           round(max(o_totalprice), 2) AS o_totalprice
    FROM orders GROUP BY ALL""")
def line_facets(t):
    spec = {"type": "line", "x": "year_start", "y": "max(o_totalprice)", "color": "o_orderstatus",
            "facet_col": "o_orderpriority", "facet_row": "no_such_column",
            "compute": {"year_start": "to_date(date_trunc('year', o_orderdate))"}}
    return rounded(chart_data(t("orders"), spec), 2, "o_totalprice")


@query("chart_auto_fields", """
    SELECT ts, sum(event_id)::BIGINT AS event_id FROM events GROUP BY ts""")
def auto_fields(t):
    return chart_data(t("events"), {"type": "line", "x": "auto"})


@query("scatter_points", """
    SELECT p_size, p_retailprice, p_type, p_brand FROM part WHERE p_size <= 25""")
def scatter_points(t):
    return chart_data(t("part"), {"type": "scatter", "x": "p_size", "y": "p_retailprice", "color": "p_type",
                                  "symbol": "p_brand", "size": "missing", "filter": {"query": "p_size <= 25"}})


@query("scatter_ols", """
    SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope,
           round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
           round(regr_r2(l_extendedprice, l_quantity), 8) AS r2
    FROM lineitem GROUP BY 1""")
def scatter_ols(t):
    line = trend_line(t("lineitem"), {"type": "scatter", "x": "l_quantity", "y": "l_extendedprice",
                                      "color": "l_returnflag", "trendline": True})
    return line.select("l_returnflag", "n", F.round("slope", 5).alias("slope"),
                       F.round("intercept", 4).alias("intercept"), F.round("r2", 8).alias("r2"))


@query("heatmap_grid", """
    WITH x AS (SELECT DISTINCT ts::DATE AS day FROM events), y AS (SELECT DISTINCT user_id FROM events),
         s AS (SELECT ts::DATE AS day, user_id, sum(value) AS v FROM events GROUP BY ALL)
    SELECT x.day, y.user_id, round(coalesce(s.v, 0), 2) AS value
    FROM x CROSS JOIN y LEFT JOIN s ON s.day = x.day AND s.user_id = y.user_id""")
def heatmap_grid(t):
    spec = {"type": "heatmap", "x": "day", "y": "user_id", "value": "value", "compute": {"day": "to_date(ts)"}}
    return rounded(chart_data(t("events"), spec), 2, "value")


@query("heatmap_ranges", """
    WITH cells AS (SELECT o_orderpriority, o_totalprice, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
    ends AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    ranges AS (SELECT o_orderpriority, least(floor((o_totalprice - lo) / (hi - lo) * 20), 19) AS bin, sum(v) AS v FROM cells, ends GROUP BY ALL),
    axis AS (SELECT DISTINCT bin FROM ranges), kinds AS (SELECT DISTINCT o_orderpriority FROM orders)
    SELECT k.o_orderpriority, round(lo + a.bin * ((hi - lo) / 20), 4) AS price_from, round(coalesce(v, 0), 2) AS value
    FROM kinds k CROSS JOIN axis a CROSS JOIN ends LEFT JOIN ranges r ON r.bin = a.bin AND r.o_orderpriority = k.o_orderpriority""")
def heatmap_ranges(t):
    """A heatmap of five kinds by very many prices, of at most a hundred cells."""
    spec = make_spec({"type": "heatmap", "x": "o_orderpriority", "y": "price", "value": "o_totalprice", "compute": {"price": "o_totalprice"}}, schema_roles(t("orders")))
    cells = heatmap(t("orders"), spec, most_cells=100)
    return cells.select("o_orderpriority", F.round("price", 4).alias("price_from"), F.round("o_totalprice", 2).alias("value"))


@query("pivot_others", """
    WITH top AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_custkey LIMIT 3)
    SELECT o_orderstatus, round(sum(o_totalprice) FILTER (o_custkey IN (FROM top)), 2) AS frequent, round(sum(o_totalprice) FILTER (o_custkey NOT IN (FROM top)), 2) AS others
    FROM orders GROUP BY 1""")
def pivot_others(t):
    """A cross table over very many customers: three of them have a column of their own."""
    wide = pivot(t("orders"), ["o_orderstatus"], "o_custkey", "o_totalprice", fill_value=None, most_heads=3, other="others")
    own = [F.coalesce(F.col(c), F.lit(0.0)) for c in wide.columns[1:-1]]
    none = [F.col(c).isNull() for c in wide.columns[1:-1]]
    return wide.select("o_orderstatus", F.when(~(none[0] & none[1] & none[2]), F.round(own[0] + own[1] + own[2], 2)).alias("frequent"), F.round("others", 2).alias("others"))


@query("treemap_rollup", """
    SELECT r_name, n_name, c_mktsegment,
           (3 - grouping(r_name) - grouping(n_name) - grouping(c_mktsegment))::INT AS level,
           round(sum(c_acctbal), 2) AS value
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def treemap_rollup(t):
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    spec = {"type": "treemap", "path": ["r_name", "n_name", "c_mktsegment"], "value": "c_acctbal"}
    return rounded(chart_data(customers, spec), 2, "value")


def _bins_sql(table: str, x: str, n: int, key: str = "", value: str = "count(*)", zero: str = "0") -> str:
    keys = f", {key}" if key else ""
    frame = f"SELECT DISTINCT {key}, r.bin FROM v, range({n}) r(bin)" if key else f"SELECT bin FROM range({n}) r(bin)"
    same = f" AND f.{key} = c.{key}" if key else ""
    shown = f", f.{key}" if key else ""
    return f"""
    WITH b AS (SELECT min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi, (max({x}) - min({x}))::DOUBLE / {n} AS step FROM {table}),
    r AS (SELECT t.*, {x}::DOUBLE AS v, lo, step, least(floor(({x} - lo) / (hi - lo) * {n}), {n - 1}) AS i FROM {table} t, b),
    v AS (SELECT *, CASE WHEN v < lo + i * step THEN i - 1
                         WHEN v >= lo + (i + 1) * step AND i < {n - 1} THEN i + 1 ELSE i END::INT AS bin FROM r),
    c AS (SELECT bin{keys}, {value} AS value FROM v GROUP BY ALL),
    f AS ({frame})
    SELECT f.bin::INT AS bin, round(lo + f.bin * step, 6) AS low, round(lo + (f.bin + 1) * step, 6) AS high,
           round((lo + f.bin * step + lo + (f.bin + 1) * step) / 2, 6) AS center{shown},
           coalesce(c.value, {zero}) AS value
    FROM f CROSS JOIN b LEFT JOIN c ON f.bin = c.bin{same}"""


@query("histogram_20", _bins_sql("orders", "o_totalprice", 20))
def histogram_20(t):
    return rounded(chart_data(t("orders"), {"type": "histogram", "x": "o_totalprice"}), 6, "low", "high", "center")


@query("histogram_sum_color", _bins_sql("events", "value", 12, "event_type", "sum(user_id)::DOUBLE", "0::DOUBLE"))
def histogram_sum_color(t):
    spec = {"type": "histogram", "x": "value", "y": "user_id", "color": "event_type", "nbins": 12}
    return rounded(chart_data(t("events"), spec), 6, "low", "high", "center")


@query("pie_share", """
    SELECT c_mktsegment, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 8) AS share
    FROM customer GROUP BY 1""")
def pie_share(t):
    return rounded(chart_data(t("customer"), {"type": "pie", "color": "c_mktsegment", "agg": "sum",
                                              "y": "c_acctbal"}), 8, "share")


@query("table_limit", "SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 20")
def table_limit(t):
    return chart_data(t("part"), {"type": "table", "sort": {"by": ["p_retailprice", "p_partkey"], "ascending": False}})


@query("chart_preview", "SELECT c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 50")
def chart_preview(t):
    names = t("customer").select(F.col("c_custkey").alias("_row_id"), "c_name", "c_mktsegment")
    return chart_data(names, {"type": "line", "x": "c_mktsegment"})


@query("agg_list", """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity,
           round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(l_discount), 8) AS l_discount
    FROM lineitem GROUP BY 1, 2""")
def agg_list(t):
    out = aggregate(t("lineitem"), ["l_returnflag", "l_linestatus"],
                    ["l_quantity", "l_extendedprice", "l_discount"], ["sum", "mean"])
    return out.select("l_returnflag", "l_linestatus", F.round("l_quantity", 2).alias("l_quantity"),
                      F.round("l_extendedprice", 4).alias("l_extendedprice"), F.round("l_discount", 8).alias("l_discount"))


@query("agg_dict", """
    SELECT l_shipdate::DATE AS day, round(sum(l_quantity), 2) AS l_quantity_sum, max(l_quantity) AS l_quantity_max,
           count(DISTINCT l_suppkey) AS l_suppkey_nunique
    FROM lineitem GROUP BY 1""")
def agg_dict(t):
    days = t("lineitem").withColumn("day", F.to_date("l_shipdate"))
    out = aggregate(days, ["day"], [], {"l_quantity": ["sum", "max"], "l_suppkey": ["nunique"]})
    return rounded(out, 2, "l_quantity_sum")


@query("agg_spread", """
    SELECT event_type, round(stddev_samp(value), 6) AS value FROM events GROUP BY 1""")
def agg_spread(t):
    return rounded(aggregate(t("events"), ["event_type"], ["value"], "std"), 6, "value")


@query("agg_median", """
    SELECT l_returnflag, round(median(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY 1""")
def agg_median(t):
    return rounded(aggregate(t("lineitem"), ["l_returnflag"], ["l_extendedprice"], "median"), 4, "l_extendedprice")


@query("agg_global", """
    SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice FROM lineitem""")
def agg_global(t):
    out = aggregate_all(t("lineitem"), ["l_quantity", "l_extendedprice"], "mean")
    return out.select(F.round("l_quantity", 6).alias("l_quantity"), F.round("l_extendedprice", 4).alias("l_extendedprice"))


@query("agg_global_list", """
    SELECT 'min' AS func, min(l_quantity) AS l_quantity, min(l_tax) AS l_tax FROM lineitem
    UNION ALL SELECT 'max', max(l_quantity), max(l_tax) FROM lineitem
    UNION ALL SELECT 'mean', round(avg(l_quantity), 6), round(avg(l_tax), 6) FROM lineitem""")
def agg_global_list(t):
    return rounded(aggregate_all(t("lineitem"), ["l_quantity", "l_tax"], ["min", "max", "mean"]), 6, "l_quantity", "l_tax")


@query("filter_in_range", """
    SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem
    WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 10 AND 20""")
def filter_in_range(t):
    kept = filter_rows(t("lineitem"), {"in": {"l_returnflag": ["A", "R"], "nope": [1]},
                                       "range": {"l_quantity": [10, 20], "nope": [0, 1]}})
    return kept.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")


@query("filter_query", """
    SELECT event_id, user_id, event_type, value FROM events
    WHERE (value > 20 OR event_type = 'error') AND event_type NOT IN ('click', 'view') AND NOT user_id < 5""")
def filter_query(t):
    kept = filter_rows(t("events"), {
        "query": "(value > @least | event_type == 'error') & event_type not in ['click', 'view'] and not user_id < 5",
    }, {"least": 20})
    return kept.select("event_id", "user_id", "event_type", "value")


@query("filter_query_missing", """
    SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment FROM customer
    WHERE c_custkey % 7 = 0 OR c_mktsegment <> 'BUILDING'""")
def filter_query_missing(t):
    holes = t("customer").withColumn("segment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")))
    return filter_rows(holes, {"query": "segment != 'BUILDING'"}).select("c_custkey", "segment")


@query("topn_overall", """
    WITH w AS (SELECT c_mktsegment, c_nationkey, sum(o_totalprice) AS s
               FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
         top AS (SELECT c_nationkey FROM w GROUP BY 1 ORDER BY sum(s) DESC, c_nationkey LIMIT 5)
    SELECT c_mktsegment, c_nationkey, round(s, 2) AS o_totalprice FROM w WHERE c_nationkey IN (FROM top)""")
def topn_overall(t):
    sales = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    spec = {"type": "line", "x": "c_mktsegment", "y": "o_totalprice", "color": "c_nationkey",
            "top_n": {"n": 5, "category": "c_nationkey", "by": "o_totalprice"}}
    return rounded(chart_data(sales, spec), 2, "o_totalprice")


@query("topn_per_group", """
    WITH w AS (SELECT event_type, user_id, sum(value) AS s FROM events GROUP BY ALL),
         top AS (SELECT event_type, user_id FROM w
                 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY s DESC, user_id) <= 3)
    SELECT event_id, event_type, user_id, value FROM events SEMI JOIN top USING (event_type, user_id)""")
def topn_per_group(t):
    spec = {"type": "table", "limit": 2**31 - 1, "sort": {"by": "event_id"},
            "top_n": {"n": 3, "by": "value", "category": "user_id", "scope": "per_group", "group": "event_type"}}
    return chart_data(t("events"), spec).select("event_id", "event_type", "user_id", "value")


@query("pivot_sum", """
    SELECT l_shipdate::DATE AS day, coalesce(round(sum(l_quantity) FILTER (l_returnflag = 'A'), 2), 0) AS "A",
           coalesce(round(sum(l_quantity) FILTER (l_returnflag = 'N'), 2), 0) AS "N",
           coalesce(round(sum(l_quantity) FILTER (l_returnflag = 'R'), 2), 0) AS "R"
    FROM lineitem GROUP BY 1""")
def pivot_sum(t):
    days = t("lineitem").withColumn("day", F.to_date("l_shipdate"))
    return rounded(pivot(days, ["day"], "l_returnflag", "l_quantity"), 2, "A", "N", "R")


@query("compute_columns", """
    SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
           l_extendedprice * (1 - l_discount) * (1 + 0.1) / l_quantity AS unit,
           CAST(floor(l_extendedprice / 1000) AS BIGINT) AS thousands,
           CASE WHEN l_tax = 0 THEN NULL ELSE round(l_discount / l_tax, 6) END AS ratio,
           round(power(l_quantity, 2), 2) AS squared, l_discount > 0.05 AND l_returnflag <> 'N' AS special
    FROM lineitem""")
def compute_columns(t):
    spec = {"type": "scatter", "x": "l_orderkey", "y": "l_linenumber", "params": {"extra": 0.1},
            "hover": ["net", "unit", "thousands", "ratio", "squared", "special"],
            "compute": {"net": "l_extendedprice * (1 - l_discount)", "unit": "net * (1 + @extra) / l_quantity",
                        "thousands": "l_extendedprice // 1000", "ratio": "l_discount / l_tax",
                        "squared": "l_quantity ** 2", "special": "l_discount > 0.05 & l_returnflag != 'N'"}}
    out = chart_data(t("lineitem"), spec)
    return out.withColumns({"net": F.round("net", 4), "ratio": F.round("ratio", 6),
                            "squared": F.round("squared", 2)})


@query("group_transform", """
    SELECT event_id, event_type, value, round(sum(value) OVER (PARTITION BY event_type), 2) AS value_sum FROM events""")
def group_transform(t):
    out = with_group_value(t("events").select("event_id", "event_type", "value"), "event_type", "value")
    return rounded(out, 2, "value_sum")


@query("share_of_total", """
    SELECT user_id, round(sum(value), 2) AS value, round(sum(value) / sum(sum(value)) OVER (), 8) AS share
    FROM events GROUP BY 1""")
def share_of_total(t):
    out = with_share(aggregate(t("events"), ["user_id"], ["value"]), "value")
    return out.select("user_id", F.round("value", 2).alias("value"), F.round("share", 8).alias("share"))


@query("chart_summary", """
    WITH v AS (SELECT user_id::VARCHAR AS label, sum(value) AS value FROM events GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS d, row_number() OVER (ORDER BY value, label) AS a FROM v)
    SELECT 'top' AS part, d::INT AS position, label, round(value, 2) AS value FROM r WHERE d <= 5
    UNION ALL SELECT 'bottom', a::INT, label, round(value, 2) FROM r WHERE a <= 5
    UNION ALL SELECT 'total', 0, 'sum', round(sum(value), 2) FROM v
    UNION ALL SELECT 'ratio', 0, 'sum', round(max(value) FILTER (d = 1) / max(value) FILTER (d = 2), 6) FROM r""")
def summary_rows(t):
    s = chart_summary(t("events"), {"type": "bar", "x": "user_id", "y": "sum(value)"})

    def listed(part):
        return s.select(F.lit(part).alias("part"), F.posexplode(part).alias("i", "e")).select(
            "part", (F.col("i") + 1).alias("position"), "e.label", F.round("e.value", 2).alias("value"))

    def single(part, column, digits):
        return s.select(F.lit(part).alias("part"), F.lit(0).alias("position"), F.col("agg").alias("label"),
                        F.round(column, digits).alias("value"))

    return reduce(DataFrame.unionByName, [
        listed("top"), listed("bottom"), single("total", "total_or_average", 2), single("ratio", "top_vs_second_ratio", 6)])


@query("chart_findings", """
    WITH v AS (SELECT o_orderpriority AS label, avg(o_totalprice) AS value FROM orders GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS d, row_number() OVER (ORDER BY value, label) AS a FROM v)
    SELECT 0 AS position, max(label) FILTER (d = 1) || ' has the highest o_totalprice ('
           || format('{:,.2f}', max(value) FILTER (d = 1)) || ')' AS finding FROM r
    UNION ALL SELECT 1, max(label) FILTER (d = 1) || ' is '
           || format('{:.1f}', max(value) FILTER (d = 1) / max(value) FILTER (d = 2)) || 'x ' || max(label) FILTER (d = 2) FROM r
    UNION ALL SELECT 2, max(label) FILTER (a = 1) || ' has the lowest o_totalprice ('
           || format('{:,.2f}', max(value) FILTER (a = 1)) || ')' FROM r
    UNION ALL SELECT 3, 'average of o_totalprice is ' || format('{:,.2f}', avg(value)) FROM v""")
def chart_findings(t):
    return findings(chart_summary(t("orders"), {"type": "bar", "x": "o_orderpriority", "y": "o_totalprice",
                                                "aggregation": "avg"}))


@query("kpi_table", """
    SELECT 'revenue' AS name, 'sum(o_totalprice)' AS formula, round(sum(o_totalprice), 2) AS value FROM orders
    UNION ALL SELECT 'orders', 'count(*)', count(*)::DOUBLE FROM orders
    UNION ALL SELECT 'customers', 'nunique(o_custkey)', count(DISTINCT o_custkey)::DOUBLE FROM orders
    UNION ALL SELECT 'largest', 'max(o_totalprice)', max(o_totalprice) FROM orders""")
def kpi_table(t):
    return rounded(kpis(t("orders"), {"revenue": "sum(o_totalprice)", "orders": "count(*)",
                                      "customers": "nunique(o_custkey)", "largest": "max(o_totalprice)"}), 2, "value")


@query("top_performers", """
    WITH g AS (SELECT l_suppkey AS item, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1)
    SELECT row_number() OVER (ORDER BY value DESC, item)::INT AS rank, item, round(value, 2) AS value,
           round(value / (SELECT sum(value) FROM g), 8) AS contribution
    FROM g ORDER BY value DESC, item LIMIT 10""")
def best_suppliers(t):
    out = top_performers(t("lineitem"), "l_suppkey", "l_extendedprice", 10)
    return out.select("rank", "item", F.round("value", 2).alias("value"), F.round("contribution", 8).alias("contribution"))


@query("compare_groups", """
    SELECT l_returnflag, count(*) AS rows, round(avg(l_quantity), 6) AS l_quantity,
           round(avg(l_extendedprice), 4) AS l_extendedprice,
           round(avg(l_quantity) / (SELECT avg(l_quantity) FROM lineitem), 8) AS l_quantity_ratio,
           round(avg(l_extendedprice) / (SELECT avg(l_extendedprice) FROM lineitem), 8) AS l_extendedprice_ratio
    FROM lineitem GROUP BY 1""")
def compare_flags(t):
    out = compare_groups(t("lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"])
    return out.select("l_returnflag", "rows", F.round("l_quantity", 6).alias("l_quantity"),
                      F.round("l_extendedprice", 4).alias("l_extendedprice"),
                      F.round("l_quantity_ratio", 8).alias("l_quantity_ratio"),
                      F.round("l_extendedprice_ratio", 8).alias("l_extendedprice_ratio"))


RECOMMENDATIONS = [
    {"id": "status_total", "type": "bar", "title_suggestion": "Total by Status",
     "spec": {"x": "o_orderstatus", "y": "sum(o_totalprice)", "color": "o_orderstatus"}},
    {"id": "priority_count", "type": "bar", "title_suggestion": "Orders by Priority",
     "spec": {"x": "o_orderpriority", "y": "o_orderkey", "aggregation": "count"}},
    {"id": "price_spread", "type": "histogram", "title_suggestion": "Price Spread",
     "spec": {"x": "o_totalprice", "y": "o_totalprice"}},
    {"id": "status_share", "type": "pie", "title_suggestion": "Status Share", "spec": {"x": "o_orderstatus"}},
    {"id": "broken", "type": "gauge", "title_suggestion": "Unsupported", "spec": {"x": "o_orderstatus"}},
]


@query("report_guide", """
    SELECT 'Total by Status' AS chart, o_orderstatus AS label, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL
    UNION ALL SELECT 'Orders by Priority', o_orderpriority, count(*) FROM orders GROUP BY ALL
    UNION ALL SELECT 'Price Spread', 'rows', count(*) FROM orders
    UNION ALL SELECT 'Status Share', o_orderstatus, count(*) FROM orders GROUP BY ALL""")
def report_guide(t):
    charts = run_report(t("orders"), repair_guide(build_guide(RECOMMENDATIONS, title="Orders")))

    def shown(name, label, value):
        return charts[name].select(F.lit(name).alias("chart"), label.alias("label"), value.cast("double").alias("value"))

    spread = charts["Price Spread"].agg(F.sum("value").alias("n"))
    return reduce(DataFrame.unionByName, [
        shown("Total by Status", F.col("o_orderstatus"), F.round("value", 2)),
        shown("Orders by Priority", F.col("o_orderpriority"), F.col("value")),
        spread.select(F.lit("Price Spread").alias("chart"), F.lit("rows").alias("label"), F.col("n").cast("double").alias("value")),
        shown("Status Share", F.col("o_orderstatus"), F.col("count"))])
