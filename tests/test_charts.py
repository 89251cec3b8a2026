import warnings

import numpy as np
import pytest
from conftest import values
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tablesight.operators import charts
from tablesight.operators.charts import chart_data, run_report
from tablesight.operators.summary import chart_summary, findings


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([
        (0, "a", "p", 1.0, "4"), (1, "a", "q", 2.0, "x"), (2, None, "p", 50.0, "5"), (3, "b", "q", None, "7"),
        (4, "b", "p", 6.0, None), (5, "c", None, -1.0, "1.5"),
    ], "_row_id int, g string, c string, v double, t string")


def test_bar_drops_missing_x_and_sorts(df):
    out = chart_data(df, {"type": "bar", "x": "g", "y": "v"})
    assert [tuple(r) for r in out.collect()] == [("b", 6.0), ("a", 3.0), ("c", -1.0)]


def test_bar_mean_is_taken_once_per_split(df):
    out = chart_data(df, {"type": "bar", "x": "g", "y": "v", "color": "c", "agg": "avg"})
    assert values(out) == [("a", "p", 1.0), ("a", "q", 2.0), ("b", "p", 6.0), ("c", None, -1.0)]


def test_bar_reads_numbers_in_text(df):
    out = chart_data(df, {"type": "bar", "x": "g", "y": "t", "agg": "sum"})
    assert values(out) == [("a", 4.0), ("b", 7.0), ("c", 1.5)]


def test_bar_counts(df):
    assert dict(values(chart_data(df, {"type": "bar", "x": "g", "y": "v", "agg": "count"}))) == {"a": 2, "b": 1, "c": 1}
    assert dict(values(chart_data(df, {"type": "bar", "x": "g", "y": "rows", "agg": "count"}))) == {"a": 2, "b": 2, "c": 1}
    assert dict(values(chart_data(df, {"type": "bar", "x": "g", "y": "g", "agg": "count"}))) == {"a": 2, "b": 2, "c": 1}


def test_line_keeps_missing_x_and_orders_by_x(df):
    out = chart_data(df, {"type": "line", "x": "g", "y": "v"}).collect()
    assert [tuple(r) for r in out] == [("a", 3.0), ("b", 6.0), ("c", -1.0), (None, 50.0)]


def test_pie_counts_rows_and_keeps_missing(df):
    out = chart_data(df, {"type": "pie", "color": "c", "y": "v", "agg": "sum"})
    assert values(out, "c", "count") == [("p", 3), ("q", 2), (None, 1)]
    assert sum(r["share"] for r in out.collect()) == pytest.approx(1.0)


def test_heatmap_fills_the_grid(df):
    out = chart_data(df, {"type": "heatmap", "x": "g", "y": "c", "value": "v"})
    assert values(out) == [("a", "p", 1.0), ("a", "q", 2.0), ("b", "p", 6.0), ("b", "q", 0.0)]


def test_heatmap_cell_function(df, spark):
    rows = spark.createDataFrame([("a", "p", 1.0), ("a", "p", 3.0)], "g string, c string, v double")
    assert values(chart_data(rows, {"type": "heatmap", "x": "g", "y": "c", "value": "v", "agg": "mean"})) == [("a", "p", 2.0)]


def test_grid_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(charts, "_GRID_BLOCK", 3)
    sums = spark.createDataFrame([(i % 5, i, 1.0) for i in range(20)], "x int, y int, v double")
    out = charts.grid(sums, "x", "y", "v")
    rows = values(out)
    assert len(rows) == 100 and sum(r[2] for r in rows) == 20.0
    assert len({r[:2] for r in rows}) == 100


def test_grids_are_bounded(spark):
    rows = spark.sql("SELECT id % 30 AS x, concat('k', id % 40) AS y, 1.0D AS v, timestamp_seconds(id) AS ts, cast(id AS decimal(9, 0)) AS d FROM range(1200)")
    spec = lambda x, y: charts.make_spec({"type": "heatmap", "x": x, "y": y, "value": "v"}, charts.schema_roles(rows))
    for x, y in (("x", "y"), ("ts", "y"), ("d", "y"), ("y", "ts"), ("x", "ts")):
        for most in (1, 7, 100, 5_000):
            cells = charts.heatmap(rows, spec(x, y), most).collect()
            assert len(cells) <= most and sum(r["v"] for r in cells) == 1200.0
    assert charts.heatmap(rows, spec("x", "y"), None).count() == charts.heatmap(rows, spec("x", "y")).count() == 1200
    labels = {r["y"] for r in charts.heatmap(rows, spec("x", "y"), 60).collect()}
    assert charts.OTHERS in labels and "k0" in labels


def test_heatmap_is_whole_at_any_size(spark):
    rows = spark.sql("SELECT id AS x, concat('k', id % 1000) AS y, 1.0D AS v FROM range(1001)")
    out = chart_data(rows, {"type": "heatmap", "x": "x", "y": "y", "value": "v"})
    assert dict(out.dtypes) == {"x": "bigint", "y": "string", "v": "double"}
    totals = out.agg(F.count(F.lit(1)), F.count_distinct("x"), F.count_distinct("y"), F.sum("v"), F.count_if(F.col("v") != 0))
    assert tuple(totals.first()) == (1_001_000, 1001, 1000, 1001.0, 1001)


def test_grid_is_made_by_many_tasks(spark, monkeypatch):
    for name, n in (("_GRID_BLOCK", 7), ("_GRID_LINES", 3), ("_TASK_CELLS", 100)):
        monkeypatch.setattr(charts, name, n, raising=False)
    sums = spark.sql("SELECT date_add(DATE'2024-01-01', cast(id % 20 AS int)) AS x, concat('k', id % 49) AS y, cast(id AS double) AS v FROM range(200)")
    out = charts.grid(sums, "x", "y", "v", -1.0)
    assert out.rdd.getNumPartitions() == 10
    seen = {(r["x"], r["y"]): r["v"] for r in sums.collect()}
    days, kinds = {k[0] for k in seen}, {k[1] for k in seen}
    assert len(seen) == 200 and values(out) == sorted(((d, k, seen.get((d, k), -1.0)) for d in days for k in kinds), key=repr)
    assert charts.grid(sums.limit(0), "x", "y", "v").count() == 0


def test_treemap_levels_add_up(df):
    out = chart_data(df, {"type": "treemap", "path": ["g", "c"], "value": "v"})
    totals = {r["level"]: r["s"] for r in out.groupBy("level").agg(F.sum("value").alias("s")).collect()}
    assert totals == {0: 58.0, 1: 58.0, 2: 58.0}
    assert ("Unknown", "p", 2, 50.0) in values(out)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6).map(lambda v: round(v, 3)), min_size=1, max_size=60), st.integers(1, 25))
def test_histogram_agrees_with_numpy(spark, numbers, nbins):
    df = spark.createDataFrame([(v,) for v in numbers] + [(None,)], "v double")
    rows = charts.bins(df, "v", nbins).orderBy("bin").collect()
    counts, edges = np.histogram(numbers, bins=nbins)
    assert [r["value"] for r in rows] == counts.tolist()
    assert [r["low"] for r in rows] == pytest.approx(edges[:-1].tolist(), rel=1e-9, abs=1e-9)


def test_histogram_edge_cases(spark, df):
    constant = spark.createDataFrame([(5.0,)] * 3, "v double")
    rows = charts.bins(constant, "v", 4).orderBy("bin").collect()
    assert (rows[0]["low"], rows[-1]["high"], [r["value"] for r in rows]) == (4.5, 5.5, [0, 0, 3, 0])
    assert charts.bins(spark.createDataFrame([(None,)], "v double"), "v", 4).count() == 0
    by_color = chart_data(df, {"type": "histogram", "x": "v", "color": "c", "nbins": 2})
    assert by_color.count() == 6 and by_color.agg(F.sum("value")).first()[0] == 5
    top = chart_data(df, {"type": "histogram", "x": "v", "y": "max(_row_id)", "nbins": 2}).orderBy("bin").collect()
    assert [r["value"] for r in top] == [5.0, 2.0]
    means = charts.bins(df, "v", 2, "_row_id", "avg").orderBy("bin").collect()
    assert [r["value"] for r in means] == [2.5, 2.0]


def test_table_and_preview(df, spark):
    assert [r["v"] for r in chart_data(df, {"type": "table", "limit": 2}).collect()] == [1.0, 2.0]
    assert "_row_id" not in chart_data(df, {"type": "table"}).columns
    words = df.select("_row_id", "g", "c")
    assert chart_data(words, {"type": "line", "x": "g", "limit": 3}).count() == 3
    assert chart_data(words, {"type": "heatmap", "x": "g", "y": "c"}).count() == 6


def test_collapsed_bars(df):
    bars = chart_data(df, {"type": "bar", "x": "g", "y": "v", "color": "c"})
    assert [tuple(r) for r in charts.collapse_bars(bars, "g").collect()] == [("b", 6.0), ("a", 3.0), ("c", -1.0)]


def test_group_value_reaches_every_row(df):
    out = charts.with_group_value(df, "g", "v")
    assert values(out, "_row_id", "v_sum") == [(0, 3.0), (1, 3.0), (2, 50.0), (3, 6.0), (4, 6.0), (5, -1.0)]


@pytest.mark.parametrize("materialise", [False, True])
def test_report_skips_what_cannot_be_built(df, materialise):
    guide = {"columns": {"g": "Group"}, "charts": [
        {"name": "one", "type": "bar", "x": "$g", "y": "$v"}, {"name": "bad", "type": "sunburst"},
        {"name": "worse", "type": "bar", "x": "g", "y": "v", "aggregate": {"groupby": ["zz"], "measures": ["v"]}},
        {"name": "one", "type": "pie", "color": "c"}]}
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        report = run_report(df, guide, materialise)
    assert list(report) == ["one", "one (4)"] and len(caught) == 2
    assert report["one"].count() == 3


def test_summary_edges(df, spark):
    s = chart_summary(df, {"type": "bar", "x": "g", "y": "v", "aggregation": "sum"}).first()
    assert [(e["label"], e["value"]) for e in s["top"]] == [("b", 6.0), ("a", 3.0), ("c", -1.0)]
    assert s["total_or_average"] == 8.0 and s["top_vs_second_ratio"] == 2.0 and s["min"]["label"] == "c"
    rows = chart_summary(df, {"type": "scatter", "x": "g", "y": "v"}).first()
    assert rows["agg"] == "none" and rows["top"][0]["label"] == "b" and rows["total_or_average"] == pytest.approx(2.0)
    empty = chart_summary(df, {"type": "pie", "x": "g"}).first()
    assert empty["chart_type"] == "pie" and empty["x"] is None and empty["top"] is None
    zero = spark.createDataFrame([("a", 5.0), ("b", 0.0)], "g string, v double")
    assert chart_summary(zero, {"x": "g", "y": "sum(v)"}).first()["top_vs_second_ratio"] is None
    none = chart_summary(zero.where("v > 9"), {"x": "g", "y": "sum(v)", "type": "bar"}).first()
    assert none["x"] is None and none["chart_type"] == "bar"
    assert findings(chart_summary(zero, {"x": "g", "y": "sum(v)"})).count() == 3
