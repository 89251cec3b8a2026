import pytest
from conftest import values
from pyspark.sql import functions as F

from tablesight.operators import stages
from tablesight.plans import SpecError


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([
        (0, "a", "p", 1.0, 10), (1, "a", "q", 2.0, None), (2, None, "p", 50.0, 5), (3, None, None, 1.0, 5),
        (4, "b", "p", None, None), (5, "b", "q", None, None), (6, "c", "q", 3.0, 7),
    ], "_row_id int, g string, c string, v double, n int")


def test_null_keys_stay_and_empty_sums_are_zero(df):
    out = stages.aggregate(df, ["g"], ["v"], "sum")
    assert values(out) == [("a", 3.0), ("b", 0.0), ("c", 3.0), (None, 51.0)]


@pytest.mark.parametrize("how", ["mean", "min", "max", "std", "median"])
def test_empty_groups_have_no_other_aggregate(df, how):
    assert dict(values(stages.aggregate(df, ["g"], ["v"], how)))["b"] is None


def test_counts(df):
    assert dict(values(stages.aggregate(df, ["g"], ["v"], "count"))) == {"a": 2, "b": 0, "c": 1, None: 2}
    assert dict(values(stages.aggregate(df, ["g"], ["v"], "size"))) == {"a": 2, "b": 2, "c": 1, None: 2}
    counted = stages.aggregate(df, ["g"], ["g"], "count")
    assert counted.columns == ["g", "value"]
    assert dict(values(counted)) == {"a": 2, "b": 2, "c": 1, None: 0}


def test_first_and_last_follow_the_row_order(df):
    assert dict(values(stages.aggregate(df, ["c"], ["n"], "first"))) == {"p": 10, "q": 7, None: 5}
    assert dict(values(stages.aggregate(df, ["c"], ["n"], "last"))) == {"p": 5, "q": 7, None: 5}


def test_functions_by_position_and_by_name(df):
    out = stages.aggregate(df, ["c"], ["v", "n", "g"], ["sum", "count"])
    assert out.columns == ["c", "v", "n", "g"]
    assert dict((r[0], r[1:]) for r in values(out))["p"] == (51.0, 2, 2)
    out = stages.aggregate(df, ["c"], [], {"v": ["sum", "max"], "n": "nunique"})
    assert out.columns == ["c", "v_sum", "v_max", "n_nunique"]
    out = stages.aggregate(df, ["c"], [], {"v": "sum", "n": "max"})
    assert out.columns == ["c", "v", "n"]


def test_global_aggregates(df):
    assert stages.aggregate_all(df, ["v", "n"], "max").collect()[0].asDict() == {"v": 50.0, "n": 10}
    rows = {r["func"]: (r["v"], r["n"]) for r in stages.aggregate_all(df, ["v", "n"], ["sum", "count", "median"]).collect()}
    assert rows == {"sum": (57.0, 27.0), "count": (5.0, 4.0), "median": (2.0, 6.0)}


def test_missing_columns_and_wrong_types_are_errors(df):
    with pytest.raises(SpecError, match="groupby 'x'"):
        stages.aggregate(df, ["x"], ["v"])
    with pytest.raises(SpecError, match="measure 'x'"):
        stages.aggregate(df, ["g"], ["x"])
    with pytest.raises(SpecError, match="needs numbers"):
        stages.aggregate(df, ["g"], ["c"], "sum")
    with pytest.raises(SpecError, match="unknown aggregate"):
        stages.aggregate(df, ["g"], ["v"], "mystery")


def test_top_n_keeps_a_null_winner(df):
    assert {r["g"] for r in stages.top_n_overall(df, "v", "g", 1).collect()} == {None}
    # a and c tie on 3.0: the earlier label wins
    assert {r["g"] for r in stages.top_n_overall(df, "v", "g", 2).collect()} == {None, "a"}


def test_top_n_per_group_drops_nulls(df):
    out = stages.top_n_per_group(df, "v", "c", "g", 1)
    assert values(out, "g", "c") == [("a", "q"), ("b", "p"), ("c", "q")]



def test_pivot(df, spark):
    out = stages.pivot(df, ["g"], "c", "v")
    assert values(out, "g", "p", "q") == [("a", 1.0, 2.0), ("b", 0.0, 0.0), ("c", 0.0, 3.0)]
    means = stages.pivot(df, ["g"], "c", "v", "mean", fill_value=-1)
    assert values(means, "g", "p", "q") == [("a", 1.0, 2.0), ("b", -1.0, -1.0), ("c", -1.0, 3.0)]
    wide = stages.pivot(spark.range(1_100).withColumn("v", F.lit(1)), [], "id", "v")
    assert len(wide.columns) == 1_100
    assert stages.pivot(df, ["g"], "c", "v", heads=["q"]).columns == ["g", "q"]


def test_pivot_of_many_heads(spark):
    df = spark.createDataFrame([("a", h, 1.0) for h in [1, 1, 1, 2, 2, 3, 4]] + [("b", 4, 5.0), ("b", None, 9.0)], "g string, h int, v double")
    with pytest.raises(SpecError, match="more than 2 values"):
        stages.pivot(df, ["g"], "h", "v", most_heads=2)
    out = stages.pivot(df, ["g"], "h", "v", most_heads=2, other="rest")
    assert out.columns == ["g", "1", "2", "rest"]
    assert values(out) == [("a", 3.0, 2.0, 2.0), ("b", 0.0, 0.0, 5.0)]
    assert stages.pivot(df, ["g"], "h", "v", most_heads=4).columns == ["g", "1", "2", "3", "4"]


def test_sorting(df):
    assert [r["v"] for r in stages.sort_rows(df, ["v"]).collect()][-2:] == [None, None]
    assert [r["v"] for r in stages.sort_rows(df, ["v"], False).collect()][-2:] == [None, None]
    assert stages.sort_rows(df, ["nope"]) is df


def test_filters_skip_unknown_columns(df):
    out = stages.filter_rows(df, {"in": {"g": ["a", None], "zz": [1]}, "range": {"v": [1, 2], "zz": [0, 1]}})
    assert values(out, "_row_id") == [(0,), (1,), (3,)]


def test_stage_order(df):
    from tablesight.operators.charts import chart_data

    spec = {"type": "table", "filter": {"query": "v > 0"}, "compute": {"w": "v * 2"}, "limit": 10,
            "top_n": {"n": 1, "by": "w", "category": "g"}, "aggregate": {"groupby": "g,c", "measures": ["w"], "how": "sum"},
            "sort": {"by": "w"}}
    assert [tuple(r) for r in chart_data(df, spec).collect()] == [(None, None, 2.0), (None, "p", 100.0)]
    with pytest.raises(ValueError):  # filters come before computed columns
        chart_data(df, {"type": "table", "filter": {"query": "w > 1"}, "compute": {"w": "v"}})
