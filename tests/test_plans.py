"""The physical plans that the operators are meant to get."""

import re

import pytest
from pyspark.sql import functions as F

from tablesight.operators import charts, clean, matching, quantiles, stages, stats, text, vectors
from tablesight.operators.typing import type_shares
from tablesight.workload import QUERIES


def plan_of(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def lineitem(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def test_filters_and_columns_reach_the_scan(lineitem):
    plan = plan_of(charts.chart_data(lineitem, {
        "type": "bar", "x": "l_returnflag", "y": "l_extendedprice", "agg": "sum",
        "filter": {"query": "l_linestatus != 'X'", "in": {"l_returnflag": ["A"]}, "range": {"l_quantity": [10, 40]}}}))
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan).group(1)
    for part in ("GreaterThanOrEqual(l_quantity,10.0)", "LessThanOrEqual(l_quantity,40.0)", "EqualTo(l_returnflag,A)",
                 "Or(Not(EqualTo(l_linestatus,X)),IsNull(l_linestatus))"):
        assert part in pushed
    schema = re.search(r"ReadSchema: struct<(.*)>", plan).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"}


def test_grouping_shuffles_partial_sums_only(lineitem):
    plan = plan_of(stages.aggregate(lineitem, ["l_returnflag"], ["l_quantity", "l_tax"], ["sum", "mean"]), "simple")
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in plan and "partial_avg" in plan


def test_top_n_is_a_broadcast_semi_join(lineitem):
    plan = plan_of(stages.top_n_overall(lineitem, "l_quantity", "l_suppkey", 5), "simple")
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan and "TakeOrderedAndProject" in plan


def test_group_ranks_are_limited_before_the_shuffle(lineitem):
    plan = plan_of(stages.top_n_per_group(lineitem, "l_quantity", "l_partkey", "l_returnflag", 3), "simple")
    assert plan.count("WindowGroupLimit") == 2


def test_share_needs_no_window(lineitem):
    plan = plan_of(charts.with_share(stages.aggregate(lineitem, ["l_suppkey"], ["l_quantity"]), "l_quantity"), "simple")
    assert "Window" not in plan and "Subquery" in plan


def test_duplicates_are_combined_before_the_shuffle(lineitem):
    plan = plan_of(clean.drop_duplicates(lineitem, ["l_partkey"], "l_orderkey"), "simple")
    assert "Window" not in plan and "partial_min_by" in plan


def test_exact_quantiles_shuffle_no_raw_rows(lineitem, monkeypatch):
    monkeypatch.setattr(quantiles, "store", lambda df: df)  # the plan in one piece
    plan = plan_of(quantiles.exact_quantiles(lineitem, ["l_extendedprice"], [0.5]), "simple")
    assert plan.count("FileScan") == 2 and plan.count("partial_count") == 2
    assert "GreaterThanOrEqual(l_extendedprice" in plan  # the bracket reaches the files


def test_type_detection_is_one_aggregate(lineitem):
    df = lineitem.select(*[F.col(c).cast("string").alias(c) for c in lineitem.columns])
    assert plan_of(type_shares(df), "simple").count("Exchange") == 1


def test_substring_matches_are_equi_joins(spark):
    hay = spark.createDataFrame([("abc",)], "h string")
    plan = plan_of(matching.containing(hay, "h", hay.select(F.col("h").alias("n")), "n"), "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_chunking_needs_no_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "Exchange" not in plan_of(text.chunk(docs, "doc_id", "text"), "simple")


def test_nearest_neighbours_shuffle_candidates_only(spark, sf_dir):
    corpus = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = vectors.centroids(corpus, "label", "embedding")
    plan = plan_of(vectors.knn(corpus, queries, "vec_id", "embedding", "label", "centroid"), "simple")
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1 and "Join" not in plan


def test_periods_are_joined_after_aggregation(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = plan_of(stats.growth(orders, "o_orderdate", "o_totalprice"), "simple")
    assert "Window" not in plan and "partial_sum" in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_compares_all_pairs(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir), "simple")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
