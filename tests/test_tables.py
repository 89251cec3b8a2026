"""Profiles, cleaning and features."""

import pytest
from conftest import values
from pyspark.sql import functions as F

from tablesight.operators import clean, features, profile as p


@pytest.fixture(scope="module")
def customers(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    gaps = df.withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))
    return gaps.unionByName(gaps.where("c_custkey % 11 = 0"))


def test_profile(spark):
    df = spark.createDataFrame([(1, "b", True, None), (2, "a", None, None), (2, "b", False, None)],
                               "n int, s string, b boolean, empty string")
    rows = {r["name"]: r for r in p.profile(df).collect()}
    assert rows["n"]["type"] == "numerical" and rows["n"]["unique_count"] == 2
    assert rows["s"]["sample_values"] == ["a", "b"] and rows["b"]["type"] == "boolean"
    assert rows["b"]["null_percentage"] == pytest.approx(100 / 3)
    assert rows["empty"]["sample_values"] == [] and rows["empty"]["unique_count"] == 0
    approx = {r["name"]: r["unique_count"] for r in p.profile(df, approx=True).collect()}
    assert approx == {"n": 2, "s": 2, "b": 2, "empty": 0}
    issues = {r["name"]: r["issues"] for r in p.issues_by_column(df).collect()}
    assert issues["empty"] == ["empty"] and issues["b"] == ["many missing values"]


def test_roles_by_name(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "update_time int, note string, v double")
    roles = {r["name"]: r["role"] for r in p.column_roles(p.profile(df)).collect()}
    assert roles == {"update_time": "time", "note": "dimension", "v": "measure"}


def test_quality_counts_odd_cells(spark):
    df = spark.createDataFrame([("1", "x")] * 9 + [("oops", "x")], "n string, s string")
    row = p.quality(df).first()
    assert (row["duplicates"], row["missing"], row["consistency"]) == (8, 0, 0.95)


def test_duplicates(customers, spark):
    once = clean.drop_duplicates(customers)
    assert once.count() == customers.select("c_custkey").distinct().count()
    ordered = spark.createDataFrame([(3, "a", "z"), (1, "a", "x"), (2, "b", "y")], "i int, k string, v string")
    assert values(clean.drop_duplicates(ordered, ["k"], "i")) == [(1, "a", "x"), (2, "b", "y")]
    assert values(clean.drop_duplicates(ordered, order="i"), "i") == [(1,), (2,), (3,)]


def test_impute(customers, spark):
    full = clean.impute(customers)
    assert full.where("c_acctbal IS NULL").count() == 0
    assert full.dtypes == customers.dtypes and full.count() == customers.count()
    whole = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    assert sorted(r["n"] for r in clean.impute(whole).collect()) == [1, 2, 2]
    flags = spark.createDataFrame([(True,), (True,), (None,)], "b boolean")
    assert [r["b"] for r in clean.impute(flags).collect()] == [True] * 3
    empty = spark.createDataFrame([(None, "x")], "n double, s string")
    assert clean.impute(empty).first()["n"] is None


def test_strategies(customers):
    rules = {"positive": "c_acctbal > 0"}
    flagged = clean.clean(customers, "conservative", rules)
    assert flagged.count() == customers.count()
    assert {"_missing", "_valid", "c_acctbal_outlier"} <= set(flagged.columns)
    standard, aggressive = clean.clean(customers), clean.clean(customers, "aggressive", rules)
    assert aggressive.count() <= standard.count() <= customers.count()
    assert aggressive.where("c_acctbal <= 0").count() == 0
    report = clean.lineage(customers, standard).first()
    assert report["records_removed"] == customers.count() - standard.count()
    with pytest.raises(ValueError):
        clean.clean(customers, "ruthless")


def test_small_helpers(spark):
    df = spark.createDataFrame([(1, "4"), (2, "x"), (None, "6")], "k int, v string")
    assert values(clean.numbers_only(df, "v")) == [(1, 4.0), (None, 6.0)]
    assert clean.drop_missing(df, ["k"]).count() == 2
    assert values(clean.fill_unknown(df, ["k"]), "k") == [("1",), ("2",), ("Unknown",)]
    messy = spark.createDataFrame([("  a \u00a0 B ",)], "s string")
    assert clean.standardise(messy, case="lower").first()["s"] == "a b"
    assert features.derive(df, {"d": "k * 2"}).where("d = 4").count() == 1


def test_outliers_of_a_constant(spark):
    df = spark.createDataFrame([(5.0,)] * 10 + [(6.0,), (None,)], "v double")
    assert values(clean.flag_outliers(df, ["v"]), "v_outlier").count((True,)) == 1


def test_date_parts_skip_what_exists(spark):
    df = spark.sql("SELECT DATE '2024-01-07' AS d, 1 AS d_year")
    row = features.date_parts(df, parts=("year", "month", "quarter", "day_of_week")).first()
    assert (row["d_year"], row["d_month"], row["d_quarter"], row["d_day_of_week"]) == (1, 1, 1, 6)


def test_label_codes(spark):
    df = spark.createDataFrame([(w,) for w in ["pear", "fig", "apple", "fig", None, "kiwi", "date"]], "w string")
    out = {r["w"]: r["w_code"] for r in features.label_encode(df, "w").collect()}
    assert out == {"apple": 0, "date": 1, "fig": 2, "kiwi": 3, "pear": 4, None: 5}


def test_z_scores_of_a_constant(spark):
    df = spark.createDataFrame([(2.0, 1.0), (4.0, 1.0)], "a double, b double")
    assert values(features.z_scores(df, ["a", "b"]), "a_z", "b_z") == [(-1.0, None), (1.0, None)]
