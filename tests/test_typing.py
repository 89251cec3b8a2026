import datetime as dt

import pytest

from tablesight.functions.nulls import na_tokens_to_null, nan_to_null
from tablesight.operators.typing import detect_types, infer_types
from tablesight.plans import schema_roles
from tablesight.sources.readers import parse_dates


def column(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "c string")


def kind(spark, texts, **options):
    return detect_types(column(spark, texts), **options)[0].type


@pytest.mark.parametrize("share, expected", [(79, "string"), (80, "string"), (81, "bigint")])
def test_numeric_threshold_is_strict(spark, share, expected):
    assert kind(spark, ["7"] * share + ["seven"] * (100 - share)) == expected


@pytest.mark.parametrize("share, expected", [(69, "string"), (70, "string"), (71, "timestamp")])
def test_date_threshold_is_strict(spark, share, expected):
    assert kind(spark, ["2024-02-03"] * share + ["soon"] * (100 - share)) == expected


def test_missing_values_do_not_stop_a_clean_number_column(spark):
    assert kind(spark, ["1.5"] * 3 + [None] * 7) == "double"
    assert kind(spark, ["2024-01-01"] * 3 + [None] * 7) == "string"


@pytest.mark.parametrize("texts, expected", [
    (["1", "2"], "bigint"), (["1", "2.0"], "double"), (["1e3", "-.5"], "double"), (["inf", "1"], "double"),
    (["1,234", "5,678"], "string"), (["1.5d", "2.5d"], "string"), (["True", "false"], "boolean"),
    (["True", None], "string"), (["0x1A", "0x1B"], "string"), (["12345678901234567890", "1"], "decimal(38,0)"), (["1234567890123456789", "1"], "bigint"), (["9" * 39, "1"], "double"),
    (["", " "], "string"), ([None, None], "double"),
])
def test_types(spark, texts, expected):
    assert kind(spark, texts) == expected


@pytest.mark.parametrize("text, value", [
    ("2024-03-04", dt.datetime(2024, 3, 4)), ("2024-03-04 05:06:07", dt.datetime(2024, 3, 4, 5, 6, 7)),
    ("2024-03-04T05:06:07.25", dt.datetime(2024, 3, 4, 5, 6, 7, 250000)), ("2024/3/4", dt.datetime(2024, 3, 4)),
    ("3/14/2024", dt.datetime(2024, 3, 14)), ("14/3/2024", dt.datetime(2024, 3, 14)), ("14-Mar-2024", dt.datetime(2024, 3, 14)),
    ("Mar 14, 2024", dt.datetime(2024, 3, 14)), ("March 4, 2024", dt.datetime(2024, 3, 4)), ("14.3.2024", dt.datetime(2024, 3, 14)),
])
def test_date_formats(spark, text, value):
    out = infer_types(column(spark, [text, text]))
    assert out.dtypes == [("c", "timestamp_ntz")] and out.first()["c"] == value


def test_unreadable_values_become_missing(spark):
    out = infer_types(column(spark, ["1"] * 9 + ["x"]))
    assert out.where("c IS NULL").count() == 1
    assert infer_types(column(spark, ["2024-02-30"] + ["2024-02-03"] * 9)).where("c IS NULL").count() == 1


def test_numbers_are_never_read_as_dates(spark):
    df = spark.createDataFrame([(20240101,)], "date int")
    assert infer_types(df).dtypes == df.dtypes


def test_forced_dates(spark):
    df = column(spark, ["2024-01-01", "x", "y", "z"])
    assert parse_dates(df).dtypes == [("c", "string")]
    assert parse_dates(df, columns=["c"]).dtypes == [("c", "timestamp_ntz")]
    assert parse_dates(column(spark, ["2024-01-01"] * 65 + ["x"] * 35)).dtypes == [("c", "timestamp_ntz")]


def test_missing_spellings(spark):
    df = na_tokens_to_null(column(spark, ["", "NA", "n/a", "null", "None", "nan", "x", "Na"]))
    assert [r["c"] for r in df.where("c IS NOT NULL").collect()] == ["x", "Na"]
    assert nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "v double")).where("v IS NULL").count() == 1


def test_roles(spark):
    df = spark.createDataFrame([], "a date, b timestamp, c int, d decimal(5,2), e boolean, f string, `_row_id` int")
    r = schema_roles(df)
    assert (r.dates, r.numerics, r.categoricals) == (("a", "b"), ("c", "d"), ("e", "f"))
