import pytest
from pyspark.sql import functions as F

from tablesight.operators import labels


def label(spark, column, **fields):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()])
    return df.select(column).first()[0]


@pytest.mark.parametrize("question, expected", [
    ("Summarize the document", "quantitative"),  # signals are substrings, and this one holds "sum"
    ("Give an overview of the document", "qualitative"), ("EXPLAIN the gist", "qualitative"), ("Summarize the total", "quantitative"),
    ("What is the count of rows?", "quantitative"), ("hello", "quantitative"), ("", "quantitative"), (None, "quantitative"),
    ("Create a chart of sales", "quantitative"), ("Describe the top customers", "quantitative"), ("describe topics", "qualitative"),
])
def test_intent(spark, question, expected):
    assert label(spark, labels.intent(F.col("q").cast("string")), q=question) == expected


@pytest.mark.parametrize("question, structured, preference, expected", [
    ("write a report", False, None, "report"), ("plot it", False, None, "plotly"), ("report with charts", False, None, "report"),
    ("report with charts", True, None, "plotly"), ("report", True, None, "plotly"), ("hello", False, None, "report"),
    ("hello", True, None, "plotly"), ("plot it", True, "Report", "report"), ("plot it", True, "other", "plotly"),
])
def test_output_mode(spark, question, structured, preference, expected):
    mode = labels.output_mode(F.col("q"), F.col("s"), F.col("p").cast("string"))
    assert label(spark, mode, q=question, s=structured, p=preference) == expected


@pytest.mark.parametrize("primary, secondary, files, index, question, expected", [
    ("qualitative", "Report", True, True, "x", ["retrieval", "monitoring"]),
    ("quantitative", None, True, True, "plot sales", ["processing", "charts", "monitoring"]),
    ("quantitative", "None", True, False, "sales", ["processing", "charts", "monitoring"]),
    ("quantitative", "None", True, True, "sales", ["processing", "retrieval", "monitoring"]),
    ("quantitative", "Chart", True, True, "sales", ["processing", "charts", "monitoring"]),
    ("quantitative", "Report", False, True, "sales", ["charts", "monitoring"]),
    ("quantitative", "None", False, True, "plot", ["retrieval", "monitoring"]),
])
def test_routes(spark, primary, secondary, files, index, question, expected):
    steps = labels.route(F.col("q"), F.col("p"), F.col("s").cast("string"), F.col("f"), F.col("i"))
    assert label(spark, steps, q=question, p=primary, s=secondary, f=files, i=index) == expected


def test_export_modes(spark):
    df = spark.createDataFrame([(" REPORT",), ("chart",), ("None",), (None,)], "s string")
    assert [r[0] for r in df.select(labels.export_mode(F.col("s"))).collect()] == ["report_only", "plotly_only", "both", "both"]
