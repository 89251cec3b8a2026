import pytest

from tablesight.operators import questions as q


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([
        ("North", "Great Britain", 10, 2.5, "7"), ("North-East", "Spain", 20, 3.5, "x"), ("South", None, 30, None, "1.5"),
    ], "region string, country string, units int, sales_amount double, note string")


@pytest.mark.parametrize("text, function", [
    ("total sales", "sum"), ("What is the average of x", "mean"), ("how many rows", "count"), ("highest value", "max"),
    ("smallest value", "min"), ("the sum of the average", "sum"), ("address of the country", None), ("list everything", None),
    ("discount for region", None),
])
def test_verbs_are_whole_words(text, function):
    assert q.verb(text) == function


@pytest.mark.parametrize("column, question, match", [
    ("sales", "total sales", (4, 1)), ("sales", "total sale", (1, 1)), ("price", "average prices", (1, 1)),
    ("quantity", "sum of qty", (0, 0)), ("quantity", "max quan", (1, 1)), ("x1", "max x", (0, 0)),
    ("units_sold", "sum of units sold", (4, 2)), ("units_sold", "sold in units", (3, 2)), ("units_sold", "how many units", (2, 1)),
    ("o_totalprice", "show me the price", (1, 1)), ("sold_unit", "selling of units", (1, 1)),
])
def test_matches(column, question, match):
    assert q.column_match(column, question) == match


def test_best_column(sales):
    assert q.best_column(sales, "total sales amount") == "sales_amount"
    assert q.best_column(sales, "sum of something") == "units"
    assert q.best_column(sales.select("region"), "sum of units") is None


def test_filters(sales):
    assert q.find_filter(sales, "sum of units for region north-east") == ("region", "North-East")
    assert q.find_filter(sales, "sum for country spain region south") == ("region", "South")
    assert q.find_filter(sales, "sum for country spain in the north") == ("country", "Spain")
    assert q.find_filter(sales, "sum for region west") == (None, None)


def test_answers(sales):
    row = q.answer(sales, "total units for region north", "s.csv").first()
    assert (row["value"], row["rows"], row["filter_value"]) == (10.0, 1, "North")
    assert row["answer"] == ("Based on the data in s.csv:\n\nThe sum of 'units' for region=North is: **10.00**\n\n"
                             "(Calculated from 1 rows where region = 'North')")
    assert q.answer(sales, "how many units").first()["value"] == 3.0
    assert q.answer(sales, "average sales amount").first()["value"] == 3.0
    assert q.answer(sales, "hello") is None


def test_sum_shortcut(sales):
    assert q.sum_shortcut(sales, "Sum of note column").first()["value"] == 8.5
    assert q.sum_shortcut(sales, "sum of sales amount please").first()["answer"] == "Sum of sales_amount is 6.0"
    assert q.sum_shortcut(sales, "sum of nothing") is None
    assert q.sum_shortcut(sales, "average of units") is None
