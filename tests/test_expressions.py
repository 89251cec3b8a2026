import pytest

from tablesight.functions import expressions
from conftest import values
from pyspark.sql import functions as F

from tablesight.functions.expressions import ExpressionError, compute, predicate
from tablesight.operators.hooks import register_function


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(
        [(1, 10.0, "x", None), (2, 0.0, "y", 5), (3, None, None, -5), (4, -7.5, "z", 0)],
        "id int, v double, s string, `odd name` int")


def kept(df, text, **params):
    return [r[0] for r in df.where(predicate(text, df.schema, params)).orderBy("id").select("id").collect()]


@pytest.mark.parametrize("text, ids", [
    ("v > 0", [1]),
    ("v >= 0 & s == 'y'", [2]),                      # & binds looser than comparisons
    ("id < 2 | id > 3", [1, 4]),
    ("id < 2 or id > 3 and s == 'x'", [1]),
    ("v != 0", [1, 3, 4]),                           # missing differs from everything
    ("0 != v", [1, 3, 4]),
    ("s not in ['x', 'y']", [3, 4]),
    ("s in ['x', None]", [1, 3]),
    ("s == ['x', 'z']", [1, 4]),
    ("s != ['x', 'z']", [2, 3]),
    ("not (v > 0)", [2, 3, 4]),
    ("~(v > 0) & id < 4", [2, 3]),
    ("not (v > 0 & s == 'x')", [2, 3, 4]),
    ("0 <= v < 11", [1, 2]),
    ("id != `odd name`", [1, 2, 3, 4]),
    ("`odd name` < 0", [3]),
    ("id in @wanted", [2, 4]),
    ("id == @least + 1", [3]),
    ("s.isna()", [3]),
    ("s.notnull() and s.str.contains('[xy]')", [1, 2]),
    ("-v > 0", [4]),
    ("abs(v) > 7", [1, 4]),
])
def test_predicates(df, text, ids):
    assert kept(df, text, wanted=[2, 4], least=2) == ids


@pytest.mark.parametrize("text, expected", [
    ("v / `odd name`", [None, 0.0, None, None]),     # division by zero is missing
    ("id / 2", [0.5, 1.0, 1.5, 2.0]),
    ("id // 2", [0, 1, 1, 2]),
    ("v // 2", [5, 0, None, -4]),
    ("`odd name` % 3", [None, 2, 1, 0]),             # sign of the divisor
    ("id % 0", [None] * 4),
    ("id ** 2", [1.0, 4.0, 9.0, 16.0]),
    ("s + '!'", ["x!", "y!", None, "z!"]),
    ("v > 0", [True, False, False, False]),
    ("v != 0", [True, False, True, True]),
    ("(id + 1) * @k", [4, 6, 8, 10]),
    ("sqrt(id * id)", [1.0, 2.0, 3.0, 4.0]),
    ("upper(s)", ["X", "Y", None, "Z"]),
])
def test_computed(df, text, expected):
    out = df.withColumn("c", compute(text, df.schema, {"k": 2})).orderBy("id")
    assert [r["c"] for r in out.collect()] == expected


@pytest.mark.parametrize("text", ["nope > 1", "id +", "id > @nope", "lambda: 1", "id is 3", "s.str.nope()"])
def test_rejected(df, text):
    with pytest.raises(ExpressionError):
        predicate(text, df.schema)


def test_registered_function(spark, df):
    import pandas as pd

    @F.pandas_udf("double")
    def twice(v: pd.Series) -> pd.Series:
        return v * 2

    register_function(spark, "twice", twice)
    out = df.withColumn("c", compute("twice(v) + 1", df.schema))
    assert values(out, "id", "c") == [(1, 21.0), (2, 1.0), (3, None), (4, -14.0)]


@pytest.mark.parametrize("call", ["reflect('java.lang.System', 'getProperty', 'user.home')", "java_method('a', 'b')", "input_file_name()",
                                  "from_json('1', 'int')", "assert_true(1 > 2)", "raise_error('x')", "current_user()"])
def test_only_functions_of_values_may_be_called(spark, call):
    with pytest.raises(expressions.ExpressionError, match="not allowed"):
        expressions.compute(call, spark.range(1).schema)
