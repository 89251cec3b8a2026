import numpy as np
import pytest

from tablesight.llm import whitening
from tablesight.llm.queries import QUERIES


def expected(vectors, most=32):
    """Eigenvectors of the covariance of whole numbers, in plain numpy."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    c = (n * x - sums) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(most, int((e > 1e-12 * e[0]).sum())) if e[0] > 0 else 0
    deviation = [sum(d * d for d in row) for row in (n * x - sums).tolist()]
    return n, deviation, (c @ v[:, :k]) / np.sqrt(e[:k]), e[:k] / e.sum() if k else e[:0]


def check(rows, ids, vectors, most=32, tolerance=1e-7):
    n, deviation, whitened, explained = expected(vectors, most)
    k = len(explained)
    assert len(rows) == len(ids) * k
    got = {(r.vec_id, r.component): r for r in rows}
    assert {r.n for r in rows} <= {n}
    assert max((r.identity_error for r in rows), default=0) <= 1e-9
    for j in range(k):
        column = np.array([got[i, j + 1].whitened for i in ids])
        sign = np.sign(column @ whitened[:, j])
        assert np.abs(column - sign * whitened[:, j]).max() < tolerance
        assert abs(got[ids[0], j + 1].explained / explained[j] - 1) < 1e-6
    assert all(got[i, 1].deviation == (d if d < 1 << 63 else None) for i, d in zip(ids, deviation)) if k else True


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS n", "'x' AS vector", "'x' AS at", "'y' AS id")


def test_query_equals_eigenvectors(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    rows = QUERIES["op12_whitening"](spark, sf_dir).collect()
    check(rows, [r.vec_id for r in given], [r.embedding for r in given])


def test_rows_that_take_no_part(spark):
    random = np.random.default_rng(0)
    good = [(k, random.normal(size=5).tolist()) for k in range(30)] + [(30, [0.0] * 5)]
    bad = [(90, None), (91, [1.0, None, 1.0, 1.0, 1.0]), (92, [float("nan")] * 5), (93, [float("inf")] * 5), (94, []), (95, [1.0, 2.0]), (96, [3e30] * 5)]
    rows = whitening.whiten(table(spark, good + bad)).collect()
    x = [np.float32(v).tolist() for _, v in good]
    check(rows, [k for k, _ in good], x)


@pytest.mark.parametrize("case", ["wide", "dependent", "scales"])
def test_rows_without_full_rank_and_of_very_different_scale(spark, case):
    random = np.random.default_rng(1)
    if case == "wide":  # fewer rows than dimensions
        x = random.normal(size=(7, 20)) * 10
    elif case == "dependent":
        x = random.integers(-50, 50, (200, 6)).astype(float)
        x = np.hstack([x, x[:, :2] + 1, np.ones((200, 1))])
    else:
        x = np.round(random.normal(size=(400, 6)) * np.array([1e5, 1e4, 1e3, 100, 10, 1]))
    x = np.float32(x).astype(float)
    rows = whitening.whiten(table(spark, [(k, v) for k, v in enumerate(x.tolist())])).collect()
    check(rows, list(range(len(x))), x, tolerance=1e-6)


def test_repeated_rows_and_ids(spark):
    random = np.random.default_rng(2)
    x = np.float32(random.normal(size=(40, 3))).astype(float).tolist()
    rows = whitening.whiten(table(spark, [(7, v) for v in x] + [(None, x[0])] * 500)).collect()
    assert len(rows) == 540 * 3 and sum(r.vec_id is None for r in rows) == 1500 and rows[0].n == 540
    n, deviation, _, _ = expected(x + [x[0]] * 500)
    assert sorted(r.deviation for r in rows) == sorted(deviation * 3)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(9)], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    out = whitening.whiten(table(spark, rows))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_fewer_components(spark):
    x = np.float32(np.random.default_rng(3).normal(size=(50, 8))).astype(float)
    rows = whitening.whiten(table(spark, list(enumerate(x.tolist()))), most=2).collect()
    check(rows, list(range(50)), x, most=2)
