import random

import numpy as np
import pytest

from tablesight.operators import quantiles
from tablesight.operators.quantiles import exact_quantiles, modes, quantile_row


def frame(spark, numbers, keys=None):
    rows = [(float(v) if v is not None else None, k) for v, k in zip(numbers, keys or ["x"] * len(numbers))]
    return spark.createDataFrame(rows, "v double, k string")


@pytest.mark.parametrize("small", [50_000, 0])
@pytest.mark.parametrize("kind", ["spread", "repeated", "skewed"])
def test_exact_on_many_rows(spark, monkeypatch, small, kind):
    monkeypatch.setattr(quantiles, "_SMALL_GROUP", small)
    rng = random.Random(3)
    draw = {"spread": rng.random, "repeated": lambda: rng.randint(0, 20), "skewed": lambda: rng.paretovariate(0.5)}[kind]
    numbers = [draw() for _ in range(60_000)]
    probabilities = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    out = {r["probability"]: r["quantile"] for r in exact_quantiles(frame(spark, numbers), ["v"], probabilities).collect()}
    for p in probabilities:
        assert out[p] == pytest.approx(float(np.quantile(numbers, p)), rel=1e-12)


def test_groups_with_a_hot_key(spark):
    rng = random.Random(5)
    keys = ["hot" if rng.random() < 0.5 else rng.choice("ab") for _ in range(5_000)] + [None]
    numbers = [rng.gauss(0, 1) for _ in keys]
    out = {r["k"]: r["quantile"] for r in exact_quantiles(frame(spark, numbers, keys), ["v"], [0.5], ["k"]).collect()}
    for k in ("hot", "a", "b", None):
        assert out[k] == pytest.approx(float(np.median([v for v, g in zip(numbers, keys) if g == k])))


def test_missing_and_nan_do_not_count(spark):
    df = frame(spark, [1, 2, 3, None, float("nan"), None])
    row = quantile_row(df, ["v"], [0.5, 0.75]).first()
    assert row["v"] == [2.0, 2.5]
    assert quantile_row(df.where("v > 5 AND NOT isnan(v)"), ["v"], [0.5]).first()["v"] == [None]


def test_modes_prefer_the_smallest(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("a", 2), ("b", 2), ("c", 3), (None, None), (None, None), (None, None)], "s string, n int")
    assert {r["column"]: r["value"] for r in modes(df, ["s", "n"]).collect()} == {"s": "a", "n": "1"}


@pytest.mark.parametrize("kind", ["spread", "powers", "repeated", "infinite"])
def test_rounds_of_histograms(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "SORTED_VALUES", 40)
    monkeypatch.setattr(quantiles, "BINS", 64)
    rng = random.Random(6)
    draw = {"spread": rng.random, "powers": lambda: rng.choice([-1, 1]) * 2.0 ** rng.randint(-40, 40), "repeated": lambda: rng.randint(0, 90),
            "infinite": lambda: rng.choice([float("inf"), -float("inf"), 1e308, -1e308, rng.random(), 1.0 + rng.random()])}[kind]
    numbers = [draw() for _ in range(3_000)]
    keys = [rng.choice(["hot", "hot", "hot", "a", "b", None]) for _ in numbers]
    # Without interpolation between infinite values: ranks that are whole.
    out = {(r["k"], r["probability"]): r["quantile"] for r in exact_quantiles(frame(spark, numbers, keys), ["v"], [0.0, 0.25, 0.5, 1.0], ["k"]).collect()}
    for k in ("hot", "a", "b", None):
        group = sorted(v for v, g in zip(numbers, keys) if g == k)
        for p in (0.0, 0.25, 0.5, 1.0):
            at = p * (len(group) - 1)
            low, high = group[int(at)], group[-int(-at // 1)]
            if low == high or abs(low) + abs(high) < 1e200:
                want = low if low == high else low + (high - low) * (at - int(at))
                assert out[k, p] == pytest.approx(want, rel=1e-12) or (out[k, p] != out[k, p] and abs(low) == float("inf"))


def test_plan_sorts_no_group(spark):
    df = frame(spark, [1, 2, 3], ["a", "b", "a"])
    assert "Window" not in exact_quantiles(df, ["v"], [0.5], ["k"])._jdf.queryExecution().executedPlan().toString()
