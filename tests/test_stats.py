import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesight.operators import ml, stats


def series(spark, numbers):
    return spark.createDataFrame([(float(v),) for v in numbers], "v double")


@pytest.mark.parametrize("label", ["normal", "uniform", "skewed", "bimodal"])
def test_distribution_labels(spark, label):
    rng = random.Random(1)
    draw = {"normal": lambda: rng.gauss(0, 1), "uniform": rng.random, "skewed": lambda: rng.expovariate(1),
            "bimodal": lambda: rng.gauss(-4, 0.8) if rng.random() < 0.5 else rng.gauss(4, 0.8)}[label]
    assert stats.distribution(series(spark, [draw() for _ in range(20_000)]), "v", 10).first()["label"] == label


def test_describe_matches_numpy(spark):
    numbers = [1, 2, 2, 3, 10, 4.5]
    row = stats.describe(series(spark, numbers), ["v"]).first()
    assert row["mode"] == 2 and row["median"] == np.median(numbers)
    assert row["iqr"] == pytest.approx(np.subtract(*np.percentile(numbers, [75, 25])))


@pytest.mark.parametrize("granularity", stats.GRANULARITIES)
def test_neighbouring_periods_differ_by_one(spark, granularity):
    days = spark.sql("SELECT explode(sequence(DATE '2019-12-25', DATE '2022-01-10')) AS d")
    rows = days.select(F.date_trunc(granularity, "d").alias("p"), stats.period_number(F.col("d"), granularity).alias("n")).distinct().orderBy("p").collect()
    numbers = [r["n"] for r in rows]
    assert numbers == list(range(numbers[0], numbers[0] + len(numbers)))


def test_trend_and_growth(spark):
    df = spark.sql("""SELECT explode(sequence(DATE '2020-01-01', DATE '2020-12-01', INTERVAL 1 MONTH)) AS d""").withColumn("v", F.month("d") * 10.0)
    row = stats.trend(df, "d", ["v"]).first()
    assert (row["slope"], row["strength"], row["direction"]) == (pytest.approx(10), pytest.approx(1), "increasing")
    gap = df.where("month(d) <> 5")
    changes = {r["period"].month: r["growth"] for r in stats.growth(gap, "d", "v").collect()}
    assert changes[2] == 1.0 and changes[1] is None and changes[6] is None


def test_decomposition_adds_up(spark):
    df = spark.sql("SELECT explode(sequence(DATE '2020-01-01', DATE '2020-03-31')) AS d").withColumn("v", F.weekday("d") + 1.0)
    for r in stats.decompose(df, "d", "v", "day").collect():
        assert r["trend"] + r["seasonal"] + r["residual"] == pytest.approx(r["value"])
    slots = {r["slot"]: r["mean"] for r in stats.seasonality(df, "d", "v", "day").collect()}
    assert slots == {i: float(i) for i in range(1, 8)}


def test_segments_take_the_first_rule(spark):
    df = series(spark, [1, 5, 9, 20])
    rows = {r["segment"]: (r["size"], r["percentage"]) for r in stats.segments(df, {"big": "v > 8", "mid": "v > 4"}, ["v"]).collect()}
    assert rows == {"big": (2, 50.0), "mid": (1, 25.0), "other": (1, 25.0)}


def test_p_values():
    for z in (0.0, 0.5, 1.96, 3.0):  # with very many degrees of freedom, the normal distribution
        assert stats._beta_share(5e6, 0.5, 1e7 / (1e7 + z * z)) == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)


def test_anomalies(spark):
    df = series(spark, [0.0] * 50 + [1.0] * 50 + [50.0])
    assert [r["v"] for r in stats.anomalies(df, "v").collect()] == [50.0]
    assert [r["v"] for r in stats.anomalies(df, "v", "iqr").collect()] == [50.0]


def test_clusters_find_separate_groups(spark):
    df = spark.createDataFrame([(i % 2, float(i % 2 * 100 + i % 5), float(i % 3)) for i in range(60)], "g int, a double, b double")
    pairs = ml.clusters(df, ["a", "b"], 2).select("g", "cluster").distinct().count()
    assert pairs == 2
    assert ml.explained_variance(df, ["a", "b"], 2).agg(F.sum("explained_variance")).first()[0] == pytest.approx(1.0)
    assert ml.principal_components(df, ["a", "b"], 1).first()["components"] is not None


def test_p_values_of_known_groups(spark):
    rows = [("a", x) for x in (27.5, 21.0, 19.0, 23.6, 17.0, 17.9, 16.9, 20.1, 21.9, 22.6, 23.1, 19.6, 19.0, 21.7, 21.4)] + [
        ("b", x) for x in (27.1, 22.0, 20.8, 23.4, 23.4, 23.5, 25.8, 22.0, 24.8, 20.2, 21.9, 22.1, 22.9, 30.5, 24.4)]
    w = stats.welch_test(spark.createDataFrame(rows, "g string, v double"), "v", "g", "a", "b").first()
    a, b = (np.array([x for g, x in rows if g == k]) for k in "ab")
    va, vb = a.var(ddof=1) / 15, b.var(ddof=1) / 15
    t, dof = (a.mean() - b.mean()) / math.sqrt(va + vb), (va + vb) ** 2 / (va * va / 14 + vb * vb / 14)
    x = np.linspace(abs(t), 200, 2_000_001)  # the tail of the density, integrated
    density = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi) * (1 + x * x / dof) ** (-(dof + 1) / 2)
    assert w["t"] == pytest.approx(t) and w["df"] == pytest.approx(dof) and w["p_value"] == pytest.approx(2 * np.trapezoid(density, x), rel=1e-4)
    assert w["low"] < a.mean() - b.mean() < w["high"] < 0 and w["low"] + w["high"] == pytest.approx(2 * (a.mean() - b.mean()))


def test_anova_is_stable_and_has_a_p_value(spark):
    values_ = [("a", 6.0), ("a", 8.0), ("a", 4.0), ("a", 5.0), ("a", 3.0), ("a", 4.0), ("b", 8.0), ("b", 12.0), ("b", 9.0), ("b", 11.0), ("b", 6.0), ("b", 8.0),
               ("c", 13.0), ("c", 9.0), ("c", 11.0), ("c", 8.0), ("c", 7.0), ("c", 12.0)]
    for offset in (0.0, 1e9):
        row = stats.anova(spark.createDataFrame([(g, v + offset) for g, v in values_], "g string, v double"), "v", "g").first()
        assert row["f"] == pytest.approx(9.2647, rel=1e-4) and row["eta_squared"] == pytest.approx(0.5526, rel=1e-3)
        assert row["p_value"] == pytest.approx(0.0023988, rel=1e-3)


@pytest.mark.parametrize("t, dof, p", [(2.228138851964939, 10, 0.05), (12.706204736432095, 1, 0.05), (1.959963984540054, 1e7, 0.05), (-1.92, 7.1, 0.0957), (0.0, 5, 1.0)])
def test_tails_of_student(t, dof, p):
    assert stats._beta_share(dof / 2, 0.5, dof / (dof + t * t)) == pytest.approx(p, abs=2e-4)


def test_chi_square_of_a_known_table(spark):
    table = {("x", "p"): 20, ("x", "q"): 30, ("y", "p"): 30, ("y", "q"): 20, ("z", "p"): 7}
    rows = [key for key, n in table.items() for _ in range(n)] + [(None, "p"), ("x", None)]
    row = ml.chi_square(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    p, q, n = 57, 50, 107
    want = sum((table.get((a, b), 0) - r * c / n) ** 2 / (r * c / n) for a, r in (("x", 50), ("y", 50), ("z", 7)) for b, c in (("p", p), ("q", q)))
    assert row["statistic"] == pytest.approx(want) and row["df"] == 2 and row["p_value"] == pytest.approx(math.exp(-want / 2))


@pytest.mark.parametrize("x, dof, p", [(3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (1.0, 10, 0.99982788), (0.0, 3, 1.0)])
def test_tails_of_chi_square(x, dof, p):
    assert ml._gamma_tail(dof / 2, x / 2) == pytest.approx(p, abs=1e-7)
