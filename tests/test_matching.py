import random

import pytest
from conftest import values
from pyspark.sql import functions as F

from tablesight.operators import matching


@pytest.mark.parametrize("budget", [matching.AUTOMATON_BYTES, 0])
def test_containing_equals_brute_force(spark, budget):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab_") for _ in range(n))
    hay = sorted({word(rng.randint(0, 12)) for _ in range(60)})
    needles = sorted({word(rng.randint(1, 5)) for _ in range(40)})
    out = matching.containing(spark.createDataFrame([(h,) for h in [*hay, None, "aaa" * 3000]], "h string"), "h",
                              spark.createDataFrame([(n,) for n in [*needles, None, ""]], "n string"), "n", budget)
    assert values(out, "h", "n") == sorted((h, n) for h in [*hay, "aaa" * 3000] for n in needles if n in h)
    more = spark.createDataFrame([(n, len(n)) for n in needles], "n string, size int")
    out = matching.containing(spark.createDataFrame([(h, "x") for h in hay], "h string, other string"), "h", more, "n", budget)
    assert values(out, "h", "other", "n", "size") == sorted((h, "x", n, len(n)) for h in hay for n in needles if n in h)


@pytest.mark.parametrize("budget", [matching.AUTOMATON_BYTES, -1])
def test_no_needles(spark, budget):
    hay = spark.createDataFrame([("abc",)], "h string")
    assert matching.containing(hay, "h", spark.createDataFrame([], "n string"), "n", budget).count() == 0


def test_only_pairs_are_shuffled(spark):
    hay = spark.createDataFrame([("abc", 1)], "h string, i int")
    plan = matching.containing(hay, "h", spark.createDataFrame([("b",)], "n string"), "n")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_kept_charts(spark):
    charts = spark.createDataFrame([(1, "Sales By Region", None), (2, "x", "My Sales by region 2"), (3, None, "none"), (4, "Sales By", "Region")],
                                   "i int, name string, title string")
    done = spark.createDataFrame([("sales_by_region",), ("sales_by_region",)], "id string")
    assert values(matching.keep_successful(charts, "name", "title", done, "id"), "i") == [(1,), (2,)]


def test_assets(spark):
    insights = spark.createDataFrame([("Viz_1", "a"), ("viz_2", "b"), ("viz_3", "c")], "visualization_id string, t string")
    files = spark.createDataFrame([(2, "/x/my_VIZ_1_final.png"), (1, "/x/viz_1.JPEG"), (0, "/x/viz_1.html"), (3, "/x/viz_2.txt"), (4, "/viz_2/other.svg")],
                                  "n int, path string")
    explicit = spark.createDataFrame([("viz_2", None, "given.png", "")], "visualization_id string, html_path string, png_path string, svg_path string")
    out = matching.match_assets(insights, "visualization_id", files, "path", explicit, "n")
    assert values(out, "visualization_id", "html_path", "png_path", "svg_path") == [
        ("Viz_1", "/x/viz_1.html", "/x/viz_1.JPEG", None), ("viz_2", None, "given.png", None), ("viz_3", None, None, None)]
    assert values(matching.missing_assets(out), "visualization_id") == [("viz_3",)]
    plain = matching.match_assets(insights, "visualization_id", files, "path")
    assert values(plain, "png_path") == [("/x/my_VIZ_1_final.png",), (None,), (None,)]


@pytest.mark.parametrize("n, combined", [(0, None), (1, "u0"), (2, None)])
def test_urls(spark, n, combined):
    insights = spark.createDataFrame([("t0",), ("t9",)], "title string")
    urls = spark.createDataFrame([(f"t{i}", f"u{i}") for i in range(n)], "name string, url string")
    out = matching.attach_urls(insights, urls)
    assert values(out) == [("t0", "u0" if n else None, combined), ("t9", None, combined)]


def test_manifest(spark):
    manifest = spark.createDataFrame([("s", "a.CSV", "/a.CSV"), ("s", "b", "/b"), ("u", "c", None)], "session string, name string, path string")
    files = spark.createDataFrame([("/a.CSV",), ("/a.CSV",)], "path string")
    checked = matching.check_manifest(manifest, files, "path")
    assert values(checked, "name", "extension", "exists") == [("a.CSV", ".csv", True), ("b", "", False), ("c", "", False)]
    assert values(matching.availability(checked, ["session"])) == [("s", 0.5), ("u", 0.0)]
    assert matching.availability(checked.where("false")).first()[0] == 1.0


def test_missing_formats(spark):
    df = spark.createDataFrame([(["png", "html"], ["html"])], "e array<string>, c array<string>")
    assert df.select(matching.missing_formats(F.col("e"), F.col("c"))).first()[0] == ["png"]
