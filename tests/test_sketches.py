import pytest
from pyspark.sql import functions as F

from tablesight.operators import sketches


def by_name(df):
    return {r["name"]: r for r in df.collect()}


@pytest.fixture
def table(spark):
    return spark.sql("SELECT id, concat('k', id % 50) AS s, CASE WHEN id % 10 > 0 THEN id * 0.5D END AS f, CAST(NULL AS string) AS e, "
                     "CASE WHEN id = 3 THEN double('nan') ELSE 1.0D END AS n FROM range(6000)")


def test_merged_parts_equal_the_whole(spark, table, tmp_path):
    path = str(tmp_path / "sketches")
    assert sketches.merged(sketches.read_sketches(spark, path)).collect() == []
    for k in range(3):
        sketches.append_sketches(sketches.sketch(table.where(F.col("id") % 3 == k), F.lit(k)), path)
    sketches.append_sketches(sketches.sketch(table.where(F.col("id") % 3 == 0), F.lit(0)), path)  # again
    parts = by_name(sketches.merged(sketches.read_sketches(spark, path)))
    whole = by_name(sketches.merged(sketches.sketch(table, F.lit("all"))))
    for name in ("id", "s", "f", "e", "n"):
        a, b = parts[name], whole[name]
        assert (a["rows"], a["nulls"], a["least"], a["greatest"]) == (b["rows"], b["nulls"], b["least"], b["greatest"])
        exact = table.agg(F.count_distinct(name)).first()[0]
        assert abs(a["unique_count"] - exact) <= max(sketches.DISTINCT_ERROR * exact, 0)
    assert (parts["id"]["least"], parts["id"]["greatest"], parts["f"]["nulls"], parts["e"]["quantiles"]) == ("0.0", "5999.0", 600, None)
    for got, q in zip(parts["id"]["quantiles"], sketches.QUANTILES):
        assert abs(got / 6000 - q) <= sketches.RANK_ERROR


def test_only_new_files_are_read(spark, table, tmp_path):
    data, path, asked = str(tmp_path / "data"), str(tmp_path / "sketches"), []

    def files():
        return spark.read.parquet(data).select(F.input_file_name().alias("path")).distinct()

    def read(paths):
        asked.append(len(paths))
        return spark.read.parquet(*paths)

    table.repartition(2).write.parquet(data)
    first = by_name(sketches.profile_files(spark, files(), read, path))
    table.where("id < 100").repartition(1).write.mode("append").parquet(data)
    second = by_name(sketches.profile_files(spark, files(), read, path))
    assert asked == [2, 1] and (first["s"]["rows"], second["s"]["rows"]) == (6000, 6100)
    assert by_name(sketches.profile_files(spark, files(), read, path))["s"]["rows"] == 6100 and len(asked) == 2
