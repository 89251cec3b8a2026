import pytest
from conftest import values
from pyspark.sql import functions as F

from tablesight.operators import monitor
from tablesight.streaming import windowed_health, windowed_totals

SCHEMA = """session_id string, files array<struct<name:string,exists:boolean>>, latency_ms double, processing_type string,
            rag_index_present boolean, errors array<string>"""


@pytest.mark.parametrize("row, score, status, alerts", [
    ((None, None, None, None, None), 100, "healthy", []),
    (([("a", True)], 60000.0, "RAG", True, []), 100, "healthy", []),
    (([("a", True), ("b", False)], 60001.0, "table", False, ["x"]), 55, "degraded",
     ["Missing files: b", "High answer latency: 60001.0 ms > 60000 ms", "Error: x"]),
    (([("a", False), ("b", False)], 1e5, "RAG", False, list("123456")), 0, "failing",
     ["Missing files: a, b", "High answer latency: 100000.0 ms > 60000 ms", "RAG index not found after qualitative processing",
      "Error: 1", "Error: 2", "Error: 3", "Error: 4", "Error: 5"]),
    (([], 10.0, "RAG", None, ["x"]), 75, "degraded", ["RAG index not found after qualitative processing", "Error: x"]),
])
def test_health(spark, row, score, status, alerts):
    out = monitor.health(spark.createDataFrame([("s", *row)], SCHEMA)).first()
    assert (out["health_score"], out["status"], out["alerts"]) == (score, status, alerts)


def test_first_errors_only(spark):
    events = spark.createDataFrame([(i % 2, i, f"m{i:02d}", i % 3 == 0) for i in range(40)], "s int, at int, m string, bad boolean")
    out = {r["s"]: r["errors"] for r in monitor.first_errors(events, "s", "at", F.col("m"), F.col("bad")).collect()}
    assert out == {0: ["m00", "m06", "m12", "m18", "m24"], 1: ["m03", "m09", "m15", "m21", "m27"]}


def test_catalog(spark):
    files = spark.createDataFrame([("s", "/a.csv", 10), ("s", "/b.PDF", 20), ("t", "/c.json", 5), ("u", "/d.zip", 1), ("v", None, None)], "session string, path string, size long")
    sources = monitor.classify_sources(files, "path")
    assert values(sources, "path", "data_nature", "media_type")[:2] == [("/a.csv", "structured", "text/csv"), ("/b.PDF", "unstructured", "application/pdf")]
    assert dict((r[0], r[2]) for r in values(monitor.upload_mix(sources, ["session"]))) == {
        "s": "mixed", "t": "flexible", "u": "unknown", "v": "none"}
    assert monitor.catalog_summary(sources).first()["total"] == 5


@pytest.mark.parametrize("sizes, expected", [
    ([14_999_999], "inline_batch"), ([15_000_000], "files_api_single"), ([50_000_000], "files_api_individual"),
    ([10_000_000, 10_000_000], "files_api_individual"), ([None], "inline_batch")])
def test_upload_class(spark, sizes, expected):
    files = spark.createDataFrame([("s", n) for n in sizes], "s string, size long")
    assert monitor.upload_class(files, ["s"], "size").first()["upload_class"] == expected


def test_steps_runs_and_answers(spark):
    steps = spark.createDataFrame([
        ("s", "ROOT", "completed", 9.0, 9, 9, None), ("s", "a", "completed", 0.5, 10, 1, "x"), ("s", "rag_processing", "failed", None, None, 2, "found"),
        ("t", "a", "running", 0.25, 1, 1, None)],
        "session_id string, step_id string, status string, cost double, input_tokens long, output_tokens long, output string")
    assert values(monitor.step_summary(steps)) == [("s", 1, 1, 2, 0.5, 10, 3), ("t", 0, 0, 1, 0.25, 1, 1)]
    runs = spark.createDataFrame([("r", True, 2.0), ("r", False, 2.0), ("q", False, 0.0)], "run string, made boolean, seconds double")
    assert values(monitor.run_summary(runs, ["run"], "made", "seconds"), "run", "success_rate", "charts_per_second", "status") == [
        ("q", 0.0, 0.0, "failed"), ("r", 0.5, 0.25, "partial_success")]
    sessions = spark.createDataFrame([("s", "", "p", None), ("t", "own", "p", "Chart"), ("u", None, None, "")],
                                     "session_id string, answer string, primary_classification string, secondary_classification string")
    assert values(monitor.answers(sessions, steps), "session_id", "final_answer", "secondary_classification") == [
        ("s", "found", "None"), ("t", "own", "Chart"), ("u", None, "None")]


def test_stream_gives_the_batch_result(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # The last row only moves the watermark past every window.
    end = events.orderBy("event_id").limit(1).withColumn("ts", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))
    folder = str(tmp_path / "in")
    events.repartition(3).write.parquet(folder)
    end.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10).parquet(folder)
    for build in (
        lambda e: windowed_health(e, "ts", "value", F.col("event_type") == "error", ["event_type"], threshold_ms=100),
        lambda e: windowed_totals(e, "ts", "value").drop("value"),
    ):
        query = build(stream).writeStream.outputMode("append").format("memory").queryName("out").option(
            "checkpointLocation", str(tmp_path / f"cp{id(build)}")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert values(spark.table("out")) == values(build(events))
