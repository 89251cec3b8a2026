import json

from pyspark.sql import functions as F

from tablesight.operators import matching, records


def blocks(spark, *texts, required=("a",)):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return [(r["json"], r["json_source"], r["json_error"]) for r in records.json_blocks(df, "t", required).orderBy("id").collect()]


def test_json_blocks(spark):
    assert blocks(
        spark, 'x ```JSON\n{"a": {"b": 1}}\n``` y', 'see {"a": 1} end', '{"b": 1}', "none", '{"a": ', None,
        '```json\n{"a": 1\n``` and {"a": 2}', "[1, 2]",
    ) == [
        ('{"a": {"b": 1}}', "fenced", None), ('{"a": 1}', "braced", None), (None, None, "missing required key: a"),
        (None, None, "no JSON object could be read"), (None, None, "no JSON object could be read"),
        (None, None, "no JSON object could be read"),
        (None, None, "no JSON object could be read"), (None, None, "no JSON object could be read"),
    ]
    assert blocks(spark, '{"z": 1}', required=()) == [('{"z": 1}', "braced", None)]


def test_rejects(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("no",)], "t string")
    out = records.json_blocks(df, "t", ["a"])
    assert records.accepted(out).count() == 1 and records.rejected(out).count() == 1


def insights(spark, *documents):
    df = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)], "doc int, j string")
    return df, records.insights(df, "doc", "j").orderBy("doc", "position").collect()


def test_insight_shapes(spark):
    one = {"visualization_id": "v", "title": "T"}
    _, rows = insights(
        spark, [one, 3, {"id": "", "viz_id": "w", "name": "N", "insight": "I", "evidence": ["e"], "so_what": "S", "limitations": ["l"],
                         "references": {"png_path": "p.png"}, "narrative": "text"}],
        {"items": [one]}, {"insights": "no list", "charts": [one, one]}, one, {"title": "only"}, "not json")
    assert [(r["doc"], r["visualization_id"], r["title"]) for r in rows] == [
        (0, "v", "T"), (0, "w", "N"), (1, "v", "T"), (2, "v", "T"), (2, "v", "T"), (3, "v", "T")]
    full = rows[1].asDict(recursive=True)
    assert full["primary_insight"] == "I" and full["supporting_evidence"] == ["e"] and full["decision_relevance"] == "S"
    assert full["caveats"] == ["l"] and full["narrative"] == "text"
    assert full["references"] == {"html_path": None, "png_path": "p.png", "svg_path": None}
    assert rows[0]["primary_insight"] == "" and rows[0]["caveats"] == []


def test_narratives_by_position_or_heading(spark):
    items = [{"id": "a", "title": "First one", "narrative": "own"}, {"id": "b", "title": "Second"}]
    aligned = {"insights": items, "narrative_sections": [{"heading": "zzz", "body": "B1"}, "plain"]}
    headed = {"insights": items, "narrative_sections": [{"heading": "SECOND!", "body": "old"}, {"heading": "second", "body": "new"}, {"heading": "x", "body": "y"}]}
    without = {"insights": items}
    df, _ = insights(spark, aligned, headed, without)
    out = matching.attach_narratives(records.insights(df, "doc", "j"), records.narrative_sections(df, "doc", "j"), "doc")
    assert [r["narrative"] for r in out.orderBy("doc", "position").collect()] == ["B1", "plain", "own", "new", "own", ""]
    assert out.where(F.col("narrative").isNull()).count() == 0
