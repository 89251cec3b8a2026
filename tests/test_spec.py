import json

import pytest

from tablesight.plans import (
    Guide, SchemaRoles, SpecError, build_guide, load_guide, make_spec, parse_measure, repair_guide)
from tablesight.plans.spec import as_list

ROLES = SchemaRoles(("day",), ("price", "qty"), ("region", "kind"), ("day", "region", "price", "qty", "kind"))


def test_lists_and_measures():
    assert as_list("a, b ,,c") == ["a", "b", "c"]
    assert as_list(["a", " b "]) == ["a", "b"]
    assert as_list(None) == []
    assert parse_measure("SUM(price)") == ("sum", "price")
    assert parse_measure("avg( a(b) )") == ("avg", "a(b)")
    assert parse_measure("weird(price)") == (None, "price")
    assert parse_measure("price") == (None, "price")


def test_omitted_fields_are_chosen():
    spec = make_spec({"type": "line"}, ROLES)
    assert (spec.x, spec.y, spec.color) == ("day", "price", None)
    assert spec.aggregate.groupby == ("day",) and spec.aggregate.measures == ("price",)


def test_shorthand():
    spec = make_spec({"type": "bar", "agg": "avg", "by": "region,kind", "measure": "qty", "top_n": 3}, ROLES)
    assert spec.x == "region"
    assert spec.aggregate.how == "avg" and spec.aggregate.groupby == ("region", "kind")
    assert spec.top_n.n == 3 and spec.top_n.by == "price" and spec.top_n.category == "region"


def test_function_in_y_is_honoured():
    spec = make_spec({"type": "bar", "x": "region", "y": "mean(price)"}, ROLES)
    assert spec.y == "price" and spec.aggregate.how == "mean"


def test_aliases():
    spec = make_spec({"type": "bar", "x": "$region", "y": "$price", "color": "$nothing", "agg": "sum"}, ROLES,
                     ["region", "price"])
    assert (spec.x, spec.y, spec.color) == ("region", "price", None)
    spec = make_spec({"type": "bar", "x": "auto_x", "y": "auto", "color": "auto_color"}, ROLES)
    assert (spec.x, spec.y, spec.color) == ("day", "price", "region")


def test_top_n_category_prefers_color():
    given = make_spec({"type": "bar", "x": "kind", "y": "qty", "color": "region", "top_n": 2}, ROLES)
    assert given.top_n.category == "region"
    inferred = make_spec({"type": "bar", "x": "region", "y": "qty", "top_n": 2}, ROLES)
    assert inferred.top_n.category == "kind"
    only_x = make_spec({"type": "bar", "x": "day", "y": "qty", "top_n": 2}, SchemaRoles(("day",), ("qty",), (), ("day", "qty")))
    assert only_x.top_n.category == "day"


def test_encodings_outside_the_data_are_dropped():
    spec = make_spec({"type": "scatter", "x": "qty", "y": "price", "facet_row": "kind", "facet_col": "no", "hover": ["day", "no"]}, ROLES)
    assert spec.facet_row == "kind" and spec.facet_col is None and spec.hover == ("day",)
    assert spec.aggregate is None


def test_heatmap_and_treemap_fields():
    heat = make_spec({"type": "heatmap", "x": "region", "y": "kind"}, ROLES)
    assert heat.value == "price" and heat.aggregate is None
    tree = make_spec({"type": "treemap"}, ROLES)
    assert tree.path == ("region",) and tree.value == "price"


def test_unknown_type():
    with pytest.raises(SpecError):
        make_spec({"type": "radar"}, ROLES)


def test_guide_from_recommendations():
    guide = build_guide([
        {"id": "a", "type": "bar", "title_suggestion": "A", "spec": {"x": "region", "y": "mean(price)", "color": "region", "size": "price", "symbol": "kind"}},
        {"id": "b", "type": "pie", "title_suggestion": "B", "spec": {"x": "kind", "y": "qty", "aggregation": "sum"}},
        {"id": "c", "type": "histogram", "title_suggestion": "C", "spec": {"x": "unit_price", "y": "qty"}},
    ], title="T", files={"a": {"png": "a.png"}})
    a, b, c = guide.charts
    assert a == {"name": "A", "type": "bar", "title": "A", "x": "$region", "y": "$price", "symbol": "$kind", "agg": "avg", "files": {"png": "a.png"}}
    assert b == {"name": "B", "type": "pie", "title": "B", "x": "$kind", "color": "$kind"}
    assert c == {"name": "C", "type": "histogram", "title": "C", "x": "$unit_price"}
    assert guide.columns["unit_price"] == "Unit Price"


def test_repair_keeps_requested_functions():
    guide = repair_guide(Guide("", {}, (
        {"type": "bar", "x": "$region", "y": "$price", "agg": "count"},
        {"type": "histogram", "x": "$price", "agg": "count"},
        {"type": "bar", "x": "$region", "y": "$price", "agg": "avg"})))
    assert guide.charts[0]["aggregate"] == {"groupby": ["region"], "measures": ["price"], "how": "count"}
    assert "agg" not in guide.charts[0] and "agg" not in guide.charts[1]
    assert guide.charts[2]["agg"] == "avg"


def test_load_guide(tmp_path):
    content = {"report_title": "R", "columns": {"a": "A"}, "charts": [{"type": "table"}]}
    (tmp_path / "g.json").write_text(json.dumps(content))
    assert load_guide(str(tmp_path / "g.json")).to_dict() == content
    pytest.importorskip("yaml")
    (tmp_path / "g.yaml").write_text("report_title: R\ncolumns: {a: A}\ncharts:\n  - type: table\n")
    assert load_guide(str(tmp_path / "g.yaml")).to_dict() == content
