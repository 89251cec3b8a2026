"""A guide is a titled list of chart specifications with display labels for columns."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from tablesight.plans.spec import parse_measure


@dataclass(frozen=True)
class Guide:
    report_title: str = ""
    columns: Mapping[str, str] = field(default_factory=dict)
    charts: tuple[Mapping[str, Any], ...] = ()

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> Guide:
        return cls(str(raw.get("report_title") or ""), dict(raw.get("columns") or {}),
                   tuple(raw.get("charts") or ()))

    def to_dict(self) -> dict[str, Any]:
        return {"report_title": self.report_title, "columns": dict(self.columns), "charts": list(self.charts)}


def load_guide(path: str) -> Guide:
    """Read a guide from a JSON or YAML file."""
    text = Path(path).read_text(encoding="utf-8")
    if path.lower().endswith(".json"):
        return Guide.from_dict(json.loads(text))
    try:
        import yaml
    except ImportError as err:
        raise RuntimeError("YAML guides need the yaml module; use JSON instead") from err
    return Guide.from_dict(yaml.safe_load(text) or {})


def repair_guide(guide: Guide) -> Guide:
    """Write count bars as explicit aggregates and drop ``agg`` where the chart counts by itself.

    Every other requested function is kept as it is.
    """
    charts = []
    for chart in guide.charts:
        chart = dict(chart)
        if str(chart.get("agg") or "").lower() == "count":
            if chart.get("type") == "bar":
                x, y = (str(chart.get(k) or "").replace("$", "") for k in ("x", "y"))
                chart["aggregate"] = {"groupby": [x], "measures": [y or x], "how": "count"}
                del chart["agg"]
            elif chart.get("type") == "histogram":
                del chart["agg"]
        charts.append(chart)
    return Guide(guide.report_title, guide.columns, tuple(charts))


def build_guide(recommendations: Iterable[Mapping[str, Any]], generated: Iterable[Mapping[str, Any]] | None = None,
                title: str = "Report", files: Mapping[str, Mapping[str, str]] | None = None) -> Guide:
    """Turn chart recommendations into a guide with ``$column`` references.

    ``generated`` lists the charts that were made (id, title, type); by default every recommendation.
    ``files`` maps a chart id to its output files by format.
    """
    recommendations = list(recommendations)
    specs = {r.get("id"): r.get("spec") or {} for r in recommendations if r.get("id")}
    if generated is None:
        generated = [{"id": r.get("id"), "type": r.get("type"),
                      "title": r.get("title_suggestion") or r.get("title") or r.get("id")} for r in recommendations]
    charts = []
    for made in generated:
        chart = _chart_entry(made, specs.get(made.get("id"), {}))
        if files and made.get("id") in files:
            chart["files"] = dict(files[made["id"]])
        charts.append(chart)
    used = sorted({v[1:] for c in charts for v in c.values() if isinstance(v, str) and v.startswith("$")})
    return Guide(title, {name: name.replace("_", " ").title() for name in used}, tuple(charts))


# Which columns of a specification an entry of each kind names; other kinds name all of them.
_ALL_FIELDS = ("x", "y", "color", "size", "symbol", "facet_row", "facet_col", "animation_frame")
_FIELDS = {"histogram": ("x",), "pie": ("x", "color")}


def _chart_entry(made: Mapping[str, Any], spec: Mapping[str, Any]) -> dict[str, Any]:
    """A guide entry from a specification: names, then each field that adds a column, then the function."""
    kind, title = made.get("type", "chart"), made.get("title", made.get("id"))
    function, measure = parse_measure(spec.get("y"))
    columns = {name: spec.get(name) for name in _ALL_FIELDS} | {"y": measure}
    if kind == "pie":
        columns["color"] = columns["color"] or columns["x"]
    # A second field on the same column adds nothing: color may repeat y, the others neither x nor y.
    repeats = {"color": (columns["x"],) if kind != "pie" else ()} | {name: (columns["x"], measure) for name in _ALL_FIELDS[3:]}
    entry = {"name": title, "type": kind, "title": title}
    for name in _FIELDS.get(kind, _ALL_FIELDS):
        if columns[name] and columns[name] not in repeats.get(name, ()):
            entry[name] = f"${columns[name]}"
    how = function or str(spec.get("aggregation") or "").lower()
    if kind not in _FIELDS and how not in ("", "none"):
        entry["agg"] = {"mean": "avg"}.get(how, how)
    return entry
