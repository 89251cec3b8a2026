"""One chart specification: shorthand expansion, aliases, and choice of omitted fields.

``make_spec`` turns a loose mapping (as written by people or models) into a frozen ``ChartSpec`` against
the roles of one table. It runs no Spark job.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from tablesight.plans.roles import SchemaRoles

# The words that ask for a field to be chosen from the schema.
AUTO = ("auto", "auto_x", "auto_y", "auto_color")
# Functions that may be written as ``function(column)``.
MEASURE_FUNCTIONS = ("sum", "avg", "mean", "count", "min", "max")
CHART_TYPES = ("line", "bar", "scatter", "heatmap", "treemap", "table", "histogram", "pie")
# Chart types whose rows are combined even when only y is named.
_AGGREGATED_TYPES = ("line", "bar")


class SpecError(ValueError):
    """A specification that cannot be evaluated on this table."""


@dataclass(frozen=True)
class Aggregate:
    how: str | tuple[str, ...] | Mapping[str, Any] = "sum"
    groupby: tuple[str, ...] = ()
    measures: tuple[str, ...] = ()


@dataclass(frozen=True)
class TopN:
    n: int = 5
    by: str | None = None
    category: str | None = None
    scope: str = "overall"
    group: str | None = None


@dataclass(frozen=True)
class ChartSpec:
    type: str
    name: str = ""
    title: str = ""
    x: str | None = None
    y: str | None = None
    color: str | None = None
    size: str | None = None
    symbol: str | None = None
    facet_row: str | None = None
    facet_col: str | None = None
    animation_frame: str | None = None
    hover: tuple[str, ...] = ()
    value: str | None = None
    names: str | None = None
    path: tuple[str, ...] = ()
    filter: Mapping[str, Any] = field(default_factory=dict)
    compute: Mapping[str, str] = field(default_factory=dict)
    params: Mapping[str, Any] = field(default_factory=dict)
    top_n: TopN | None = None
    aggregate: Aggregate | None = None
    pivot: Mapping[str, Any] | None = None
    sort_by: tuple[str, ...] = ()
    ascending: bool = True
    limit: int | None = None
    nbins: int = 20
    histfunc: str | None = None
    trendline: bool = False

    @property
    def extra_keys(self) -> tuple[str, ...]:
        """Encodings that split a chart further: facets and animation frame."""
        return tuple(k for k in (self.facet_row, self.facet_col, self.animation_frame) if k)


def as_list(value: Any) -> list[str]:
    """A list from a list or a comma separated string."""
    if value is None:
        return []
    parts = value.split(",") if isinstance(value, str) else value
    return [str(p).strip() for p in parts if str(p).strip()]


def parse_measure(text: Any) -> tuple[str | None, str | None]:
    """``sum(price)`` → (``sum``, ``price``); any other value → (None, value)."""
    if isinstance(text, str):
        match = re.fullmatch(r"\s*([^()]*?)\s*\((.*)\)\s*", text, re.DOTALL)
        if match:
            function = match.group(1).lower()
            return (function if function in MEASURE_FUNCTIONS else None), match.group(2).strip()
    return None, text


class _Resolver:
    """Fields of one raw specification with aliases and automatic choices applied."""

    def __init__(self, raw: Mapping[str, Any], roles: SchemaRoles, aliases: Iterable[str]):
        self.raw, self.roles = raw, roles
        self.aliases = {a.lstrip("$") for a in aliases}
        computed = tuple((raw.get("compute") or {}).keys())
        self.columns = set(roles.all) | set(computed)

    def choose(self, role: str, avoid: Iterable[str | None] = ()) -> str | None:
        r, avoid = self.roles, set(avoid)
        order = {
            "x": r.dates + r.categoricals + r.numerics,
            "y": r.numerics, "size": r.numerics,
            "color": r.categoricals,
        }[role]
        return next((c for c in order if c not in avoid), None)

    def name(self, value: Any) -> str | None:
        """Column meant by a field value: ``$alias`` and ``auto_*`` are replaced."""
        if value is None:
            return None
        text = str(value)
        bare = text[1:] if text.startswith("$") else text
        if bare in ("auto_x", "auto_y", "auto_color"):
            return self.choose(bare[len("auto_"):])
        return bare

    def given(self, key: str) -> str | None:
        value = self.raw.get(key)
        return None if value in (None, "", *AUTO) else self.name(value)

    def present(self, key: str) -> str | None:
        """The field if it names a column of the data, else nothing."""
        name = self.name(self.raw.get(key)) if isinstance(self.raw.get(key), str) else None
        return name if name in self.columns else None

    def names(self, value: Any) -> tuple[str, ...]:
        return tuple(n for n in (self.name(v) for v in as_list(value)) if n)


def make_spec(raw: Mapping[str, Any], roles: SchemaRoles, aliases: Iterable[str] = (),
              position: int = 1) -> ChartSpec:
    """Complete one raw chart specification against a table's roles."""
    kind = str(raw.get("type") or "").lower()
    if kind not in CHART_TYPES:
        raise SpecError(f"unknown chart type {raw.get('type')!r}")
    function, y_raw = parse_measure(raw.get("y"))
    raw = {**raw, **({"y": y_raw} if "y" in raw else {})}
    r = _Resolver(raw, roles, aliases)

    aggregate = _aggregate(raw, r, function, kind)
    x = r.given("x") or (aggregate.groupby[0] if aggregate and aggregate.groupby else None)
    y, value, path, names = r.given("y"), None, (), None
    x_chosen = x or r.choose("x")
    color_chosen = r.given("color") or r.choose("color", [r.given("x")])

    if kind in ("line", "bar", "scatter", "heatmap"):
        x = x_chosen
        y = y or r.choose("y", [x] if kind != "line" else ())
    if kind == "heatmap":
        value = r.given("value") or r.choose("y", [x])
    elif kind == "treemap":
        value = r.given("value") or y or r.choose("y")
        path = r.names(raw.get("path")) if raw.get("path") is not None else ()
        path = path or tuple(p for p in [color_chosen or x_chosen] if p)
    elif kind == "histogram":
        x = x_chosen
    elif kind == "pie":
        names = r.given("names") or r.given("color") or x or r.choose("color") or x_chosen

    if aggregate is not None:
        default_keys = {"heatmap": (x, y), "treemap": path}.get(kind, (x, r.present("color")))
        groupby = aggregate.groupby or tuple(dict.fromkeys(c for c in default_keys if c and c in r.columns))
        measures = aggregate.measures or tuple(m for m in [value or y or r.choose("y")] if m)
        aggregate = replace(aggregate, groupby=groupby, measures=measures)

    name = str(raw.get("name") or raw.get("title") or f"Chart {position}")
    sort = raw.get("sort") or {}
    by = sort.get("by") if isinstance(sort, Mapping) else None
    return ChartSpec(
        type=kind, name=name, title=str(raw.get("title") or name), x=x, y=y,
        color=r.present("color"), size=r.present("size"), symbol=r.present("symbol"),
        facet_row=r.present("facet_row"), facet_col=r.present("facet_col"),
        animation_frame=r.present("animation_frame"),
        hover=tuple(h for h in r.names(raw.get("hover")) if h in r.columns),
        value=value, names=names, path=path,
        filter=raw.get("filter") or {}, compute=raw.get("compute") or {}, params=raw.get("params") or {},
        top_n=_top_n(raw, r, y, color_chosen, x_chosen), aggregate=aggregate,
        pivot=_pivot(raw.get("pivot"), r),
        sort_by=r.names(by), ascending=bool(sort.get("ascending", True)) if by else True,
        limit=int(raw["limit"]) if raw.get("limit") is not None else None,
        nbins=int(raw.get("nbins") or 20), histfunc=raw.get("histfunc") or (_function(raw) or function if kind == "histogram" else None),
        trendline=bool(raw.get("trendline")),
    )


def _aggregate(raw, r: _Resolver, function: str | None, kind: str) -> Aggregate | None:
    given = raw.get("aggregate")
    if given:
        how = given.get("how", "sum")
        how = tuple(how) if isinstance(how, list) else how
        measures = given.get("measures") or ([given["measure"]] if given.get("measure") else [])
        return Aggregate(how, r.names(given.get("groupby")), r.names(measures))
    if kind == "histogram":
        return None  # its function works per bin
    how = _function(raw) or function
    by = r.names(raw.get("by"))
    measure = raw.get("measure") or raw.get("value") or raw.get("y")
    measure = r.name(measure) if measure not in (None, *AUTO) else None
    asked = bool(how or by or raw.get("measure"))
    if not asked and not (kind in _AGGREGATED_TYPES):
        return None
    return Aggregate(str(how).lower() if how else "sum", by, (measure,) if measure else ())


def _function(raw) -> str | None:
    return raw.get("agg") or raw.get("Agg") or raw.get("AGG")


def _top_n(raw, r: _Resolver, y, color, x) -> TopN | None:
    given = raw.get("top_n")
    if given is None or given is False:
        return None
    if isinstance(given, int):
        given = {"n": given}
    return TopN(
        n=int(given.get("n", 5)),
        by=r.name(given.get("by")) or y or r.choose("y"),
        # The chosen color ranks before x when no category is named.
        category=r.name(given.get("category")) or color or x,
        scope=given.get("scope", "overall"),
        group=r.name(given.get("group")) or x,
    )


def _pivot(given, r: _Resolver) -> dict[str, Any] | None:
    if not given:
        return None
    return {
        "index": r.names(given.get("index")),
        "columns": r.name(given["columns"]),
        "values": r.name(given["values"]),
        "aggfunc": given.get("aggfunc", "sum"),
        "fill_value": given.get("fill_value", 0),
    }
