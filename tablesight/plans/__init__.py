"""Chart specifications: plain data, checked and completed on the driver before any Spark plan exists."""

from tablesight.plans.guide import Guide, build_guide, load_guide, repair_guide
from tablesight.plans.roles import SchemaRoles, schema_roles
from tablesight.plans.spec import Aggregate, ChartSpec, SpecError, TopN, make_spec, parse_measure

__all__ = [
    "Aggregate", "ChartSpec", "Guide", "SchemaRoles", "SpecError", "TopN", "build_guide", "load_guide",
    "make_spec", "parse_measure", "repair_guide", "schema_roles",
]
