"""User expressions for ``filter.query`` and ``compute`` as Spark columns.

The strings follow Python's expression grammar (``a > 1 & b in ['x']``, ``@param``, `` `odd name` ``), so
Python's own ``ast`` module reads them; this module only maps each node to a column.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from tablesight.functions.nulls import col

_PARAM = "param__"
_QUOTED = "quoted__"

# Functions whose name differs between the expression language and Spark SQL.
_RENAMED = {"arctan2": "atan2", "arcsin": "asin", "arccos": "acos", "arctan": "atan", "log": "ln"}


# What texts written by users or models may call: functions of values. None of them reaches files, classes or settings.
ALLOWED = frozenset("""
    abs acos add_months asin atan atan2 bround cbrt ceil ceiling char_length character_length coalesce concat concat_ws contains cos date_add
    date_diff date_format date_sub date_trunc datediff day dayofmonth dayofweek dayofyear degrees endswith exp expm1 floor greatest hour
    hypot if ifnull initcap instr isnan isnotnull isnull last_day lcase least left length ln locate log log10 log1p log2 lower lpad ltrim
    make_date minute mod month months_between nanvl negative nullif nvl nvl2 overlay pmod position positive pow power quarter radians
    regexp_count regexp_extract regexp_like regexp_replace repeat replace reverse right rint round rpad rtrim second sign signum sin
    split_part sqrt startswith substr substring substring_index tan to_date to_timestamp translate trim trunc try_add try_divide
    try_mod try_multiply try_subtract try_to_timestamp ucase upper weekday weekofyear when width_bucket year
""".split())
# Functions that users have registered, by name.
REGISTERED: set[str] = set()


class ExpressionError(ValueError):
    """The expression uses something that has no column equivalent."""


def predicate(text: str, schema: T.StructType, params: Mapping[str, Any] | None = None) -> Column:
    """Column for a row filter. A comparison with a missing value is false, its negation true."""
    return _Translator(text, schema, params, two_valued=False).column()


def compute(text: str, schema: T.StructType, params: Mapping[str, Any] | None = None) -> Column:
    """Column for a derived value. Division by zero gives NULL; comparisons never give NULL."""
    return _Translator(text, schema, params, two_valued=True).column()


class _Translator:
    def __init__(self, text, schema, params, two_valued):
        self.fields = {f.name: f.dataType for f in schema}
        self.params = dict(params or {})
        self.two_valued = two_valued
        self.quoted: list[str] = []
        self.text = text
        source = re.sub(r"`([^`]+)`", self._keep_quoted, text.strip().replace("\n", " "))
        try:
            self.tree = ast.parse(_python_tokens(source), mode="eval").body
        except (SyntaxError, tokenize.TokenError) as err:
            raise ExpressionError(f"cannot read expression {text!r}: {err}") from err

    def _keep_quoted(self, match):
        self.quoted.append(match.group(1))
        return f"{_QUOTED}{len(self.quoted) - 1}"

    def column(self) -> Column:
        return self._as_column(self._visit(self.tree))

    # -- values -----------------------------------------------------------------------------------

    def _visit(self, node) -> Any:
        method: Callable | None = getattr(self, f"_{type(node).__name__.lower()}", None)
        if method is None:
            raise ExpressionError(f"{type(node).__name__} is not supported in {self.text!r}")
        return method(node)

    def _as_column(self, value) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    def _operand(self, node) -> Column:
        return self._as_column(self._visit(node))

    def _constant(self, node):
        return node.value

    def _list(self, node):
        return [self._visit(e) for e in node.elts]

    _tuple = _list

    def _name(self, node):
        if node.id.startswith(_PARAM):
            name = node.id[len(_PARAM):]
            if name not in self.params:
                raise ExpressionError(f"parameter @{name} is not defined")
            return self.params[name]
        name = self._column_name(node)
        if name in self.fields:
            return col(name)
        if name in self.params:
            return self.params[name]
        raise ExpressionError(f"unknown column {name!r} in {self.text!r}")

    def _column_name(self, node) -> str | None:
        if not isinstance(node, ast.Name):
            return None
        if node.id.startswith(_QUOTED):
            return self.quoted[int(node.id[len(_QUOTED):])]
        return node.id

    def _is_text(self, node) -> bool:
        if isinstance(node, ast.Constant):
            return isinstance(node.value, str)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            return self._is_text(node.left) or self._is_text(node.right)
        return isinstance(self.fields.get(self._column_name(node) or ""), T.StringType)

    # -- logic ------------------------------------------------------------------------------------

    def _boolop(self, node):
        result = self._operand(node.values[0])
        for value in node.values[1:]:
            other = self._operand(value)
            result = (result & other) if isinstance(node.op, ast.And) else (result | other)
        return result

    def _unaryop(self, node):
        if isinstance(node.op, (ast.Not, ast.Invert)):
            return ~F.coalesce(self._operand(node.operand), F.lit(False))
        value = self._visit(node.operand)
        return -value if isinstance(node.op, ast.USub) else value

    def _compare(self, node):
        result, left = None, node.left
        for op, right in zip(node.ops, node.comparators):
            test = self._comparison(left, op, right)
            if self.two_valued:
                test = F.coalesce(test, F.lit(False))
            result = test if result is None else result & test
            left = right
        return result

    def _comparison(self, left, op, right):
        a, b = self._visit(left), self._visit(right)
        if isinstance(b, (list, tuple, set)) or isinstance(op, (ast.In, ast.NotIn)):
            return self._membership(self._as_column(a), op, b)
        if isinstance(op, ast.NotEq):
            if isinstance(a, Column) != isinstance(b, Column):
                column, literal = (a, b) if isinstance(a, Column) else (b, a)
                return (column != F.lit(literal)) | column.isNull()
            return ~F.coalesce(self._as_column(a) == self._as_column(b), F.lit(False))
        a, b = self._as_column(a), self._as_column(b)
        tests = {ast.Eq: a.__eq__, ast.Lt: a.__lt__, ast.LtE: a.__le__, ast.Gt: a.__gt__, ast.GtE: a.__ge__}
        if type(op) not in tests:
            raise ExpressionError(f"comparison {type(op).__name__} is not supported in {self.text!r}")
        return tests[type(op)](b)

    def _membership(self, value, op, choices):
        if not isinstance(choices, (list, tuple, set)):
            raise ExpressionError(f"'in' needs a list in {self.text!r}")
        test = is_in(value, list(choices))
        if isinstance(op, (ast.NotIn, ast.NotEq)):
            return ~F.coalesce(test, F.lit(False))
        return test

    # -- arithmetic -------------------------------------------------------------------------------

    def _binop(self, node):
        a, b = self._operand(node.left), self._operand(node.right)
        op = type(node.op)
        if op is ast.Add:
            return F.concat(a, b) if self._is_text(node.left) or self._is_text(node.right) else a + b
        if op is ast.Sub:
            return a - b
        if op is ast.Mult:
            return a * b
        if op is ast.Div:
            return F.try_divide(a.cast("double"), b.cast("double"))
        if op is ast.FloorDiv:
            return F.floor(F.try_divide(a.cast("double"), b.cast("double")))
        if op is ast.Mod:
            # The result takes the divisor's sign.
            rest = F.try_mod(a, b)
            return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)
        if op is ast.Pow:
            return F.pow(a, b)
        raise ExpressionError(f"operator {op.__name__} is not supported in {self.text!r}")

    # -- calls ------------------------------------------------------------------------------------

    def _call(self, node):
        args = [self._operand(a) for a in node.args]
        if isinstance(node.func, ast.Name):
            name = node.func.id
            name = _RENAMED.get(name, name)
            if name.lower() not in ALLOWED and name not in REGISTERED:
                raise ExpressionError(f"function {name} is not allowed in {self.text!r}")
            return F.call_function(name, *args)
        if isinstance(node.func, ast.Attribute):
            owner = node.func.value
            if isinstance(owner, ast.Attribute) and owner.attr == "str":
                owner = owner.value
            return self._method(self._operand(owner), node.func.attr, args)
        raise ExpressionError(f"this call is not supported in {self.text!r}")

    def _method(self, value, name, args):
        if name in ("isna", "isnull"):
            return value.isNull()
        if name in ("notna", "notnull"):
            return value.isNotNull()
        methods = {
            "contains": lambda v, p: F.rlike(v, p), "startswith": F.startswith, "endswith": F.endswith,
            "lower": F.lower, "upper": F.upper, "strip": F.trim, "len": F.length, "abs": F.abs,
        }
        if name not in methods:
            raise ExpressionError(f"method {name} is not supported in {self.text!r}")
        return methods[name](value, *args)


def is_in(value: Column, choices: list) -> Column:
    """Membership in which NULL is matched by a None in the list."""
    known = [c for c in choices if c is not None]
    test = value.isin(known) if known else F.lit(False)
    return (test | value.isNull()) if len(known) < len(choices) else test


def _python_tokens(source: str) -> str:
    """Spell ``&``, ``|`` and ``@name`` the way Python's grammar gives them the intended precedence."""
    words = {"&": "and", "|": "or"}
    out = []
    after_at = False
    for tok in tokenize.generate_tokens(io.StringIO(source).readline):
        if tok.type == tokenize.OP and tok.string == "@":
            after_at = True
            continue
        text = _PARAM + tok.string if after_at else words.get(tok.string, tok.string)
        after_at = False
        if tok.type not in (tokenize.NEWLINE, tokenize.ENDMARKER, tokenize.NL):
            out.append(text)
    return " ".join(out)
