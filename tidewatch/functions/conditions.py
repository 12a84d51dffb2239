"""Predicates over event fields: 24 comparison operators and two shapes of condition tree, as Spark columns.

Comparisons are two-valued: a null or wrongly typed left side makes the plain operator false and its negation true. The
type of the left side is known from the schema, so the branch is chosen when the plan is built. Constants are strings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Resolves an IP column at a level ("country", "province", "city") to a name; unknown addresses give "unknown".
Locator = Callable[[Column, str], Column]

PLAIN = ("==", "empty", ">", ">=", "<", "<=", "contains", "startwith", "endwith", "regex", "containsby", "in", "locationequals", "locationcontainsby")
#: Every operator; the orderings have no negation of their own.
OPERATORS = tuple(op for p in PLAIN for op in ((p,) if p in (">", ">=", "<", "<=") else (p, "!=" if p == "==" else f"!{p}")))


def unknown_location(ip: Column, level: str) -> Column:
    return F.lit("unknown")


def parsed(constant: object) -> float | None:
    try:
        return float(str(constant).strip())
    except ValueError:
        return None


def items(constant: object) -> list[str]:
    return [str(x) for x in constant] if isinstance(constant, (list, tuple)) else [x.strip() for x in str(constant).split(",")]


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name_of(column: str) -> str:
    """A column's name in SQL text."""
    return "`" + column.replace("`", "``") + "`"


class Constant:
    """A right side that is known when the plan is built, in SQL text."""

    def __init__(self, value: object):
        text = "null" if value is None else str(value)
        number = parsed(value)
        self.number = None if number is None else f"double({quoted(repr(number))})"
        self.text, self.pattern = quoted(text), quoted(f"^(?:{text})\\z")
        self.truth = str(text.lower() == "true" if isinstance(value, bool) else text == "true").lower()
        self.items = list(map(quoted, items(value)))

    def holds(self, x: str) -> str:
        return f"{x} IN ({', '.join(self.items)})" if self.items else "false"


class Other:
    """A right side that is another operand of the same row, in SQL text. Types are strict: only text is read as a number."""

    def __init__(self, sql: str, kind: T.DataType):
        number = isinstance(kind, T.NumericType)
        self.number = f"cast({sql} as double)" if number else f"try_cast(trim({sql}) as double)" if isinstance(kind, T.StringType) else None
        self.text = f"coalesce(cast({sql} as string), 'null')"
        self.pattern = f"concat('^(?:', {self.text}, ')\\\\z')"
        self.truth = f"coalesce({sql}, false)" if isinstance(kind, T.BooleanType) else f"({self.text} = 'true')"
        self.each = f"transform({sql}, x -> cast(x as string))" if isinstance(kind, T.ArrayType) else f"transform(split({self.text}, ','), x -> trim(x))"

    def holds(self, x: str) -> str:
        return f"array_contains({self.each}, {x})"


def compare_sql(op: str, left: str, kind: T.DataType, right: Constant | Other) -> str:
    """A comparison in SQL text that is never null; all operators but those of places."""
    if op not in OPERATORS or "location" in op:
        raise ValueError(f"unknown operator {op!r}")
    if op == "!=" or op[0] == "!":
        return f"(NOT {compare_sql('==' if op == '!=' else op[1:], left, kind, right)})"
    number, text, flag = isinstance(kind, T.NumericType), isinstance(kind, T.StringType), isinstance(kind, T.BooleanType)
    if op == "empty":
        return f"({left} IS NULL OR {left} = '')" if text else f"({left} IS NULL)"
    if op in ("==", ">", ">=", "<", "<=") and (number or op != "=="):
        if not number or right.number is None:
            return "false"
        return f"coalesce(cast({left} as double) {op} {right.number}, false)"
    if op == "==":
        return f"coalesce({left} = {right.truth}, false)" if flag else f"coalesce(cast({left} as string) = {right.text}, false)"
    if op == "in":
        return f"coalesce({right.holds(f'cast({left} as string)')}, false)"
    if not text:
        return "false"
    found = {"contains": "contains({0}, {1})", "startwith": "startswith({0}, {1})", "endwith": "endswith({0}, {1})", "containsby": "contains({1}, {0})", "regex": "rlike({0}, {2})"}
    return f"coalesce({found[op].format(left, right.text, right.pattern)}, false)"


def compare(op: str, left: str, kind: T.DataType, right: object, locate: Locator = unknown_location) -> Column:
    """A boolean column that is never null; left in SQL text. An operator that isn't known is an error when the plan is built."""
    if op in OPERATORS and "location" in op:
        place = F.coalesce(F.nullif(locate(F.expr(left).cast("string"), "province"), F.lit("")), F.lit("unknown"))
        found = place == str(right) if op.endswith("equals") else place.isin(items(right))
        return ~found if op[0] == "!" else found
    return F.expr(compare_sql(op, left, kind, right if isinstance(right, (Constant, Other)) else Constant(right)))


def type_of(df: DataFrame, name: str) -> T.DataType:
    """The type of a field; one that the schema lacks is always null."""
    return df.schema[name].dataType if name in df.columns else T.NullType()


def field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def field_sql(kinds: dict[str, T.DataType], name: str) -> str:
    return name_of(name) if name in kinds else "NULL"


def filter_sql(kinds: dict[str, T.DataType], node: dict | None) -> str | None:
    """The tree below in SQL text; nothing if it asks for places."""
    if not node:
        return "true"
    kind = node.get("type", "simple")
    if kind == "simple":
        if "location" in node["operation"] and node["operation"] in OPERATORS:
            return None
        return compare_sql(node["operation"], field_sql(kinds, node["object"]), kinds.get(node["object"], T.NullType()), Constant(node.get("value")))
    if kind not in ("and", "or", "not"):
        raise ValueError(f"unknown filter node {kind!r}")
    children = [filter_sql(kinds, c) for c in node.get("condition", [])]
    if None in children:
        return None
    if kind == "not":
        return f"(NOT {children[0]})" if children else "true"
    return "(" + f" {kind.upper()} ".join(children) + ")" if children else str(kind == "and").lower()


def filter_tree(df: DataFrame, node: dict | None, locate: Locator = unknown_location) -> Column:
    """{type: simple|and|or|not, object, operation, value, condition: [...]}; an empty tree is true, "not" takes its first child."""
    kinds = {f.name: f.dataType for f in df.schema}
    return _tree(kinds, node, locate)


def _tree(kinds: dict[str, T.DataType], node: dict | None, locate: Locator) -> Column:
    if (text := filter_sql(kinds, node)) is not None:
        return F.expr(text)
    if node.get("type", "simple") == "simple":
        return compare(node["operation"], field_sql(kinds, node["object"]), kinds.get(node["object"], T.NullType()), node.get("value"), locate)
    return combined(node["type"], [_tree(kinds, c, locate) for c in node.get("condition", [])])


def combined(kind: str, children: list[Column]) -> Column:
    if kind == "not":
        return ~children[0] if children else F.lit(True)
    return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), children, F.lit(kind == "and"))
