"""A small expression language for rules, parsed to Spark columns.

    f(args)   name   "text"   a == "x"   a != "x"   a in ["x", "y"]   a > 1  >= < <=   !( ... )

Functions: inTimeWindow("HH:MM", "HH:MM") - start included, end excluded, past midnight if the start is later;
ipLocation(ip, level); checkNotice(type, key, strategy, seconds), which the rule layer supplies.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.conditions import Locator, field, unknown_location

TOKEN = re.compile(r"""\s*(?:("[^"]*"|'[^']*')|(-?\d+(?:\.\d+)?)|([A-Za-z_]\w*)|(==|!=|>=|<=|[><(),!\[\]]))""")
#: Other names of the key types.
KEY_TYPES = {"ip": "IP", "c_ip": "IP", "uid": "USER", "user": "USER", "did": "DEVICE", "device": "DEVICE", "order_id": "ORDER", "order": "ORDER"}
ZONE = "Asia/Shanghai"


class Call:
    def __init__(self, name: str, args: list):
        self.name, self.args = name, args


class Name(str):
    pass


def parse(text: str):
    """A tree of tuples (op, left, right), Call, Name, str and float."""
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:]!r}")
        tokens.append(("text", m[1][1:-1]) if m[1] else ("number", float(m[2])) if m[2] else ("name", m[3]) if m[3] else ("sign", m[4]))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def take(sign: str | None = None):
        nonlocal place
        kind, value = tokens[place]
        if sign is not None and (kind, value) != ("sign", sign):
            raise ValueError(f"{sign!r} is missing in {text!r}")
        place += 1
        return kind, value

    def listed(end: str) -> list:
        out = []
        while tokens[place] != ("sign", end):
            out.append(term())
            if tokens[place] == ("sign", ","):
                take()
        take(end)
        return out

    def term():
        kind, value = take()
        if kind in ("text", "number"):
            return value
        if kind != "name":
            raise ValueError(f"a value is missing in {text!r}")
        if tokens[place] == ("sign", "("):
            take()
            return Call(value, listed(")"))
        return Name(value)

    def condition():
        if tokens[place] == ("sign", "!"):
            take()
            take("(")
            inner = condition()
            take(")")
            return ("not", inner, None)
        left = term()
        kind, value = tokens[place]
        if (kind, value) == ("name", "in"):
            take()
            take("[")
            return ("in", left, listed("]"))
        if kind == "sign" and value in ("==", "!=", ">", ">=", "<", "<="):
            take()
            return (value, left, term())
        return ("true", left, None)

    tree = condition()
    if tokens[place][0] != "end":
        raise ValueError(f"{text!r} goes on after its end")
    return tree


def calls(tree, name: str) -> list[Call]:
    if isinstance(tree, Call):
        return [tree] * (tree.name == name)
    return [c for x in tree if not isinstance(x, str) for c in calls(x, name)] if isinstance(tree, (tuple, list)) else []


def minutes(text: str) -> int:
    m = re.fullmatch(r"(\d{1,2}):(\d\d)", str(text).strip())
    if not m or int(m[1]) > 23 or int(m[2]) > 59:
        raise ValueError(f"{text!r} isn't HH:MM")
    return int(m[1]) * 60 + int(m[2])


def in_time_window(ts: Column, start: str, end: str, zone: str = ZONE) -> Column:
    """Whether epoch milliseconds fall into a daily window of this zone."""
    from tidewatch.operators.windows import local_time

    local = local_time(ts, zone)
    now, a, b = F.hour(local) * 60 + F.minute(local), minutes(start), minutes(end)
    return (now >= a) & (now < b) if a <= b else (now >= a) | (now < b)


def compile_cel(df: DataFrame, text: str, zone: str = ZONE, locate: Locator = unknown_location, notices: dict[str, Column] | None = None) -> Column:
    """A boolean column that is never null. notices: by the text of a checkNotice call, its count."""

    def term(x) -> Column:
        if isinstance(x, Name):
            return field(df, x)
        if not isinstance(x, Call):
            return F.lit(x)
        if x.name == "inTimeWindow":
            return in_time_window(F.col("ts"), *x.args, zone=zone)
        if x.name == "ipLocation":
            return F.coalesce(F.nullif(locate(term(x.args[0]).cast("string"), x.args[1]), F.lit("")), F.lit("unknown"))
        if x.name == "checkNotice":
            notice_key(x)
            return (notices or {})[notice_key(x)]
        raise ValueError(f"unknown function {x.name!r}")

    def condition(tree) -> Column:
        op, left, right = tree
        if op == "not":
            return ~condition(left)
        value = term(left)
        if op == "true":
            return F.coalesce(value.cast("boolean"), F.lit(False))
        if op == "in":
            return F.coalesce(value.cast("string").isin([str(x) for x in right]), F.lit(False))
        if op in ("==", "!="):
            same = F.coalesce(value.cast("string") == str(right), F.lit(False))
            return same if op == "==" else ~same
        x, y = value.try_cast("double"), float(right)
        return F.coalesce({">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op], F.lit(False))

    return condition(parse(text))


def notice_key(call: Call) -> str:
    """A checkNotice call as text; errors for a key type that isn't known or a time that isn't positive."""
    kind, key, strategy, seconds = call.args
    if str(kind).lower() not in KEY_TYPES and kind not in KEY_TYPES.values():
        raise ValueError(f"unknown key type {kind!r}")
    if not isinstance(seconds, float) or seconds <= 0:
        raise ValueError("checkNotice looks back a positive number of seconds")
    return f"{KEY_TYPES.get(str(kind).lower(), kind)}|{key}|{strategy}|{int(seconds)}"
