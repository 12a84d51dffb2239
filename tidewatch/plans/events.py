"""Event types: single inheritance, merged fields, and the envelope of a stream."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import conditions

KINDS = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "bool": T.BooleanType()}
AUTOMATIC = {"id": T.StringType(), "pid": T.StringType(), "timestamp": T.LongType()}


def kind(name: str, subtype: str = "string") -> T.DataType:
    """The Spark type of a declared one."""
    inner = KINDS.get(subtype, T.StringType())
    more = {"list": T.ArrayType(T.StructType().add("key", "string").add("value", "double") if subtype == "kv" else inner), "map": T.MapType(T.StringType(), inner), "mlist": T.MapType(T.StringType(), T.ArrayType(inner)), "mmap": T.ArrayType(T.StructType().add("key", "string").add("value", "double"))}
    found = KINDS.get(name) or more.get(name)
    if found is None:
        raise ValueError(f"unknown type {name!r}")
    return found


@dataclass(frozen=True)
class EventType:
    name: str
    parent: str | None = None
    properties: dict[str, str] = field(default_factory=dict)


class Registry:
    """Event types by name. A root has no parent or itself; a cycle ends where it begins."""

    def __init__(self, types: list[EventType]):
        self.types = {t.name: t for t in types}

    def ancestors(self, name: str) -> list[str]:
        out: list[str] = []
        while name and name not in out:
            out.append(name)
            name = self.types[name].parent if name in self.types else None
        return out

    def is_a(self, name: str, ancestor: str) -> bool:
        return ancestor in self.ancestors(name)

    def descendants(self, name: str) -> list[str]:
        return sorted({name, *(t for t in self.types if self.is_a(t, name))})

    def matches(self, column: Column, name: str) -> Column:
        """Whether an event's name is this type or one below it: a list of literals, nothing to join."""
        return F.coalesce(column.isin(self.descendants(name)), F.lit(False))

    def matches_sql(self, name: str) -> str:
        """The same of the column name, in SQL text."""
        return f"coalesce(name IN ({', '.join(map(conditions.quoted, self.descendants(name)))}), false)"

    def schema(self, name: str) -> T.StructType:
        """All fields: inherited ones first, replaced by a child's of the same name, then the automatic ones."""
        merged: dict[str, T.DataType] = {}
        for t in reversed(self.ancestors(name)):
            merged |= {k: kind(v) for k, v in (self.types[t].properties if t in self.types else {}).items()}
        return T.StructType([T.StructField(k, v) for k, v in (merged | AUTOMATIC).items()])

    def strict(self, df: DataFrame, column: str = "name") -> tuple[DataFrame, DataFrame]:
        """(events of known types, the others)."""
        known = F.coalesce(F.col(column).isin(list(self.types)), F.lit(False))
        return df.where(known), df.where(~known)
