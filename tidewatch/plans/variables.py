"""Variables: a graph of declared statistics, compiled to columns on the event stream.

Each variable becomes one column with its value after the row's event, and only the variables asked for and what they
stand on are compiled. Variables that share keys and a frame share a shuffle. Events keep their row, so no gather step is
needed to bring the values of several dimensions together.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType
from pyspark.sql.window import Window

from tidewatch.functions import conditions
from tidewatch.functions.conditions import Locator, unknown_location
from tidewatch.operators import aggregates, windows
from tidewatch.plans.events import Registry

NODES = ("event", "filter", "aggregate", "dual", "sequence", "top")


@dataclass(frozen=True)
class Variable:
    name: str
    type: str
    sources: tuple[str, ...] = ()
    method: str = ""
    object: str = ""
    param: str = ""
    keys: tuple[str, ...] = ()
    period: windows.Period = field(default_factory=windows.Period)
    filter: dict | None = None
    #: Steps applied to the event's fields: {field: {"direct": f} | {"constant": x} | {"concat": [...]} | {"location": [ip, level]}}.
    mapping: dict | None = None
    mapping_first: bool = False

    @classmethod
    def load(cls, d: dict) -> Variable:
        """A variable from its JSON form."""
        f, p = d.get("function") or {}, d.get("period") or {}
        source = tuple(s["name"] for s in d.get("source") or ())
        param = (f.get("config") or {}).get("param", f.get("param", ""))
        period = windows.Period(p.get("type", ""), p.get("value")) if d["type"] in ("aggregate", "sequence") else windows.Period()
        return cls(d["name"], d["type"], source, f.get("method", ""), f.get("object", ""), str(param), tuple(d.get("groupbykeys") or ()), period, d.get("filter") or None, d.get("mapping"), bool(d.get("mapping_first")))

    @property
    def number(self) -> int | None:
        """The parameter as a number; a field's name there is none."""
        return int(self.param) if re.fullmatch(r"\d+", self.param or "") else None


def load_directory(path: str) -> list[Variable]:
    return [Variable.load(json.loads(p.read_text())) for p in sorted(Path(path).glob("*.json")) if p.name != "index.json"]


class Graph:
    """Variables by name, with what each stands on."""

    def __init__(self, variables: list[Variable], events: Registry):
        self.variables, self.events = {v.name: v for v in variables}, events
        for v in variables:
            validate(v, self)

    def order(self, wanted: list[str]) -> list[Variable]:
        """What is needed for the wanted ones, each after what it stands on; a cycle is an error."""
        done: dict[str, Variable] = {}
        open_: list[str] = []

        def visit(name: str) -> None:
            if name in open_:
                raise ValueError("a cycle: " + " -> ".join([*open_[open_.index(name) :], name]))
            if name not in self.variables:
                if name in self.events.types:
                    return
                raise ValueError(f"{name!r} is neither a variable nor an event")
            if name in done:
                return
            open_.append(name)
            for s in self.variables[name].sources:
                if s != name:
                    visit(s)
            open_.pop()
            done[name] = self.variables[name]

        for name in wanted:
            visit(name)
        return list(done.values())

    def extended(self, more: list[Variable]) -> tuple[Graph, list[str]]:
        """The graph with more variables, and the names of those that start without history."""
        return Graph([*self.variables.values(), *(v for v in more if v.name not in self.variables)], self.events), [v.name for v in more if v.name not in self.variables]

    def compile(self, df: DataFrame, wanted: list[str], ordered: bool = True, lateness: int = windows.LATENESS, locate: Locator = unknown_location) -> DataFrame:
        """df with a column for each wanted variable: its value after the row's event, null where the event didn't reach it."""
        own = list(df.columns)
        state = _State(self, df if ordered else windows.classify(df, lateness), ordered, lateness, locate)
        for v in self.order(wanted):
            state.add(v)
        return state.df.select(*own, *(state.value(w).alias(w) for w in wanted))

    def probe(self, df: DataFrame, name: str, keys: DataFrame, ordered: bool = True) -> DataFrame:
        """keys with the variable's newest value, or its empty one for keys never seen."""
        v = self.variables[name]
        seen = self.compile(df, [name], ordered).where(F.col(name).isNotNull())
        last = seen.groupBy(*v.keys).agg(F.max_by(name, "seq").alias(name))
        nothing = empty(v, last.schema[name].dataType)
        return keys.join(last, list(v.keys), "left").withColumn(name, F.col(name) if nothing is None else F.coalesce(name, nothing))


def empty(v: Variable, kind: DataType) -> Column | None:
    """What an aggregate of this type gives for no input, where that isn't null: 0, an empty list or an empty map."""
    if v.type != "aggregate":
        return None
    if isinstance(kind, ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, MapType):
        return F.create_map().cast(kind)
    return F.lit(0).cast(kind) if v.method in ("count", "distinct_count", "distinct_count_approx", "sum", "variance", "stddev") else None


def validate(v: Variable, graph: Graph) -> None:
    """Errors that would otherwise show when the stream runs."""
    if v.type not in NODES:
        raise ValueError(f"{v.name}: unknown node {v.type!r}")
    if len(v.keys) > 2 or len(v.sources) > 2:
        raise ValueError(f"{v.name}: at most two keys and two sources")
    if v.type == "aggregate":
        aggregates.check(v.method)
        if v.method in ("group_count", "group_sum", "top", "topn") and not (v.param or v.object):
            raise ValueError(f"{v.name}: {v.method} needs a field")
    if v.type == "dual" and (len(v.sources) != 2 or v.method not in ("+", "-", "*", "/")):
        raise ValueError(f"{v.name}: a dual variable has two sources and one of + - * /")


class _State:
    def __init__(self, graph: Graph, df: DataFrame, ordered: bool, lateness: int, locate: Locator):
        self.graph, self.df, self.ordered, self.lateness, self.locate = graph, df, ordered, lateness, locate

    def passes(self, name: str) -> Column:
        """Whether the row's event reaches a node."""
        if name in self.graph.variables and f"p:{name}" in self.df.columns:
            return F.col(f"`p:{name}`")
        return self.graph.events.matches(F.col("name"), name)

    def value(self, name: str) -> Column:
        return F.when(self.passes(name), F.col(f"`v:{name}`"))

    def put(self, v: Variable, value: Column | None, passed: Column) -> None:
        self.df = self.df.withColumn(f"p:{v.name}", F.coalesce(passed, F.lit(False)))
        if value is not None:
            self.df = self.df.withColumn(f"v:{v.name}", value)

    def mapped(self, v: Variable) -> DataFrame:
        out = {}
        for name, step in (v.mapping or {}).items():
            ((how, x),) = step.items()
            out[name] = {"direct": lambda x: conditions.field(self.df, x), "constant": F.lit, "concat": lambda x: F.concat(*(conditions.field(self.df, f).cast("string") for f in x)), "location": lambda x: self.locate(F.col(x[0]), x[1])}[how](x)
        return self.df.withColumns(out) if out else self.df

    def add(self, v: Variable) -> None:
        reached = F.lit(False)
        for s in v.sources:
            if s != v.name:
                reached = reached | self.passes(s)
        if v.type == "event":
            self.put(v, F.lit(True), reached | self.graph.events.matches(F.col("name"), v.name))
            return
        if v.mapping and v.mapping_first:
            self.df = self.mapped(v)
        if v.type in ("filter", "aggregate", "sequence"):
            reached = reached & conditions.filter_tree(self.df, v.filter, self.locate)
        if v.type == "filter":
            self.put(v, F.lit(True), reached)
            if v.mapping and not v.mapping_first:
                self.df = self.mapped(v)
            return
        getattr(self, v.type)(v, reached)

    def operand(self, v: Variable) -> Column:
        """A field, the value of the variable below, or each event as such."""
        below = next((s for s in v.sources if s in self.graph.variables and self.graph.variables[s].type not in ("event", "filter")), None)
        if v.object in ("", "value"):
            return self.value(below) if below else F.lit(1)
        return conditions.field(self.df, {"timestamp": "ts"}.get(v.object, v.object))

    def aggregate(self, v: Variable, reached: Column) -> None:
        grouped = v.method in ("group_count", "group_sum", "top", "topn")
        x = self.operand(v)
        g = conditions.field(self.df, v.param if v.param in self.df.columns else v.object) if grouped else None
        if grouped and v.param not in self.df.columns:
            x = F.lit(1)
        self.put(v, None, reached)
        self.df = windows.with_keys(self.df, list(v.keys))
        out = windows.running(self.df, f"v:{v.name}", v.method, v.period, list(v.keys), x, g, v.number, F.col(f"`p:{v.name}`"), self.ordered, self.lateness)
        self.df = out

    def latest(self, name: str, keys: tuple[str, ...]) -> Column:
        """A source's newest value for the row's key, which may be older than the row."""
        self.df = windows.with_keys(self.df, list(keys))
        w = Window.partitionBy(*(f"_key_{k}" for k in keys)).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        return F.last(self.value(name), ignorenulls=True).over(w)

    def dual(self, v: Variable, reached: Column) -> None:
        keys = self.graph.variables[v.sources[1]].keys
        a, b = (self.latest(s, keys).cast("double") for s in v.sources)
        value = {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[v.method]
        self.put(v, value, reached & value.isNotNull())

    def sequence(self, v: Variable, reached: Column) -> None:
        x = conditions.field(self.df, {"timestamp": "ts", "": "ts"}.get(v.object, v.object)).cast("double")
        self.put(v, F.when(reached, x), reached & x.isNotNull())
        keys = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in v.keys]
        w = Window.partitionBy(*keys, f"`p:{v.name}`").orderBy("seq")
        # among the rows that passed only, as these are a partition of their own
        gap = F.col(f"`v:{v.name}`") - F.lag(f"`v:{v.name}`").over(w)
        self.put(v, gap, F.col(f"`p:{v.name}`") & F.col(f"`v:{v.name}`").isNotNull())
        self.df = self.df.withColumn(f"p:{v.name}", F.col(f"`p:{v.name}`") & F.col(f"`v:{v.name}`").isNotNull())

    def top(self, v: Variable, reached: Column) -> None:
        below = self.value(v.sources[0])
        is_map = self.df.schema[f"v:{v.sources[0]}"].dataType.typeName() == "map"
        value = aggregates.top(below, v.number) if is_map else F.lit(None).cast("array<struct<key:string,value:double>>")
        self.put(v, value, reached & value.isNotNull())
