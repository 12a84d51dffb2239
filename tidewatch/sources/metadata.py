"""Metadata: versioned definitions, their revisions, the bundle that a detection run loads, and checks before saving.

Revisions are appended to a Parquet table, one row a save; the newest of a name is its definition. One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import cel, conditions
from tidewatch.operators import rules
from tidewatch.plans.events import Registry

KINDS = ("event", "variable", "strategy")
STATUS = ("draft", "inedit", "test", "online", "outline")
SCHEMA = "kind string, name string, version long, status string, body string, author string, revision long"


class Conflict(ValueError):
    """Someone else saved in the meantime."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def revisions(self, kind: str | None = None, name: str | None = None) -> DataFrame:
        try:
            x = self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:
            x = self.spark.createDataFrame([], SCHEMA)
        for column, value in (("kind", kind), ("name", name)):
            x = x if value is None else x.where(F.col(column) == value)
        return x

    def listed(self, kind: str | None = None, status: tuple[str, ...] = STATUS) -> DataFrame:
        """The newest revision of each definition."""
        newest = self.revisions(kind).groupBy("kind", "name").agg(F.max_by(F.struct("version", "status", "body", "author", "revision"), "revision").alias("r"))
        return newest.select("kind", "name", "r.*").where(F.col("status").isin(*status))

    def revision(self) -> int:
        """Rises with each save of anything."""
        return self.revisions().agg(F.coalesce(F.max("revision"), F.lit(0))).first()[0]

    def save(self, kind: str, body: dict, version: int = 0, status: str = "draft", author: str = "") -> int:
        """The new version of a definition; version is the one it was read at, 0 for a new one."""
        if kind not in KINDS or status not in STATUS:
            raise ValueError(f"unknown kind or status: {kind!r}, {status!r}")
        now = self.revisions(kind, body["name"]).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        if now != version:
            raise Conflict(f"{body['name']} is at version {now}, not {version}")
        row = [(kind, body["name"], now + 1, status, json.dumps(body, sort_keys=True), author, self.revision() + 1)]
        self.spark.createDataFrame(row, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return now + 1

    def stats(self) -> DataFrame:
        return self.listed().groupBy("kind", "status").agg(F.count("*").alias("n"))

    def bundle(self) -> dict:
        """What a detection run loads. The revision is read first, so a save meanwhile shows as a newer one next time."""
        revision = self.revision()
        out: dict = {"revision": revision, **{k: [] for k in KINDS}}
        for r in self.listed(status=("online", "test")).orderBy("kind", "name").toLocalIterator():
            out[r.kind].append(json.loads(r.body) | {"status": r.status})
        return out


def problems(s: rules.Strategy, events: Registry, variables: set[str] = frozenset()) -> list[str]:
    """What is wrong with a strategy: unknown events, fields, variables, operators and algorithms."""
    out = []

    def fields(event: str | None) -> set[str] | None:
        return set(events.schema(event).names) if event in events.types else None

    def known(event: str, what: str) -> None:
        if event and event not in events.types:
            out.append(f"{what}: unknown event {event!r}")

    known(s.event, "trigger")
    trees = [s.condition, (s.delay or {}).get("condition"), *(x.get("condition") for x in (s.sequence or {}).get("steps", ()))]
    for x in (s.sequence or {}).get("steps", ()):
        known(x.get("event"), "step")
    for leaf in (leaf for t in trees for leaf in rules.leaves(t)):
        if "cel" in leaf:
            try:
                cel.parse(leaf["cel"])
            except ValueError as e:
                out.append(f"expression: {e}")
            continue
        if leaf["op"] not in conditions.OPERATORS:
            out.append(f"unknown operator {leaf['op']!r}")
        for o in filter(None, (leaf["left"], leaf.get("right"))):
            if o["kind"] == "event_field" and (f := fields(s.event)) and o["field"] not in f:
                out.append(f"unknown field {o['field']!r}")
            if o["kind"] == "variable" and rules.variable_name(o) not in variables:
                out.append(f"unknown variable {rules.variable_name(o)!r}")
            if o["kind"] == "counter":
                c = o.get("counter", o)
                known(c.get("event"), "counter")
                if c["algorithm"] not in rules.ALGORITHMS:
                    out.append(f"unknown counter {c['algorithm']!r}")
                for f in (*(c.get("operand") or ()), *(c.get("groupby") or ())):
                    if (own := fields(c.get("event"))) and f not in own:
                        out.append(f"unknown field {f!r}")
    return out
