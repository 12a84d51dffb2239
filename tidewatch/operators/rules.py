"""Rules: condition trees over fields, variables and inline counters; absence, sequences, history; deduplicated notices.

Counters and windows are Spark window expressions. The two folds that depend on what was decided before (which notice was
last emitted, how far a sequence has come) stream over partitions sorted by key and arrival and hold one key's state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewatch.functions import cel, conditions
from tidewatch.functions.conditions import Constant, Locator, Other, name_of, quoted, unknown_location
from tidewatch.operators import windows
from tidewatch.operators.windows import Period
from tidewatch.plans.events import Registry
from tidewatch.plans.variables import Graph

DEDUP, MOST_PARTIAL = 300, 16
ALGORITHMS = ("count", "distinct_count", "sum")
PLACE = ("geo_province", "geo_city", "uri_stem")
EXPLAIN = "map<string,struct<value:string,operator:string,threshold:string>>"


@dataclass(frozen=True)
class Strategy:
    name: str
    condition: dict | None = None
    event: str | None = None
    status: str = "online"
    action: dict = field(default_factory=dict)
    delay: dict | None = None
    sequence: dict | None = None
    effective: tuple[int | None, int | None] = (None, None)

    @classmethod
    def load(cls, d: dict) -> Strategy:
        return cls(d["name"], d.get("condition"), (d.get("trigger") or {}).get("event"), d.get("status", "online"), d.get("action") or {}, d.get("delay"), d.get("sequence"), (d.get("effective_from"), d.get("effective_to")))


def load_directory(path: str) -> list[Strategy]:
    return [Strategy.load(json.loads(p.read_text())) for p in sorted(Path(path).glob("*.json")) if p.name != "index.json"]


def leaves(node: dict | None) -> Iterator[dict]:
    if node and "conditions" in node:
        for c in node["conditions"]:
            yield from leaves(c)
    elif node:
        yield node


def variable_name(operand: dict) -> str:
    """The variable of an operand. Its keys are those of its definition; an operand's own keys say the same."""
    return operand["variable"] if "variable" in operand else operand["name"]


def label(operand: dict) -> str:
    """How an explanation names an operand."""
    kind = operand["kind"]
    if kind == "event_field":
        return operand["field"]
    if kind == "variable":
        return variable_name(operand)
    c = operand.get("counter", operand)
    return f"{c['algorithm']}({','.join(c.get('operand') or []) or '*'}) by {','.join(c.get('groupby') or [])} in {c['window']}s"


class Compiler:
    """One event stream with the counters and variables that a set of strategies asks for.

    Conditions become SQL text, parsed once for all strategies: a call across to the JVM for each part of each condition
    would take far longer than running them. What has no text (expressions, places) becomes a column that the text names.
    """

    def __init__(self, df: DataFrame, events: Registry, graph: Graph | None = None, ordered: bool = True, locate: Locator = unknown_location, zone: str = cel.ZONE):
        self.df, self.events, self.graph, self.ordered, self.locate, self.zone = df, events, graph, ordered, locate, zone
        self.counters: dict[str, str] = {}
        #: The types of the stream's columns; those of the events as they came stay in fields.
        self.kinds = {f.name: f.dataType for f in df.schema}
        self.fields = dict(self.kinds)
        self.notices: dict[str, Column] = {}
        self.made = 0

    def add(self, value: Column) -> str:
        """The name, in SQL text, of a new column of this value."""
        name = f"e:{self.made}"
        self.made += 1
        self.df = self.df.withColumn(name, value)
        return name_of(name)

    def counter(self, c: dict) -> str:
        """The column of an inline counter; equal ones share it. A counter counts every event of its type in the stream."""
        key = json.dumps(c, sort_keys=True)
        if key not in self.counters:
            out = f"c:{len(self.counters)}"
            where, x = self.counted(c)
            self.df = windows.with_keys(self.df, list(c.get("groupby") or ()))
            self.df = windows.running(self.df, out, c["algorithm"], Period("last_n_seconds", c["window"]), list(c.get("groupby") or ()), F.expr(x), where=F.expr(where), ordered=self.ordered)
            self.counters[key] = out
        return self.counters[key]

    def prepare(self, strategies: list[Strategy]) -> None:
        """Add the counters of many strategies at once, where their windows are plain frames."""
        asked = {json.dumps(o.get("counter", o), sort_keys=True): o.get("counter", o) for s in strategies for leaf in leaves(s.condition) for o in (leaf.get("left"), leaf.get("right")) if o and o.get("kind") == "counter"}
        new = {k: c for k, c in asked.items() if k not in self.counters}
        if not self.ordered or len(new) < 2:
            return
        counted = {k: self.counted(c) for k, c in new.items()}
        self.df = windows.with_keys(self.df, sorted({g for c in new.values() for g in c.get("groupby") or ()}))
        made = []
        for key, c in new.items():
            self.counters[key] = out = f"c:{len(self.counters)}"
            made.append(f"{windows.counter_sql(c['algorithm'], c['window'], list(c.get('groupby') or ()), *counted[key])} AS {name_of(out)}")
        self.df = self.df.selectExpr("*", *made)

    def counted(self, c: dict) -> tuple[str, str]:
        """(which events a counter counts, its operand) in SQL text."""
        if c["algorithm"] not in ALGORITHMS:
            raise ValueError(f"unknown counter {c['algorithm']!r}")
        where = conditions.filter_sql(self.fields, c.get("filter"))
        if where is None:
            where = self.add(conditions.filter_tree(self.df, c.get("filter"), self.locate))
        if c.get("event"):
            where = f"({where} AND {self.events.matches_sql(c['event'])})"
        operand = (c.get("operand") or [None])[0]
        return where, conditions.field_sql(self.fields, operand) if operand else "1"

    def operand(self, o: dict) -> tuple[str, T.DataType]:
        """(SQL text, type) of an operand."""
        kind = o["kind"]
        if kind == "event_field":
            return conditions.field_sql(self.fields, o["field"]), self.fields.get(o["field"], T.NullType())
        if kind == "variable":
            name = variable_name(o)
            if name not in self.kinds:
                if self.graph is None:
                    raise ValueError(f"unknown variable {name!r}")
                self.df = self.graph.compile(self.df, [name], self.ordered)
                self.kinds[name] = self.df.schema[name].dataType
            return name_of(name), self.kinds[name]
        if kind == "counter":
            c = o.get("counter", o)
            return name_of(self.counter(c)), T.DoubleType() if c["algorithm"] == "sum" else T.LongType()
        if kind == "constant":
            v = o.get("value")
            if isinstance(v, bool) or v is None:
                return str(v).lower() if v is not None else "NULL", T.BooleanType() if v is not None else T.NullType()
            return (f"double({quoted(repr(float(v)))})", T.DoubleType()) if isinstance(v, (int, float)) else (quoted(str(v)), T.StringType())
        raise ValueError(f"unknown operand {kind!r}")

    def tree(self, node: dict | None, known: bool | None = None) -> tuple[str, list[tuple[str, str, str]]]:
        """(whether it holds, its explanation: label, entry and when it is reached) in SQL text.

        Only comparisons that are reached explain; and/or stop early. known: the value that the tree is asked to explain, if
        it is known; where that settles what is reached, nothing is tested for it.
        """
        if not node:
            return "true", []
        if "conditions" in node:
            op = node["op"]
            if op not in ("and", "or", "not"):
                raise ValueError(f"unknown combination {op!r}")
            if op == "not":
                if not node["conditions"]:
                    return "false", []
                value, notes = self.tree(node["conditions"][0], None if known is None else not known)
                return f"(NOT {value})", notes
            go_on = op == "and"
            settled = known is go_on
            values, notes = [], []
            for c in node["conditions"]:
                value, own = self.tree(c, known if settled else None)
                reached = [] if settled or not values else [v if go_on else f"NOT {v}" for v in values]
                notes += [(name, entry, " AND ".join([*reached, *([when] if when else [])])) for name, entry, when in own]
                values.append(value)
            return "(" + f" {op.upper()} ".join(values) + ")" if values else str(go_on).lower(), notes
        if "cel" in node:
            return self.add(cel.compile_cel(self.df, node["cel"], self.zone, self.locate, self.notices)), []
        left, kind = self.operand(node["left"])
        right, op = node.get("right") or {"kind": "constant", "value": None}, node["op"]
        if op not in conditions.OPERATORS:
            raise ValueError(f"unknown operator {op!r}")
        fixed = right.get("kind", "constant") == "constant"
        if "location" in op:
            if not fixed:
                raise ValueError(f"{op!r} takes a constant")
            value = self.add(conditions.compare(op, left, kind, right.get("value"), self.locate))
        else:
            value = conditions.compare_sql(op, left, kind, Constant(right.get("value")) if fixed else Other(*self.operand(right)))
        if node["left"]["kind"] == "constant":
            return value, []
        threshold = quoted(str(right.get("value"))) if fixed else f"cast({self.operand(right)[0]} as string)"
        entry = f"named_struct('value', cast({left} as string), 'operator', {quoted(op)}, 'threshold', {threshold})"
        return value, [(label(node["left"]), entry, "")]

    def explained(self, notes: list[tuple[str, str, str]]) -> str:
        """The map of explanation entries; of those with one label the last that is reached stays."""
        if not notes:
            return f"cast(map() as {EXPLAIN})"
        if not any(when for *_, when in notes):
            last = {name: entry for name, entry, _ in notes}
            return f"cast(map({', '.join(f'{quoted(name)}, {entry}' for name, entry in last.items())}) as {EXPLAIN})"
        entries = [f"named_struct('key', {quoted(name)}, 'value', {entry})" for name, entry, _ in notes]
        entries = [f"CASE WHEN {when} THEN {entry} END" if when else entry for entry, (*_, when) in zip(entries, notes)]
        fold = "(m, e) -> map_concat(map_filter(m, (k, v) -> k <> e.key), map(e.key, e.value))"
        each = f"array_compact(array({', '.join(entries)}))"
        return f"aggregate(cast({each} as array<struct<key:string,value:struct<value:string,operator:string,threshold:string>>>), cast(map() as {EXPLAIN}), {fold})"

    def hit(self, s: Strategy) -> tuple[str, str, str]:
        """(whether it holds, subject, explanation) of a strategy on each event, in SQL text."""
        holds, notes = self.tree(s.condition, True)
        if s.event:
            holds = f"({holds} AND {self.events.matches_sql(s.event)})"
        for op, bound in zip((">=", "<"), s.effective):
            if bound is not None:
                holds = f"({holds} AND ts {op} {bound})"
        key = f"cast({conditions.field_sql(self.fields, s.action.get('check_value', 'uid'))} as string)"
        return holds, key, self.explained(notes if s.action.get("explain", True) else [])

    def place(self) -> list[str]:
        return [f"cast({conditions.field_sql(self.fields, f)} as string) AS {f}" for f in PLACE]

    def hits(self, s: Strategy) -> DataFrame:
        """(key, ts, seq, explanation, fields) of the events that a strategy holds for, before deduplication."""
        holds, key, explain = self.hit(s)
        return self.df.where(holds).selectExpr(f"{key} AS key", "ts", "seq", f"{explain} AS variable_values", *self.place())

    def all_hits(self, strategies: list[Strategy]) -> DataFrame:
        """(strategy, key, ts, seq, explanation, fields) of many strategies in one pass over the stream.

        One boolean a strategy is computed for every event; only those that hold are explained.
        """
        self.prepare(strategies)
        found = [self.hit(s) for s in strategies]  # all counters are columns from here on
        holding = ", ".join(f"CASE WHEN {holds} THEN {i} END" for i, (holds, *_) in enumerate(found))
        df = self.df.selectExpr("*", f"explode(array_compact(array({holding}))) AS _strategy")

        def of(texts: list[str]) -> str:
            same: dict[str, list[int]] = {}
            for i, text in enumerate(texts):
                same.setdefault(text, []).append(i)
            if len(same) == 1:
                return texts[0]
            return "CASE " + " ".join(f"WHEN _strategy IN ({', '.join(map(str, at))}) THEN {text}" for text, at in same.items()) + " END"

        key, explain = of([k for _, k, _ in found]), of([e for *_, e in found])
        return df.selectExpr("_strategy AS strategy", f"{key} AS key", f"{explain} AS variable_values", *self.place(), "ts", "seq")


ABOUT = "array<struct<check_type:string,strategy_name:string,scene_name:string,decision:string,risk_score:int,ttl:bigint,remark:string,tags:array<string>,test:boolean>>"


def described(s: Strategy) -> dict:
    """The fields of a strategy's notices that are the same in all of them."""
    a = s.action
    out = {"check_type": a.get("check_type", "USER"), "strategy_name": s.name, "scene_name": a.get("scene", ""), "decision": a.get("decision", "review")}
    return out | {"risk_score": int(a.get("score", 0)), "ttl": int(a.get("ttl", 300)) * 1000, "remark": a.get("remark", ""), "tags": list(a.get("tags", [])), "test": s.status == "test"}


def notices(hits: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """The notices of hits (strategy: its number): those not within the deduplication time of the last one emitted."""
    hits = hits.where("key is not null and key <> ''")
    windows_ = [int(s.action.get("dedup_window", DEDUP)) * 1000 for s in strategies]
    kept = deduplicated(hits, ["strategy", "key"], windows_)
    about = F.from_json(F.lit(json.dumps([described(s) for s in strategies])), ABOUT)
    x = kept.withColumn("_a", F.get(about, F.col("strategy")))
    fields = [f"_a.{n}" for n in ("check_type", "strategy_name", "scene_name", "decision", "risk_score")]
    return x.selectExpr("ts AS timestamp", "key", *fields, "ts + _a.ttl AS expire", "_a.remark", "_a.tags", "_a.test", *PLACE, "variable_values")


def _fold(df: DataFrame, keys: list[str], start, step, schema=None) -> DataFrame:
    """Rows in order of arrival within each key, as the step function lets them through. One key's state is held."""
    schema = schema or df.schema
    names = list(df.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                d = dict(zip(names, row))
                key = tuple(None if pd.isna(d[k]) else d[k] for k in keys)
                if key != last:
                    last, state = key, start()
                out += step(state, d)
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    return df.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInPandas(run, schema)


def deduplicated(hits: DataFrame, keys: list[str], window: int | list[int]) -> DataFrame:
    """Hits that come at least window ms after the last one kept of the same keys, in order of arrival; 0 keeps all.

    A list has a window for each number in the column strategy. One shuffle; Arrow batches are filtered as they are, and only
    their keys and times are looked at.
    """
    if window in (0, [0]) or isinstance(window, list) and not any(window):
        return hits
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, since = None, None
        for batch in batches:
            found = [batch.column(k).to_pylist() for k in range(width)]
            times = batch.column(width).to_pylist()
            gaps = [window[i] for i in batch.column(width + 1).to_pylist()] if isinstance(window, list) else [window] * len(times)
            mask = []
            for key, ts, gap in zip(zip(*found), times, gaps):
                if key != last:
                    last, since = key, None
                keep = since is None or ts - since >= gap
                if keep:
                    since = ts
                mask.append(keep)
            rest = batch.filter(pa.array(mask, pa.bool_()))
            yield pa.RecordBatch.from_arrays(rest.columns[width + 2 :], rest.schema.names[width + 2 :])

    heads = [F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]
    number = F.col("strategy") if isinstance(window, list) else F.lit(0)
    dealt = hits.repartition(*keys).sortWithinPartitions(*keys, "seq")
    return dealt.select(*heads, F.col("ts").alias("_ts"), number.alias("_n"), *(F.col(name_of(c)) for c in hits.columns)).mapInArrow(run, hits.schema)


def deduplicated_sql(hits: DataFrame, keys: list[str], window: int) -> DataFrame:
    """(keys, ts): the same in one expression, for keys whose hits fit in a row."""
    times = F.transform(F.array_sort(F.collect_list(F.struct("seq", "ts"))), lambda s: s["ts"])
    fold = F.aggregate(times, F.array().cast("array<bigint>"), lambda kept, t: F.when((F.size(kept) == 0) | (t - F.get(kept, F.size(kept) - 1) >= window), F.concat(kept, F.array(t))).otherwise(kept))
    return hits.groupBy(*keys).agg(fold.alias("ts")).select(*keys, F.explode("ts").alias("ts"))


def absent(compiler: Compiler, s: Strategy, flush: bool = False) -> DataFrame:
    """Delayed strategies: each hit is put off, and holds if its delay condition does then, on the hit's own fields.

    The put-off hits join the stream as rows that no counter counts, so the condition's counters see the window that ends
    when they are due. A hit that falls due after the stream's end never holds, but with flush. The explanation of the hit is
    kept, and the delay condition's entries are added to it.
    """
    wait = int(s.delay["seconds"]) * 1000
    fields = list(compiler.fields)
    base = compiler.df.select(*(name_of(c) for c in fields))
    first = Compiler(base, compiler.events, compiler.graph, compiler.ordered, compiler.locate, compiler.zone)
    first.notices = compiler.notices
    holds, _, explain = first.hit(s)
    parked = first.df.where(holds).selectExpr(*(name_of(c) for c in fields), f"{explain} AS _notes").withColumns({"ts": F.col("ts") + wait, "_probe": F.lit(True)})
    if not flush:
        parked = parked.where(F.col("ts") <= base.agg(F.max("ts")).scalar())
    both = base.withColumns({"_notes": F.lit(None).cast(EXPLAIN), "_probe": F.lit(False)}).unionByName(parked)
    probing = Compiler(both, _Without(compiler.events), compiler.graph, compiler.ordered, compiler.locate, compiler.zone)
    probing.fields = compiler.fields
    probing.notices = compiler.notices
    holds, notes = probing.tree(s.delay.get("condition"), True)
    _, key, _ = probing.hit(Strategy(s.name, action=s.action))
    later = probing.explained(notes if s.action.get("explain", True) else [])
    found = probing.df.where(f"_probe AND {holds}").selectExpr(f"{key} AS key", "ts", "seq", f"{later} AS _later", "_notes", *probing.place())
    values = "map_concat(map_filter(_notes, (k, v) -> NOT map_contains_key(_later, k)), _later) AS variable_values"
    return found.selectExpr("key", "ts", "seq", values, *PLACE)


class _Without(Registry):
    """Event types that a put-off row is none of."""

    def __init__(self, events: Registry):
        self.types = events.types

    def matches(self, column: Column, name: str) -> Column:
        return super().matches(column, name) & ~F.col("_probe")

    def matches_sql(self, name: str) -> str:
        return f"({super().matches_sql(name)} AND NOT _probe)"


class Steps:
    """How far the sequences of one key have come. Plain Python, shared by batch and stream."""

    def __init__(self, steps: int, within: int, most: int = MOST_PARTIAL):
        self.steps, self.within, self.most = steps, within, most
        #: [steps done, time of the first, times of all]
        self.partial: list[list] = []
        self.dropped = 0

    def event(self, ts: int, fits: list[bool]) -> list[int] | None:
        """The times of a completed sequence's steps, if this event completes one."""
        self.partial = [p for p in self.partial if ts - p[0][0] <= self.within]
        done = None
        for p in sorted(self.partial, key=lambda p: -len(p[0])):
            if ts > p[0][-1] and fits[len(p[0])]:
                p[0].append(ts)
                if len(p[0]) == self.steps:
                    self.partial.remove(p)
                    done = p[0]
                break
        if fits[0]:
            if self.steps == 1:
                return [ts]
            if len(self.partial) >= self.most:
                self.partial.pop(0)
                self.dropped += 1
            self.partial.append([[ts]])
        return done


def sequences(compiler: Compiler, s: Strategy) -> DataFrame:
    """(by, ts, seq, times): completed sequences of steps, each strictly later than the one before, all within a time."""
    q = s.sequence
    steps, within, by = q["steps"], int(q["within_seconds"]) * 1000, list(q["by"])
    fits = []
    for step in steps:
        holds, _ = compiler.tree(step.get("condition"))
        fits.append(f"({holds} AND {compiler.events.matches_sql(step['event'])})" if step.get("event") else holds)
    keys = [f"_{b}" for b in by]
    marked = compiler.df.select(*(F.coalesce(F.col(b).cast("string"), F.lit("")).alias(k) for k, b in zip(keys, by)), "ts", "seq", *(F.expr(f).alias(f"_s{i}") for i, f in enumerate(fits)))
    marked = marked.where(" or ".join(f"_s{i}" for i in range(len(steps))))
    schema = marked.select(*keys, "ts", "seq", F.array("ts").alias("times")).schema
    n, most = len(steps), int(q.get("max_partial_per_key", MOST_PARTIAL))

    def step(state: Steps, row: dict) -> list:
        done = state.event(row["ts"], [bool(row[f"_s{i}"]) for i in range(n)])
        return [(*(row[k] for k in keys), row["ts"], row["seq"], done)] if done else []

    out = _fold(marked, keys, lambda: Steps(n, within, most), step, schema)
    return out.select(*(F.col(k).alias(b) for k, b in zip(keys, by)), "ts", "seq", "times")


def notice_counts(df: DataFrame, emitted: DataFrame, kind: str, key: str, strategy: str, seconds: int, out: str) -> DataFrame:
    """df with the number of notices emitted for the row's key in the seconds before it, its own time excluded.

    Notices join the stream as rows of their own, and a frame that ends before the row counts them: no range join.
    """
    marks = emitted.where((F.col("check_type") == kind) & (F.col("strategy_name") == strategy)).select(F.col("key").alias("_k"), F.col("timestamp").alias("_t"))
    rows = df.withColumns({"_k": F.coalesce(F.col(key).cast("string"), F.lit("")), "_t": F.col("ts"), "_n": F.lit(0)})
    both = rows.unionByName(marks.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("_k").orderBy("_t").rangeBetween(-seconds * 1000, -1)
    counted = both.withColumn(out, F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("long"))
    return counted.where("_n = 0").drop("_k", "_t", "_n")


def run(df: DataFrame, strategies: list[Strategy], events: Registry, graph: Graph | None = None, ordered: bool = True, locate: Locator = unknown_location, zone: str = cel.ZONE) -> DataFrame:
    """The notices of all strategies that are online or on test. One that asks for another's notices comes after it."""
    compiler = Compiler(df, events, graph, ordered, locate, zone)
    live = [s for s in strategies if s.status in ("online", "test")]
    asked = {s.name: {c.args[2] for leaf in leaves(s.condition) if "cel" in leaf for c in cel.calls(cel.parse(leaf["cel"]), "checkNotice")} for s in live}
    out, done = [], {}
    while live:
        ready = [s for s in live if not asked[s.name] & {x.name for x in live}]
        if not ready:
            raise ValueError("strategies ask for each other's notices in a circle")
        for s in ready:
            for leaf in leaves(s.condition):
                for c in cel.calls(cel.parse(leaf["cel"]), "checkNotice") if "cel" in leaf else ():
                    key = cel.notice_key(c)
                    kind, _, _, seconds = key.split("|")
                    name = f"n:{len(compiler.notices)}"
                    if c.args[2] in done:
                        compiler.df = notice_counts(compiler.df, done[c.args[2]], kind, str(c.args[1]), c.args[2], int(seconds), name)
                        compiler.notices[key] = F.col(name_of(name))
                    else:
                        compiler.notices[key] = F.lit(0)
        plain = [s for s in ready if not s.delay and not s.sequence]
        # a later stratum counts a single strategy's notices, so only those that nobody asks for go together
        together = [s for s in plain if not any(s.name in names for names in asked.values())]
        if together:
            out.append(notices(compiler.all_hits(together), together))
        for s in ready:
            if s not in together:
                done[s.name] = notices(_hits(compiler, s).withColumn("strategy", F.lit(0)), [s])
                out.append(done[s.name])
            live.remove(s)
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def _hits(compiler: Compiler, s: Strategy) -> DataFrame:
    if s.delay:
        return absent(compiler, s)
    if not s.sequence:
        return compiler.hits(s)
    found, by = sequences(compiler, s), s.sequence["by"]
    key = s.action.get("check_value", by[0])
    notes = F.map_from_entries(F.transform("times", lambda t, i: F.struct(F.concat(F.lit("step "), (i + 1).cast("string")), F.struct(t.cast("string").alias("value"), F.lit("happened_at").alias("operator"), F.lit(str(s.sequence["within_seconds"])).alias("threshold")))))
    none = F.lit(None).cast("string")
    return found.select(F.col(key if key in found.columns else by[0]).cast("string").alias("key"), "ts", "seq", notes.cast(EXPLAIN).alias("variable_values"), *(none.alias(f) for f in ("geo_province", "geo_city", "uri_stem")))
