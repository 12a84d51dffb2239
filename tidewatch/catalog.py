"""Every registered query of the engine and its DuckDB oracle, on the supplied tables.

Events stand for a stream that arrives in event time; orders, whose days repeat and go back, for one that doesn't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import cel, conditions, masking, sketches
from tidewatch.operators import aggregates, rules, serving, windows
from tidewatch.operators.windows import DAY, HOUR, Period
from tidewatch.plans.events import EventType, Registry
from tidewatch.plans.variables import Graph, Variable
from tidewatch.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EVENTS = Registry([EventType("ANY"), *(EventType(n, "ANY") for n in ("signup", "error", "click", "view")), EventType("purchase", "click"), EventType("ORDER_SUBMIT")])
EV = "(SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts, event_type AS name, user_id AS uid, value AS amount, CAST(json_extract_string(props, '$.k') AS BIGINT) AS grp FROM events)"
OD = "(SELECT CAST(o_orderkey AS BIGINT) AS seq, epoch_us(o_orderdate) // 1000 AS ts, o_custkey AS uid, o_totalprice AS amount, o_orderstatus AS result FROM orders)"
KEY = b"tidewatch-example-key"


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def on_events(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(readers.events_table(spark, d))


def on_orders(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(readers.orders_table(spark, d))


def on(table: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(spark.read.parquet(f"{d}/{table}.parquet"))


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)


# Aggregates, one value a group ------------------------------------------------------------------------------------------

ROUNDED = {"sum", "max", "min", "avg", "variance", "stddev", "cv", "first", "last", "last_value", "global_latest"}
GROUPED_SQL = {
    "count": "COUNT(amount)", "sum": "COALESCE(SUM(amount), 0)", "max": "MAX(amount)", "min": "MIN(amount)", "avg": "AVG(amount)",
    "variance": "COALESCE(VAR_SAMP(amount), 0)", "stddev": "COALESCE(STDDEV_SAMP(amount), 0)",
    "cv": "CASE WHEN COUNT(amount) > 1 AND AVG(amount) <> 0 THEN STDDEV_SAMP(amount) / AVG(amount) END",
    "first": "ARG_MIN(amount, ts)", "last": "ARG_MAX(amount, ts)", "last_value": "ARG_MAX(amount, ts)",
}


def _grouped(op: str, v: str = "amount") -> Query:
    def query(e: DataFrame) -> DataFrame:
        value = aggregates.aggregate(op, F.col(v), F.col("ts"), F.col("seq"))
        return e.groupBy("uid").agg((r(value) if op in ROUNDED else value).alias("value"))

    return on_events(query)


for _op, _sql in GROUPED_SQL.items():
    _value = f"ROUND({_sql}, 6)" if _op in ROUNDED else _sql
    add(f"agg_{_op}_grouped", _grouped(_op), f"SELECT uid, {_value} AS value FROM {EV} GROUP BY uid")
add("agg_distinct_count_grouped", _grouped("distinct_count", "grp"), f"SELECT uid, COUNT(DISTINCT grp) AS value FROM {EV} GROUP BY uid")
add("agg_global_latest_grouped", on_events(lambda e: e.agg(r(aggregates.aggregate("global_latest", F.col("amount"), F.col("ts"), F.col("seq"))).alias("value"))), f"SELECT ROUND(ARG_MAX(amount, ts), 6) AS value FROM {EV}")
add(
    "agg_distinct_count_approx_grouped",
    on_events(lambda e: sketches.estimate(sketches.registers(e, ["uid"], F.col("grp").cast("string")), ["uid"], "value")),
    f"SELECT uid, COUNT(DISTINCT grp) AS value FROM {EV} GROUP BY uid",
)
add("agg_distinct_count_auto", on_events(lambda e: aggregates.distinct_auto(e, ["uid"], F.col("grp"))), f"SELECT uid, COUNT(DISTINCT grp) AS value, FALSE AS approximate, FALSE AS degraded FROM {EV} GROUP BY uid")


def _listed(op: str, n: int | None = None) -> Query:
    value = lambda: aggregates.aggregate(op, F.col("grp"), F.col("ts"), F.col("seq"), n=n)
    return on_events(lambda e: e.groupBy("uid").agg(F.array_join(value().cast("array<string>"), ",").alias("value")))


add("agg_lastn_grouped", _listed("lastn", 5), f"SELECT uid, ARRAY_TO_STRING(LIST_SLICE(LIST(grp ORDER BY ts DESC, seq DESC), 1, 5), ',') AS value FROM {EV} GROUP BY uid")
add("agg_collection_grouped", _listed("collection"), f"SELECT uid, STRING_AGG(CAST(grp AS VARCHAR), ',' ORDER BY seq) AS value FROM {EV} WHERE grp IS NOT NULL GROUP BY uid")
add("agg_distinct_grouped", _listed("distinct"), f"SELECT uid, STRING_AGG(CAST(grp AS VARCHAR), ',' ORDER BY s) AS value FROM (SELECT uid, grp, MIN(seq) AS s FROM {EV} GROUP BY uid, grp) GROUP BY uid")
add("agg_group_count_grouped", on_events(lambda e: aggregates.grouped_map(e, ["uid"], F.col("grp"), F.col("amount"))), f"SELECT uid, grp AS g, COUNT(amount) AS value FROM {EV} GROUP BY uid, grp")
add("agg_group_sum_grouped", on_events(lambda e: aggregates.grouped_map(e, ["uid"], F.col("grp"), F.col("amount"), "group_sum").withColumn("value", r(F.col("value")))), f"SELECT uid, grp AS g, ROUND(SUM(amount), 6) AS value FROM {EV} GROUP BY uid, grp")
add(
    "agg_top_grouped",
    on_events(lambda e: aggregates.grouped_top(e, ["uid"], F.col("grp"), F.col("amount"), 3, F.col("seq")).withColumn("value", r(F.col("value")))),
    f"SELECT uid, grp AS g, ROUND(value, 6) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT uid, grp, SUM(amount) AS value, ROW_NUMBER() OVER (PARTITION BY uid ORDER BY SUM(amount) DESC, grp) AS rank FROM {EV} GROUP BY uid, grp) WHERE rank <= 3",
)
for _op, _sql in (("merge", "ARG_MAX(amount, ts)"), ("merge_value", "SUM(amount)")):
    add(
        f"agg_{_op}_grouped",
        on_events(lambda e, op=_op: aggregates.merged_maps(e, ["uid"], F.create_map("name", "amount"), F.col("ts"), F.col("seq"), op).withColumn("value", r(F.col("value")))),
        f"SELECT uid, name AS key, ROUND({_sql}, 6) AS value FROM {EV} GROUP BY uid, name",
    )

# Windows: one value an event -------------------------------------------------------------------------------------------

SLIDING = "PARTITION BY uid ORDER BY ts RANGE BETWEEN {size} PRECEDING AND CURRENT ROW"
WINDOW_SQL = {op: GROUPED_SQL[op].replace("ARG_MIN(amount, ts)", "FIRST_VALUE(amount)").replace("ARG_MAX(amount, ts)", "LAST_VALUE(amount)") for op in GROUPED_SQL if op != "last_value"} | {"distinct_count": "COUNT(DISTINCT grp)"}


def over(sql: str, window: str) -> str:
    """The aggregates of an expression, each over a window."""
    import re

    return re.sub(r"\b((?:COUNT|SUM|MAX|MIN|AVG|VAR_SAMP|STDDEV_SAMP|FIRST_VALUE|LAST_VALUE)\([^()]*\))", rf"\1 OVER ({window})", sql)


def _running(op: str, period: Period, keys: tuple[str, ...] = ("uid",), v: str = "amount") -> Query:
    def query(e: DataFrame) -> DataFrame:
        x = windows.running(e, "value", op, period, list(keys), F.col("grp" if op == "distinct_count" else v))
        return x.select("seq", (r(F.col("value"), 8) if op in ROUNDED else F.col("value")).alias("value"))

    return on_events(query)


def _window(name: str, op: str, period: Period, sql_window: str, source: str = EV) -> None:
    sql = over(WINDOW_SQL[op], sql_window)
    add(name, _running(op, period), f"SELECT seq, {f'ROUND({sql}, 8)' if op in ROUNDED else sql} AS value FROM {source}")


for _op in WINDOW_SQL:
    _window(f"win_sliding_{_op}", _op, Period("last_n_hours", 72), SLIDING.format(size=72 * HOUR - 1))
for _op in ("count", "sum", "max", "avg", "distinct_count"):
    _window(f"win_tumbling_hourly_{_op}", _op, Period("hourly", 48), f"PARTITION BY uid, ts // {48 * HOUR} ORDER BY seq ROWS UNBOUNDED PRECEDING")
_window("win_daily_today", "count", Period("today"), f"PARTITION BY uid, ts // {DAY} ORDER BY seq ROWS UNBOUNDED PRECEDING")
_window("win_today_zone", "count", Period("today", zone="Asia/Shanghai"), f"PARTITION BY uid, (ts + {8 * HOUR}) // {DAY} ORDER BY seq ROWS UNBOUNDED PRECEDING")
_window("win_ever", "sum", Period("ever"), "PARTITION BY uid ORDER BY seq ROWS UNBOUNDED PRECEDING")
_window("win_self", "count", Period("self"), "PARTITION BY uid ORDER BY seq ROWS BETWEEN CURRENT ROW AND CURRENT ROW")
add(
    "win_sliding_lastn",
    on_events(lambda e: windows.running(e, "value", "lastn", Period("last_n_days", 7), ["uid"], F.col("grp"), n=3).select("seq", F.array_join(F.col("value").cast("array<string>"), ",").alias("value"))),
    f"SELECT seq, ARRAY_TO_STRING(LIST_SLICE(LIST_REVERSE(LIST(grp) OVER ({SLIDING.format(size=7 * DAY - 1)})), 1, 3), ',') AS value FROM {EV}",
)
add(
    "win_sliding_group_count",
    on_events(lambda e: windows.running(e, "m", "group_count", Period("last_n_days", 10), ["uid"], F.lit(1), F.col("name")).select("seq", F.explode("m").alias("g", "value")).select("seq", "g", F.col("value").cast("long").alias("value"))),
    f"SELECT a.seq, b.name AS g, COUNT(*) AS value FROM {EV} a JOIN {EV} b ON a.uid = b.uid AND b.ts <= a.ts AND b.ts > a.ts - {10 * DAY} GROUP BY a.seq, b.name",
)
add(
    "win_two_keys",
    _running("count", Period("last_n_days", 10), ("uid", "name")),
    f"SELECT seq, COUNT(amount) OVER (PARTITION BY uid, name ORDER BY ts RANGE BETWEEN {10 * DAY - 1} PRECEDING AND CURRENT ROW) AS value FROM {EV}",
)

LATE = 400 * DAY
ARRIVED = f"(SELECT *, MAX(ts) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS wm FROM {OD})"
for _op, _sql in (("count", "COUNT(b.amount)"), ("sum", "ROUND(COALESCE(SUM(b.amount), 0), 2)"), ("max", "ROUND(MAX(b.amount), 2)"), ("distinct_count", "COUNT(DISTINCT b.result)")):

    def _arrival(o: DataFrame, op: str = _op) -> DataFrame:
        x = windows.running(o, "value", op, Period("last_n_days", 365), ["uid"], F.col("result" if op == "distinct_count" else "amount"), ordered=False, lateness=LATE)
        return x.select("seq", (r(F.col("value"), 2) if op in ROUNDED else F.col("value")).alias("value"))

    add(
        f"win_arrival_{_op}",
        on_orders(_arrival),
        f"SELECT a.seq, {_sql} AS value FROM {OD} a LEFT JOIN {ARRIVED} b ON a.uid = b.uid AND b.seq <= a.seq AND b.ts > a.ts - {365 * DAY} AND b.ts <= a.ts + {LATE} AND b.ts >= b.wm - {LATE} GROUP BY a.seq",
    )
add("watermark", on_orders(lambda o: windows.watermark(o).select("seq", "watermark")), f"SELECT seq, wm AS watermark FROM {ARRIVED}")
_late = f"CASE WHEN ts < wm - {LATE} THEN 'LATE_DROPPED' WHEN ts < wm THEN 'LATE_ACCEPTED' ELSE 'ACCEPTED' END"
add("late_classification", on_orders(lambda o: windows.classify(o, LATE).select("seq", "late")), f"SELECT seq, {_late} AS late FROM {ARRIVED}")
add("late_side_output", on_orders(lambda o: windows.split_late(o, LATE)[1].select("seq", "ts")), f"SELECT seq, ts FROM {ARRIVED} WHERE ts < wm - {LATE}")

# Conditions ------------------------------------------------------------------------------------------------------------

PART = "(SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN '' ELSE p_type END AS kind, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS size, p_name FROM part)"


def part(p: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return p.select(k, F.when(k % 7 == 0, None).when(k % 11 == 0, "").otherwise(F.col("p_type")).alias("kind"), F.when(k % 5 != 0, F.col("p_size")).alias("size"), "p_name")


def located(ip: Column, level: str) -> Column:
    return F.when(ip.endswith("L"), F.lit("north")).when(ip.endswith("R"), F.lit("south"))


_place = "CASE WHEN kind LIKE '%L' THEN 'north' WHEN kind LIKE '%R' THEN 'south' ELSE 'unknown' END"
_word = "kind = (SELECT MIN(p_type) FROM part)"
CONDITIONS = {
    "eq": ("==", "size", " 10 ", "size = 10"), "gt": (">", "size", "25", "size > 25"), "ge": (">=", "size", "25", "size >= 25"), "lt": ("<", "size", "9", "size < 9"), "le": ("<=", "size", "9.5", "size <= 9.5"),
    "empty": ("empty", "kind", None, "kind IS NULL OR kind = ''"), "contains": ("contains", "kind", "E", "kind LIKE '%E%'"), "startwith": ("startwith", "kind", "S", "kind LIKE 'S%'"),
    "endwith": ("endwith", "kind", "L", "kind LIKE '%L'"), "regex": ("regex", "kind", "[A-M].*", "regexp_full_match(kind, '[A-M].*')"), "containsby": ("containsby", "kind", "STANDARD,SMALL,ECONOMY STEEL", "contains('STANDARD,SMALL,ECONOMY STEEL', kind)"),
    "in": ("in", "size", "1, 2 ,3,40", "size IN (1, 2, 3, 40)"), "locationequals": ("locationequals", "kind", "north", f"{_place} = 'north'"), "locationcontainsby": ("locationcontainsby", "kind", "south, unknown", f"{_place} IN ('south', 'unknown')"),
}
for _name, (_op, _field, _constant, _sql) in CONDITIONS.items():
    for _not in (False, True)[: 1 if _op in (">", ">=", "<", "<=") else 2]:
        _operator = _op if not _not else "!=" if _op == "==" else f"!{_op}"
        add(
            f"cond_{'not_' * _not}{_name}",
            on("part", lambda p, op=_operator, f=_field, c=_constant: (x := part(p)).where(conditions.compare(op, f, conditions.type_of(x, f), c, located)).select("p_partkey")),
            f"SELECT p_partkey FROM {PART} WHERE {'NOT ' * _not}COALESCE({_sql}, FALSE)",
        )
add("cond_number_as_text", on("part", lambda p: (x := part(p)).where(conditions.compare(">", "kind", conditions.type_of(x, "kind"), "5")).select("p_partkey")), f"SELECT p_partkey FROM {PART} WHERE FALSE")
TREE = {
    "type": "or",
    "condition": [
        {"type": "and", "condition": [{"object": "size", "operation": ">=", "value": "10"}, {"object": "kind", "operation": "!contains", "value": "E"}]},
        {"type": "not", "condition": [{"object": "size", "operation": "!=", "value": "7"}]},
        {"object": "missing", "operation": "==", "value": "x"},
    ],
}
add("filter_tree_nested", on("part", lambda p: (x := part(p)).where(conditions.filter_tree(x, TREE)).select("p_partkey")), f"SELECT p_partkey FROM {PART} WHERE COALESCE(size >= 10, FALSE) AND NOT COALESCE(kind LIKE '%E%', FALSE) OR COALESCE(size = 7, FALSE)")
add("event_inheritance_match", on_events(lambda e: e.where(EVENTS.matches(F.col("name"), "click")).groupBy("name").agg(F.count("*").alias("n"))), f"SELECT name, COUNT(*) AS n FROM {EV} WHERE name IN ('click', 'purchase') GROUP BY name")

# The variable graph ----------------------------------------------------------------------------------------------------

_day = Period("last_n_days", 10)
ERROR = {"object": "name", "operation": "==", "value": "error"}
VARIABLES = [
    Variable("CLICKS", "filter", ("ANY",), filter={"object": "name", "operation": "in", "value": "click,purchase"}),
    Variable("all_10d", "aggregate", ("ANY",), "count", keys=("uid",), period=_day),
    Variable("errors_10d", "aggregate", ("ANY",), "count", keys=("uid",), period=_day, filter=ERROR),
    Variable("spent", "aggregate", ("ANY",), "sum", "amount", keys=("uid",)),
    Variable("groups_10d", "aggregate", ("ANY",), "group_sum", "amount", "grp", ("uid",), _day),
    Variable("click_gap", "sequence", ("CLICKS",), "-", "timestamp", keys=("uid",)),
    Variable("mean_gap", "aggregate", ("click_gap",), "avg", "value", keys=("uid",), period=_day),
    Variable("top_groups", "top", ("groups_10d",), "top", "value", "3", ("uid",)),
    *(Variable(f"dual_{n}", "dual", ("errors_10d", "all_10d"), op, "value", keys=("uid",)) for n, op in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/"))),
]


def variable(name: str, value: Callable[[Column], Column] = lambda c: r(c, 6)) -> Query:
    return on_events(lambda e: Graph(VARIABLES, EVENTS).compile(e, [name]).where(F.col(name).isNotNull()).select("seq", value(F.col(name)).alias("value")))


_w10 = SLIDING.format(size=10 * DAY - 1)
_errors, _all = f"COUNT(CASE WHEN name = 'error' THEN 1 END) OVER ({_w10})", f"COUNT(*) OVER ({_w10})"
_dual = f"(SELECT seq, uid, name, e, a, LAST_VALUE(CASE WHEN name = 'error' THEN e END IGNORE NULLS) OVER (PARTITION BY uid ORDER BY seq ROWS UNBOUNDED PRECEDING) AS el FROM (SELECT *, {_errors} AS e, {_all} AS a FROM {EV}))"
add("node_event", variable("all_10d", lambda c: c), f"SELECT seq, {_all} AS value FROM {EV}")
add("node_filter_aggregate", variable("errors_10d", lambda c: c), f"SELECT seq, value FROM (SELECT seq, name, {_errors} AS value FROM {EV}) WHERE name = 'error'")
for _n, _op in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/")):
    add(f"node_dual_{_n}", variable(f"dual_{_n}"), f"SELECT seq, ROUND(CAST(el AS DOUBLE) {_op} a, 6) AS value FROM {_dual} WHERE el IS NOT NULL AND a IS NOT NULL")
_gap = f"(SELECT seq, uid, ts, ts - LAG(ts) OVER (PARTITION BY uid ORDER BY seq) AS gap FROM {EV} WHERE name IN ('click', 'purchase'))"
add("node_sequence_diff", variable("click_gap", lambda c: c), f"SELECT seq, CAST(gap AS DOUBLE) AS value FROM {_gap} WHERE gap IS NOT NULL")
add("node_sequence_mean", variable("mean_gap", lambda c: r(c, 2)), f"SELECT seq, ROUND(AVG(gap) OVER ({_w10}), 2) AS value FROM {_gap} WHERE gap IS NOT NULL")
add(
    "node_top",
    on_events(lambda e: Graph(VARIABLES, EVENTS).compile(e, ["top_groups"]).select("seq", F.posexplode("top_groups").alias("pos", "t")).select("seq", "pos", "t.key", r(F.col("t.value")).alias("value"))),
    f"SELECT seq, CAST(pos - 1 AS INTEGER) AS pos, key, ROUND(value, 6) AS value FROM (SELECT a.seq, CAST(b.grp AS VARCHAR) AS key, SUM(b.amount) AS value, ROW_NUMBER() OVER (PARTITION BY a.seq ORDER BY SUM(b.amount) DESC, CAST(b.grp AS VARCHAR)) AS pos FROM {EV} a JOIN {EV} b ON a.uid = b.uid AND b.ts <= a.ts AND b.ts > a.ts - {10 * DAY} GROUP BY a.seq, b.grp) WHERE pos <= 3",
)
add(
    "node_probe_empty",
    lambda spark, d: Graph(VARIABLES, EVENTS).probe(readers.events_table(spark, d), "spent", spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("uid"))).withColumn("spent", r(F.col("spent"))),
    f"SELECT c_custkey AS uid, ROUND(COALESCE(s, 0), 6) AS spent FROM customer LEFT JOIN (SELECT uid, SUM(amount) AS s FROM {EV} GROUP BY uid) e ON uid = c_custkey",
)

# Rules -----------------------------------------------------------------------------------------------------------------

ERRORS_3D = {"kind": "counter", "counter": {"event": "error", "window": 259_200, "algorithm": "count", "operand": [], "groupby": ["uid"]}}
BURST_TREE = {"op": "and", "conditions": [{"left": {"kind": "event_field", "field": "amount"}, "op": ">", "right": {"kind": "constant", "value": "5"}}, {"left": ERRORS_3D, "op": ">", "right": {"kind": "constant", "value": "1"}}]}
ACTION = {"check_type": "USER", "check_value": "uid", "scene": "ACCOUNT", "decision": "review", "score": 60, "ttl": 3600, "dedup_window": 0, "tags": ["errors"]}
BURST = rules.Strategy("error_burst", BURST_TREE, "error", action=ACTION)
DEDUPED = rules.Strategy("error_burst", BURST_TREE, "error", action=ACTION | {"dedup_window": 172_800})
_hits = f"(SELECT * FROM (SELECT *, COUNT(CASE WHEN name = 'error' THEN 1 END) OVER ({SLIDING.format(size=3 * DAY - 1)}) AS n FROM {EV}) WHERE name = 'error' AND amount > 5 AND n > 1)"
_kept = f"WITH RECURSIVE h AS (SELECT uid, ts FROM {_hits}), d AS (SELECT uid, MIN(ts) AS ts FROM h GROUP BY uid UNION ALL SELECT d.uid, MIN(h.ts) FROM d JOIN h ON h.uid = d.uid AND h.ts >= d.ts + {2 * DAY} GROUP BY d.uid)"


def burst(e: DataFrame, s: rules.Strategy = BURST) -> DataFrame:
    return rules.run(e, [s], EVENTS)


def explained(n: DataFrame) -> DataFrame:
    return n.select("timestamp", "key", F.explode("variable_values").alias("subject", "v")).select("timestamp", "key", "subject", r(F.col("v.value")).alias("value"), "v.operator", "v.threshold")


add(
    "rule_counter_threshold",
    on_events(lambda e: burst(e, DEDUPED).select("timestamp", "key", "check_type", "strategy_name", "scene_name", "decision", "risk_score", "expire", "test")),
    f"{_kept} SELECT ts AS timestamp, CAST(uid AS VARCHAR) AS key, 'USER' AS check_type, 'error_burst' AS strategy_name, 'ACCOUNT' AS scene_name, 'review' AS decision, 60 AS risk_score, ts + 3600000 AS expire, FALSE AS test FROM d",
)
add("rule_hits", on_events(lambda e: burst(e).select("timestamp", "key")), f"SELECT ts AS timestamp, CAST(uid AS VARCHAR) AS key FROM {_hits}")
add("rule_dedup", on_events(lambda e: rules.deduplicated(e.where("name = 'view'"), ["uid"], 2 * DAY).select("uid", "ts")), _kept.replace(_hits, f"{EV} WHERE name = 'view'") + " SELECT uid, ts FROM d")
add("rule_dedup_sql", on_events(lambda e: rules.deduplicated_sql(e.where("name = 'view'"), ["uid"], 2 * DAY)), ORACLES["rule_dedup"])
add(
    "rule_explain",
    on_events(lambda e: explained(burst(e))),
    f"SELECT ts AS timestamp, CAST(uid AS VARCHAR) AS key, 'amount' AS subject, ROUND(amount, 6) AS value, '>' AS operator, '5' AS threshold FROM {_hits} UNION ALL SELECT ts, CAST(uid AS VARCHAR), 'count(*) by uid in 259200s', n, '>', '1' FROM {_hits}",
)
_two = {"left": {"kind": "variable", "name": "dual_div"}, "op": ">=", "right": {"kind": "constant", "value": "0.5"}}
add(
    "rule_variable",
    on_events(lambda e: rules.run(e, [rules.Strategy("ratio", _two, "error", "test", ACTION)], EVENTS, Graph(VARIABLES, EVENTS)).select("timestamp", "key", "test")),
    f"SELECT ts AS timestamp, CAST(uid AS VARCHAR) AS key, TRUE AS test FROM (SELECT s.*, e.ts FROM {_dual} s JOIN {EV} e USING (seq)) WHERE name = 'error' AND CAST(el AS DOUBLE) / a >= 0.5",
)
_operands = {
    "op": "and",
    "conditions": [
        {"left": {"kind": "event_field", "field": "amount"}, "op": ">", "right": ERRORS_3D},
        {"left": {"kind": "variable", "variable": "dual_div", "keys": ["uid"]}, "op": "!=", "right": {"kind": "event_field", "field": "amount"}},
        {"left": {"kind": "event_field", "field": "name"}, "op": "!contains", "right": {"kind": "event_field", "field": "grp"}},
    ],
}
_operand_rows = f"(SELECT *, COUNT(CASE WHEN name = 'error' THEN 1 END) OVER ({SLIDING.format(size=3 * DAY - 1)}) AS n FROM {EV})"
add(
    "rule_operands",
    on_events(lambda e: rules.run(e, [rules.Strategy("operands", _operands, "error", action=ACTION)], EVENTS, Graph(VARIABLES, EVENTS)).select("timestamp", "key", F.size("variable_values").alias("entries"))),
    f"SELECT e.ts AS timestamp, CAST(e.uid AS VARCHAR) AS key, 3 AS entries FROM (SELECT seq, el, a FROM {_dual}) s JOIN {_operand_rows} e USING (seq) WHERE e.name = 'error' AND e.amount > e.n"
    " AND NOT COALESCE(CAST(el AS DOUBLE) / a = e.amount, FALSE) AND NOT COALESCE(contains(e.name, CAST(e.grp AS VARCHAR)), FALSE)",
)
DELAYED = rules.Strategy(
    "no_purchase", None, "view", action=ACTION,
    delay={"seconds": 432_000, "condition": {"left": {"kind": "counter", "counter": {"event": "purchase", "window": 432_000, "algorithm": "count", "operand": [], "groupby": ["uid"]}}, "op": "==", "right": {"kind": "constant", "value": "0"}}},
)
add(
    "rule_delay_absence",
    on_events(lambda e: burst(e, DELAYED).select("timestamp", "key")),
    f"SELECT a.ts + {5 * DAY} AS timestamp, CAST(a.uid AS VARCHAR) AS key FROM {EV} a WHERE a.name = 'view' AND a.ts + {5 * DAY} <= (SELECT MAX(ts) FROM {EV}) AND NOT EXISTS (SELECT 1 FROM {EV} b WHERE b.uid = a.uid AND b.name = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + {5 * DAY})",
)
PUT_OFF = rules.Strategy("late", {"left": {"kind": "event_field", "field": "amount"}, "op": ">", "right": {"kind": "constant", "value": "5"}}, "view", action=ACTION, delay=DELAYED.delay)
_late = ORACLES["rule_delay_absence"].replace("SELECT a.ts", "SELECT a.amount, a.ts", 1) + " AND a.amount > 5"
add(
    "rule_delay_explain",
    on_events(lambda e: explained(burst(e, PUT_OFF))),
    f"SELECT timestamp, key, 'amount' AS subject, ROUND(amount, 6) AS value, '>' AS operator, '5' AS threshold FROM ({_late}) UNION ALL SELECT timestamp, key, 'count(*) by uid in 432000s', 0, '==', '0' FROM ({_late})",
)
STEPS = rules.Strategy("funnel", action=ACTION, sequence={"steps": [{"event": "view"}, {"event": "error"}, {"event": "purchase"}], "within_seconds": 864_000, "by": ["uid"]})
# A state for each event: the open sequences in the order they began, with the steps done (k) and the first and newest times.
# An event goes to the one that has come farthest; as each name fits one step, that is the oldest that waits for it.
_sequence_sql = f"""WITH RECURSIVE e AS (
  SELECT uid, ts, name, ROW_NUMBER() OVER (PARTITION BY uid ORDER BY seq) AS n FROM {EV} WHERE name IN ('view', 'error', 'purchase')
), s AS (
  SELECT DISTINCT uid, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS ts, CAST([] AS STRUCT(c BIGINT, k BIGINT, a BIGINT, b BIGINT)[]) AS p, false AS done FROM e
  UNION ALL
  SELECT uid, n, ts,
    CASE
      WHEN name = 'view' THEN list_append(CASE WHEN len(q) >= {rules.MOST_PARTIAL} THEN q[2:] ELSE q END, {{'c': n, 'k': 1, 'a': ts, 'b': ts}})
      WHEN hit IS NULL THEN q
      WHEN name = 'error' THEN list_transform(q, lambda x: CASE WHEN x.c = hit THEN {{'c': x.c, 'k': 2, 'a': x.a, 'b': ts}} ELSE x END)
      ELSE list_filter(q, lambda x: x.c <> hit)
    END,
    name = 'purchase' AND hit IS NOT NULL
  FROM (
    SELECT *, list_filter(q, lambda x: x.k = CASE name WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AND ts > x.b)[1].c AS hit
    FROM (SELECT e.*, list_filter(s.p, lambda x: e.ts - x.a <= 864000000) AS q FROM s JOIN e ON e.uid = s.uid AND e.n = s.n + 1)
  )
) SELECT ts AS timestamp, CAST(uid AS VARCHAR) AS key, 3 AS steps FROM s WHERE done"""
add("rule_sequence_3step", on_events(lambda e: burst(e, STEPS).select("timestamp", "key", F.size("variable_values").alias("steps"))), _sequence_sql)


def cascade(e: DataFrame) -> DataFrame:
    probe = rules.Strategy("again", {"cel": 'checkNotice("uid", uid, "error_burst", 432000) > 1'}, "click", action=ACTION | {"decision": "reject"})
    return rules.run(e, [probe, BURST], EVENTS).where("strategy_name = 'again'").select("timestamp", "key", "decision")


add("rule_checknotice", on_events(cascade), f"SELECT a.ts AS timestamp, CAST(a.uid AS VARCHAR) AS key, 'reject' AS decision FROM {EV} a JOIN {_hits} h ON h.uid = a.uid AND h.ts >= a.ts - {5 * DAY} AND h.ts < a.ts WHERE a.name IN ('click', 'purchase') GROUP BY a.ts, a.uid HAVING COUNT(*) > 1")
_shanghai = f"((ts + {8 * HOUR}) % {DAY}) // 60000"
for _name, _a, _b, _sql in (("cel_in_time_window", "09:30", "17:00", f"{_shanghai} >= 570 AND {_shanghai} < 1020"), ("cel_night_window", "22:00", "06:00", f"{_shanghai} >= 1320 OR {_shanghai} < 360")):
    add(_name, on_events(lambda e, a=_a, b=_b: e.where(cel.compile_cel(e, f'inTimeWindow("{a}", "{b}")')).select("seq")), f"SELECT seq FROM {EV} WHERE {_sql}")
add("cel_compare", on_events(lambda e: e.where(cel.compile_cel(e, '!(name in ["click", "view"])') & cel.compile_cel(e, "amount >= 250.5") & cel.compile_cel(e, 'name != "error"')).select("seq")), f"SELECT seq FROM {EV} WHERE name NOT IN ('click', 'view', 'error') AND amount >= 250.5")
add("cel_location", on("part", lambda p: (x := part(p)).where(cel.compile_cel(x, 'ipLocation(kind, "province") == "unknown"', locate=located)).select("p_partkey")), f"SELECT p_partkey FROM {PART} WHERE {_place} = 'unknown'")

# Privacy ---------------------------------------------------------------------------------------------------------------

_pad = lambda b: "'" + "".join(f"\\x{c ^ b:02X}" for c in KEY.ljust(64, b"\0")) + "'::BLOB"
_hmac = f"sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode(c_name))))"
MASKS = {
    "drop": (lambda: masking.drop(F.col("c_name")), "CASE WHEN c_name <> '' THEN '<REDACTED>' ELSE c_name END"),
    "partial": (lambda: masking.partial(F.col("c_name")), "CASE WHEN length(c_name) > 7 THEN left(c_name, 3) || repeat('*', length(c_name) - 7) || right(c_name, 4) ELSE repeat('*', length(c_name)) END"),
    "regex": (lambda: masking.pattern(F.concat(F.lit("token="), F.col("c_name"), F.lit("&x=1&PWD=2"))), "'token=<REDACTED>&x=1&PWD=<REDACTED>'"),
    "display": (lambda: masking.display(F.col("c_name")), "left(c_name, 3) || repeat('*', length(c_name) - 6) || right(c_name, 3)"),
    "hash": (lambda: masking.hashed(F.col("c_name"), KEY), f"'h:' || left({_hmac}, 32)"),
}
for _m, (_column, _sql) in MASKS.items():
    add(f"mask_{_m}", on("customer", lambda c, f=_column: c.select("c_custkey", f().alias("masked"))), f"SELECT c_custkey, {_sql} AS masked FROM customer")
add("hmac_at_rest", on("customer", lambda c: masking.at_rest(c.select("c_custkey", F.col("c_name").alias("uid")), KEY)), f"SELECT c_custkey, {_hmac} AS uid FROM customer")

# Serving ---------------------------------------------------------------------------------------------------------------

START = 1_704_067_200_000  # 2024-01-01
_notice = f"(SELECT ts AS timestamp, CAST(uid AS VARCHAR) AS key, 'USER' AS check_type, 'error_burst' AS strategy_name, 'ACCOUNT' AS scene_name, 'review' AS decision, 60 AS risk_score, ts + 3600000 AS expire, FALSE AS test FROM {_hits})"
_page = f"SELECT timestamp, key, decision FROM {_notice} WHERE timestamp >= {START} AND timestamp < {START + 20 * DAY} ORDER BY timestamp DESC, strategy_name, key LIMIT 50 OFFSET 50"
add("alerts_page", on_events(lambda e: serving.alerts(burst(e), START, START + 20 * DAY, page=1, scene="ACCOUNT").select("timestamp", "key", "decision")), _page)
add("alerts_count", on_events(lambda e: serving.alert_count(burst(e), START, START + 20 * DAY, decision="review")), f"SELECT COUNT(*) AS total FROM {_notice} WHERE timestamp >= {START} AND timestamp < {START + 20 * DAY}")
add(
    "alerts_trend",
    on_events(lambda e: serving.trend(serving.notices_hourly(burst(e)), START, START + 365 * DAY)),
    f"SELECT timestamp - timestamp % {HOUR} AS hour, scene_name, strategy_name, decision, COUNT(*) AS cnt, COUNT(DISTINCT key) AS subjects FROM {_notice} GROUP BY ALL",
)
add("rollup_hourly", on_events(lambda e: serving.rollup_counts(serving.events_hourly(e))), f"SELECT ts - ts % {HOUR} AS hour, name, COUNT(*) AS cnt, COUNT(DISTINCT uid) AS uid FROM {EV} GROUP BY 1, 2")
add(
    "rollup_incremental",
    # every event is in one load, whatever its number, also without one
    on_events(lambda e: serving.rollup_counts(serving.merged_rollup(serving.events_hourly(e.where("seq % 2 <=> 0")).unionByName(serving.events_hourly(e.where("NOT seq % 2 <=> 0"))), ["hour", "name"]))),
    ORACLES["rollup_hourly"],
)


def risk(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.read.parquet(f"{d}/customer.parquet").select(F.lit("USER").alias("check_type"), F.col("c_custkey").cast("string").alias("key"))
    return serving.check_risk(asked, burst(readers.events_table(spark, d)), START + 15 * DAY, "account")


add(
    "check_risk_decision",
    risk,
    f"SELECT 'USER' AS check_type, CAST(c_custkey AS VARCHAR) AS key, CASE WHEN n IS NULL THEN 'accept' ELSE 'review' END AS decision, CASE WHEN n IS NOT NULL THEN 'error_burst' END AS strategy_name FROM customer LEFT JOIN (SELECT key AS k, COUNT(*) AS n FROM {_notice} WHERE expire > {START + 15 * DAY} GROUP BY key) ON k = CAST(c_custkey AS VARCHAR)",
)
add("risk_list_expiry", on_events(lambda e: serving.list_level_expiry(burst(e)).select("key", "timestamp", "expire")), f"SELECT key, timestamp, MAX(expire) OVER (PARTITION BY key) AS expire FROM {_notice}")
add("subject_export", on_events(lambda e: serving.export(e, "uid", "7").select("seq", "ts", "name")), f"SELECT seq, ts, name FROM {EV} WHERE uid = 7")
add("subject_erase", on_events(lambda e: serving.erased(e, "uid", "7").groupBy("uid").agg(F.count("*").alias("n"))), f"SELECT uid, COUNT(*) AS n FROM {EV} WHERE uid <> 7 GROUP BY uid")
add("retention_filter", on_events(lambda e: serving.retained(e, "events", START + 45 * DAY).groupBy("name").agg(F.count("*").alias("n"))), f"SELECT name, COUNT(*) AS n FROM {EV} WHERE ts >= {START + 15 * DAY} GROUP BY name")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rule_counter_threshold"](spark, sf_dir)
