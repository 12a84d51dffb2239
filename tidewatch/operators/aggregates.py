"""The 22 aggregation operators, each as an aggregate over rows and as a function of an array of items.

The first form serves groupBy and plain window frames; the second serves frames whose rows must be picked by arrival.
All skip null operands. An item is struct<ts, seq, v, g>: event time, arrival, operand and group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPERATORS = (
    "count sum max min avg variance stddev cv distinct_count distinct_count_approx first last last_value global_latest lastn distinct collection"
    " group_count group_sum merge merge_value top"
).split()
#: Values beyond which distinct_count may be replaced by its sketch.
APPROX_THRESHOLD = 100_000
LASTN, TOPN = 10, 100
Over = Callable[[Column], Column]


def check(op: str) -> str:
    op = {"topn": "top"}.get(op, op)
    if op not in OPERATORS:
        raise ValueError(f"unknown aggregation {op!r}")
    return op


def _order(ts: Column, seq: Column, v: Column) -> Column:
    return F.when(v.isNotNull(), F.struct(ts, seq))


def aggregate(op: str, v: Column, ts: Column, seq: Column, g: Column | None = None, n: int | None = None, over: Over | None = None) -> Column:
    """One value a group, or with over = lambda c: c.over(window) one a row."""
    op, windowed = check(op), over is not None
    o: Over = over or (lambda c: c)
    x = v.cast("double")
    if op == "count":
        return o(F.count(v))
    if op == "sum":
        return F.coalesce(o(F.sum(x)), F.lit(0.0))
    if op in ("max", "min", "avg"):
        return o(getattr(F, op)(x))
    if op in ("variance", "stddev"):
        return F.coalesce(o((F.var_samp if op == "variance" else F.stddev_samp)(x)), F.lit(0.0))
    if op == "cv":
        mean = o(F.avg(x))
        return F.when((o(F.count(x)) > 1) & (mean != 0), o(F.stddev_samp(x)) / mean)
    if op == "distinct_count":
        return F.size(o(F.collect_set(v.cast("string")))).cast("long") if windowed else F.count_distinct(v.cast("string"))
    if op == "distinct_count_approx":
        return o(F.approx_count_distinct(v.cast("string"), 0.01))
    if op == "first":
        return o(F.min_by(v, _order(ts, seq, v)))  # a row whose order is null is skipped
    if op in ("last", "last_value", "global_latest"):
        return o(F.max_by(v, _order(ts, seq, v)))
    item = F.struct(ts.alias("ts"), seq.alias("seq"), v.alias("v"), *([g.alias("g")] if g is not None else []))
    kept = v.isNotNull() if op != "group_count" or g is None else v.isNotNull() & g.isNotNull()
    return from_items(op, o(F.collect_list(F.when(kept, item))), n)


def from_items(op: str, items: Column, n: int | None = None) -> Column:
    """The operator's value of an array of items whose operands aren't null."""
    op = check(op)
    values = F.transform(items, lambda s: s["v"])
    numbers = F.transform(items, lambda s: s["v"].cast("double"))
    size = F.size(items)
    total = F.aggregate(numbers, F.lit(0.0), lambda a, b: a + b)
    if op == "count":
        return size.cast("long")
    if op == "sum":
        return total
    if op in ("max", "min"):
        return (F.array_max if op == "max" else F.array_min)(numbers)
    if op == "avg":
        return F.when(size > 0, total / size)
    if op in ("variance", "stddev", "cv"):
        mean = total / F.nullif(size, F.lit(0))
        square = F.aggregate(numbers, F.struct(F.lit(0.0).alias("s"), mean.alias("m")), lambda a, b: F.struct((a["s"] + (b - a["m"]) * (b - a["m"])).alias("s"), a["m"].alias("m")), lambda a: a["s"])
        variance = F.when(size > 1, square / F.nullif(size - 1, F.lit(0)))
        if op == "cv":
            return F.when((size > 1) & (mean != 0), F.sqrt(variance) / F.nullif(mean, F.lit(0.0)))
        return F.coalesce(variance if op == "variance" else F.sqrt(variance), F.lit(0.0))
    if op in ("distinct_count", "distinct_count_approx"):
        return F.size(F.array_distinct(F.transform(values, lambda v: v.cast("string")))).cast("long")
    by_time = F.array_sort(items)
    if op == "first":
        return F.get(F.transform(by_time, lambda s: s["v"]), F.lit(0))
    if op in ("last", "last_value", "global_latest"):
        return F.get(F.transform(by_time, lambda s: s["v"]), size - 1)
    if op == "lastn":
        return F.slice(F.reverse(F.transform(by_time, lambda s: s["v"])), 1, n or LASTN)
    if op in ("distinct", "collection"):
        arrived = F.transform(F.array_sort(F.transform(items, lambda s: F.struct(s["seq"], s["v"]))), lambda s: s["v"])
        return F.array_distinct(arrived) if op == "distinct" else arrived
    if op == "merge":
        # later entries come last, and the last of a key stays; maps have no order, so only times are compared
        order = lambda a, b: F.when(F.struct(a["ts"], a["seq"]) < F.struct(b["ts"], b["seq"]), -1).otherwise(1)
        entries = F.flatten(F.transform(F.array_sort(items, order), lambda s: F.map_entries(s["v"])))
        keys = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["key"])))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])))
    if op == "merge_value":
        entries = F.flatten(F.transform(items, lambda s: F.map_entries(s["v"])))
        return _sums(entries, lambda e: e["key"], lambda e: e["value"].cast("double"))
    if op == "group_count":
        return _sums(F.filter(items, lambda s: s["g"].isNotNull()), lambda s: s["g"], lambda s: F.lit(1).cast("long"), F.lit(0).cast("long"))
    grouped = F.filter(items, lambda s: s["g"].isNotNull())
    if op == "group_sum":
        return _sums(grouped, lambda s: s["g"], lambda s: s["v"].cast("double"))
    return top(_sums(grouped, lambda s: s["g"], lambda s: F.coalesce(s["v"].try_cast("double"), F.lit(1.0))), n)


def _sums(entries: Column, key: Callable, value: Callable, zero: Column | None = None) -> Column:
    """A map, in order of its keys, of the sums of the entries' values by key."""
    keys = F.array_sort(F.array_distinct(F.transform(entries, lambda e: key(e).cast("string"))))

    def total(k):
        own = F.transform(F.filter(entries, lambda e: key(e).cast("string") == k), value)
        return F.aggregate(own, F.lit(0.0) if zero is None else zero, lambda a, b: a + b)

    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, total(k))))


def top(groups: Column, n: int | None = None) -> Column:
    """The n largest entries of a map as array<struct<key, value>>: by value down, then by key up."""
    entries = F.transform(F.map_entries(groups), lambda e: F.struct((-e["value"].cast("double")).alias("down"), e["key"].alias("key")))
    return F.transform(F.slice(F.array_sort(entries), 1, n or TOPN), lambda e: F.struct(e["key"].alias("key"), (-e["down"]).alias("value")))


def grouped_map(df: DataFrame, keys: list[str], g: Column, v: Column, op: str = "group_count") -> DataFrame:
    """(keys, g, value): the entries of group_count or group_sum, with partial sums before the shuffle; no map is built."""
    value = F.count(v) if check(op) == "group_count" else F.coalesce(F.sum(v.cast("double")), F.lit(0.0))
    return df.where(g.isNotNull() & v.isNotNull()).groupBy(*keys, g.alias("g")).agg(value.alias("value"))


def grouped_top(df: DataFrame, keys: list[str], g: Column, v: Column, n: int = TOPN, seq: Column | None = None) -> DataFrame:
    """(keys, rank, g, value): each key's n largest group sums; an operand that isn't numeric counts 1.

    Sums that differ in their last bits are ranked by these, so with seq each is added up in order of arrival, like
    from_items does, and doesn't depend on where partitions begin.
    """
    number = F.coalesce(v.try_cast("double"), F.lit(1.0))
    x = df.where(g.isNotNull() & v.isNotNull())
    if seq is None:
        sums = x.groupBy(*keys, g.alias("g")).agg(F.sum(number).alias("value"))
    else:
        # a running sum is added up row by row and needs no list of a group in memory
        x = x.select(*keys, g.alias("g"), seq.alias("_seq"), number.alias("_number"))
        arrived = Window.partitionBy(*keys, "g").orderBy("_seq", "_number").rowsBetween(Window.unboundedPreceding, 0)
        x = x.withColumns({"_sum": F.sum("_number").over(arrived), "_place": F.count("*").over(arrived)})
        sums = x.groupBy(*keys, "g").agg(F.max_by("_sum", "_place").alias("value"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "g"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= n)


def merged_maps(df: DataFrame, keys: list[str], m: Column, ts: Column, seq: Column, op: str = "merge") -> DataFrame:
    """(keys, key, value): the entries of merge (the newest of a key) or merge_value (their sum)."""
    x = df.select(*keys, ts.alias("_ts"), seq.alias("_seq"), F.explode(m).alias("key", "value"))
    value = F.max_by("value", F.struct("_ts", "_seq")) if check(op) == "merge" else F.sum(F.col("value").cast("double"))
    return x.groupBy(*keys, "key").agg(value.alias("value"))


def distinct_auto(df: DataFrame, keys: list[str], v: Column, threshold: int = APPROX_THRESHOLD) -> DataFrame:
    """(keys, value, approximate, degraded): exact up to the threshold, from there on by the sketch."""
    from tidewatch.functions import sketches

    exact = df.where(v.isNotNull()).groupBy(*keys, v.cast("string").alias("v")).agg(F.lit(1)).groupBy(*keys).agg(F.count("*").alias("exact"))
    rough = sketches.estimate(sketches.registers(df, keys, v.cast("string")), keys)
    many = F.col("exact") > threshold
    return exact.join(rough, keys).select(*keys, F.when(many, F.col("estimate")).otherwise(F.col("exact")).alias("value"), many.alias("approximate"), many.alias("degraded"))
