"""Event-time windows: what a running statistic covers when an event has just arrived.

Two exact forms. Where each key's events arrive in strictly rising event time, a window is a plain frame. Where they may
arrive late or at equal times, the frame is widened by the allowed lateness and its rows are picked by arrival.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidewatch.operators import aggregates

HOUR, DAY = 3_600_000, 86_400_000
#: Milliseconds behind the stream's newest event up to which an event is still accepted.
LATENESS = 60_000
UNITS = {"last_n_seconds": 1000, "last_n_hours": HOUR, "last_n_days": DAY}
TYPES = (*UNITS, "hourly", "today", "ever", "self", "")


def local_time(ts: Column, zone: str) -> Column:
    """Epoch milliseconds as the wall clock of a zone, whatever the session's zone."""
    utc = F.timestamp_add("MILLISECOND", ts, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


@dataclass(frozen=True)
class Period:
    """type: last_n_seconds, last_n_hours, last_n_days, hourly, today, ever, self; value: its n, 1 if missing."""

    type: str = "ever"
    value: int | str | None = None
    zone: str = "UTC"

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"unknown period {self.type!r}")

    @property
    def n(self) -> int:
        return int(self.value) if self.value not in (None, "") else 1

    @property
    def size(self) -> int | None:
        """Milliseconds of a sliding window."""
        return self.n * UNITS[self.type] if self.type in UNITS else None

    def bucket(self, ts: Column) -> Column | None:
        """The start of a tumbling window, in UTC; of "today", the day in the zone."""
        if self.type == "hourly":
            return ts - F.pmod(ts, F.lit(self.n * HOUR))
        if self.type == "today":
            return F.to_date(local_time(ts, self.zone))
        return None


def frame(period: Period, keys: list[str], bucket: str | None, ts: str = "ts", seq: str = "seq") -> WindowSpec:
    """The frame of a period for streams in strictly rising event time."""
    w = Window.partitionBy(*keys, *([bucket] if bucket else []))
    if period.size:
        return w.orderBy(ts).rangeBetween(-(period.size - 1), 0)
    w = w.orderBy(seq)
    return w.rowsBetween(0, 0) if period.type in ("self", "") else w.rowsBetween(Window.unboundedPreceding, 0)


def sliding(op: str, period: Period, keys: list[str], v: Column, ts: str = "ts", seq: str = "seq") -> Column:
    """A plain frame's value as an expression, for rows that with_keys has given their keys."""
    w = frame(period, [f"_key_{k}" for k in keys], None, ts, seq)
    return aggregates.aggregate(op, v, F.col(ts), F.col(seq), over=lambda c: c.over(w))


def counter_sql(op: str, seconds: int, keys: list[str], where: str, value: str) -> str:
    """The same of a count, sum or distinct count over the last seconds, in SQL text."""
    over = f"OVER (PARTITION BY {', '.join(f'`_key_{k}`' for k in keys) or 'NULL'} ORDER BY ts RANGE BETWEEN {int(seconds) * 1000 - 1}L PRECEDING AND CURRENT ROW)"
    v = f"CASE WHEN {where} THEN {value} END"
    found = {"count": f"count({v}) {over}", "sum": f"coalesce(sum(cast({v} as double)) {over}, 0.0D)", "distinct_count": f"cast(size(collect_set(cast({v} as string)) {over}) as bigint)"}
    return found[op]


def with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns that windows are partitioned by, unless it has them: statistics that share them share a shuffle."""
    new = {f"_key_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys if f"_key_{c}" not in df.columns}
    return df.withColumns(new) if new else df


def running(
    df: DataFrame, out: str, op: str, period: Period, keys: list[str], v: Column, g: Column | None = None, n: int | None = None, where: Column | None = None, ordered: bool = True, lateness: int = LATENESS, ts: str = "ts", seq: str = "seq"
) -> DataFrame:
    """df with the column out: the operator's value for each row's key after that row's event.

    Null keys are one key. ordered: each key's events arrive in strictly rising event time; else any order is right, and
    rows that are late by more than lateness (see classify) count for nothing, and see what lies up to lateness after them.
    """
    passed = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    v = F.when(passed, v)
    names = [f"_key_{c}" for c in keys]
    keyed = with_keys(df, keys)
    bucket = period.bucket(F.col(ts))
    if bucket is not None:
        keyed = keyed.withColumn("_bucket", bucket)
    extra = [*(k for k in names if k not in df.columns), *(["_bucket"] if bucket is not None else [])]
    if ordered or period.type in ("self", ""):
        w = frame(period, names, "_bucket" if bucket is not None else None, ts, seq)
        value = aggregates.aggregate(op, v, F.col(ts), F.col(seq), g, n, lambda c: c.over(w))
        return keyed.withColumn(out, value).drop(*extra)
    if "late" not in keyed.columns:
        keyed = classify(keyed, lateness, ts, seq)
        extra += ["late", "watermark"]
    kept = v.isNotNull() & (F.col("late") != DROPPED)
    if bucket is not None:
        # a bucket that a newer one has replaced is closed: its events count for nothing any more
        newest = F.max("_bucket").over(Window.partitionBy(*names).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
        keyed = keyed.withColumn("_newest", newest)
        extra.append("_newest")
        kept = kept & (F.col("_bucket") == F.col("_newest"))
        w = Window.partitionBy(*names, "_newest").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    elif period.size:
        w = Window.partitionBy(*names).orderBy(ts).rangeBetween(-(period.size - 1), lateness)
    else:
        w = Window.partitionBy(*names).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    item = F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"), v.alias("v"), *([g.alias("g")] if g is not None else []))
    keyed = keyed.withColumn("_items", F.collect_list(F.when(kept, item)).over(w))
    arrived = F.filter("_items", lambda s: s["seq"] <= F.col(seq))
    return keyed.withColumn(out, aggregates.from_items(op, arrived, n)).drop(*extra, "_items")


#: Events of a range of arrival that one task sorts for the watermark, at most.
RANGE = 5_000_000
ACCEPTED, LATE, DROPPED = "ACCEPTED", "LATE_ACCEPTED", "LATE_DROPPED"


def watermark(df: DataFrame, ts: str = "ts", seq: str = "seq", parts: int = 64) -> DataFrame:
    """df with the column watermark: the newest event time of the stream up to and with each event.

    The running maximum over the whole stream is taken in two steps: within ranges of arrival, and over the ranges'
    maxima, of which there are `parts`, or more where a range would hold over RANGE events; so no single task sees the stream.
    """
    bounds = df.agg(F.min(seq), F.max(seq)).first()
    low, high = (bounds[0] or 0, bounds[1] or 0) if bounds else (0, 0)
    width = max(1, min(RANGE, -(-(high - low + 1) // parts)))
    x = df.withColumn("_part", F.floor((F.col(seq) - low) / width))
    tops = x.groupBy("_part").agg(F.max(ts).alias("_top"))
    before = F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select("_part", before.alias("_before"))
    inner = F.max(ts).over(Window.partitionBy("_part").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    return x.join(tops, "_part").withColumn("watermark", F.greatest("_before", inner)).drop("_part", "_before")


def classify(df: DataFrame, lateness: int = LATENESS, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """df with watermark and late: ACCEPTED, LATE_ACCEPTED behind the watermark, LATE_DROPPED by more than lateness."""
    x = watermark(df, ts, seq)
    t, w = F.col(ts), F.col("watermark")
    return x.withColumn("late", F.when(t < w - lateness, DROPPED).when(t < w, LATE).otherwise(ACCEPTED))


def split_late(df: DataFrame, lateness: int = LATENESS) -> tuple[DataFrame, DataFrame]:
    """(accepted, dropped): the stream and its side output."""
    x = classify(df, lateness)
    return x.where(F.col("late") != DROPPED), x.where(F.col("late") == DROPPED)
