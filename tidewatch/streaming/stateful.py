"""Streaming forms: running counters, deduplication, sequences and lateness on unbounded event streams.

They share their step functions with the batch forms, so replaying a finished stream gives the same rows. Events are
handled in order of arrival within a key and micro-batch. State is a short list; once the watermark (the newest time less
the lateness) has passed the last time at which it can matter, it is removed, and events older than the watermark are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidewatch.operators.rules import MOST_PARTIAL, Steps
from tidewatch.operators.windows import LATENESS


def _stateful(df: DataFrame, keys: list[str], output: str, step, matters: int, lateness: int) -> DataFrame:
    """step(state: dict, row: dict) -> rows to emit; state is JSON, so it survives restarts and code changes.

    It matters for that many ms after its newest event.
    """

    def run(key, frames: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        state = json.loads(group.get[0]) if group.exists else {}
        pdf = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = [r for row in pdf.to_dict("records") for r in step(state, row)]
        state["until"] = max(state.get("until", 0), int(pdf["ts"].max()) + matters)
        group.update((json.dumps(state),))
        group.setTimeoutTimestamp(max(state["until"], group.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    names = [c.split()[0] for c in output.split(", ")]
    # Spark drops what is at the watermark, too, and an event that is just so late is still accepted.
    timed = df.withColumn("_event_time", F.timestamp_millis("ts")).withWatermark("_event_time", f"{lateness + 1} milliseconds")
    return timed.groupBy(*keys).applyInPandasWithState(run, output, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def running_count(df: DataFrame, keys: list[str], window: int, lateness: int = LATENESS) -> DataFrame:
    """(keys, seq, ts, value): each event's number of events of its key in the window up to it; older times are dropped."""

    def step(state: dict, row: dict) -> list:
        times = state.setdefault("t", [])
        times.append(int(row["ts"]))
        state["t"] = times = [t for t in times if t > row["ts"] - window]
        return [(*(str(row[k]) for k in keys), int(row["seq"]), int(row["ts"]), len(times))]

    return _stateful(df, keys, ", ".join([*(f"{k} string" for k in keys), "seq long", "ts long", "value long"]), step, window, lateness)


def deduplicated(df: DataFrame, keys: list[str], window: int, lateness: int = LATENESS) -> DataFrame:
    """(keys, seq, ts): hits at least window ms after the last one kept of the same keys."""

    def step(state: dict, row: dict) -> list:
        if "last" in state and row["ts"] - state["last"] < window:
            return []
        state["last"] = int(row["ts"])
        return [(*(str(row[k]) for k in keys), int(row["seq"]), int(row["ts"]))]

    return _stateful(df, keys, ", ".join([*(f"{k} string" for k in keys), "seq long", "ts long"]), step, window, lateness)


def sequences(df: DataFrame, keys: list[str], steps: list[str], within: int, most: int = MOST_PARTIAL, lateness: int = LATENESS) -> DataFrame:
    """(keys, seq, ts, times): completed sequences; steps are boolean columns."""

    def step(state: dict, row: dict) -> list:
        s = Steps(len(steps), within, most)
        s.partial = [[p] for p in state.get("p", [])]
        done = s.event(int(row["ts"]), [bool(row[c]) for c in steps])
        state["p"] = [p[0] for p in s.partial]
        return [(*(str(row[k]) for k in keys), int(row["seq"]), int(row["ts"]), ",".join(map(str, done)))] if done else []

    return _stateful(df, keys, ", ".join([*(f"{k} string" for k in keys), "seq long", "ts long", "times string"]), step, within, lateness)


def hourly(df: DataFrame, by: list[str], event_time: str = "event_ts", lateness: str = "60 seconds") -> DataFrame:
    """Counts by hour, kept up to date as events come; late ones count up to the lateness."""
    return df.withWatermark(event_time, lateness).groupBy(F.window(event_time, "1 hour"), *by).agg(F.count("*").alias("cnt"))


def to_parquet(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Start writing micro-batches as they are, each into its own folder, which a retry replaces."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).start()


def observed(df: DataFrame, name: str = "metrics") -> DataFrame:
    """df that reports how many events, names and late events went through, to listeners and observations."""
    late = F.sum(F.when(F.col("late") != "ACCEPTED", 1).otherwise(0)).alias("late") if "late" in df.columns else F.lit(0).alias("late")
    return df.observe(name, F.count(F.lit(1)).alias("events_in"), F.count("name").alias("named"), late)
