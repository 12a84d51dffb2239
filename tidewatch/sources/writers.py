"""Sinks: JSON lines, partitioned Parquet, Kafka, and the risk list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def by_day(df: DataFrame, path: str, ts: str = "ts", mode: str = "append") -> None:
    """Parquet partitioned by UTC day, clustered by it first so that a day's files are few."""
    df = df.withColumn("event_date", F.to_date(F.timestamp_millis(F.col(ts))))
    df.repartition("event_date", F.pmod(F.xxhash64(ts), F.lit(16))).write.mode(mode).partitionBy("event_date").parquet(path)


def partition_key() -> Column:
    """What a message is keyed by: the user, else the device, else the address."""
    return F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("uid", "did", "c_ip")))


def kafka_rows(df: DataFrame) -> DataFrame:
    present = [c for c in ("uid", "did", "c_ip") if c in df.columns]
    key = F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in present)) if present else F.lit(None).cast("string")
    return df.select(key.alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def kafka(df: DataFrame, servers: str, topic: str) -> None:
    """Needs the Kafka connector on the class path."""
    kafka_rows(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def notice_rows(notices: DataFrame) -> DataFrame:
    """Notices as stored: explanations as texts "value operator threshold"."""
    flat = F.transform_values("variable_values", lambda k, v: F.concat_ws(" ", v["value"], v["operator"], v["threshold"]))
    return notices.withColumn("variable_values", flat)


def risk_list(notices: DataFrame) -> DataFrame:
    """The entries that notices add to the risk list."""
    return notices.select("check_type", "key", "strategy_name", "scene_name", "decision", "test", "timestamp", "expire")
