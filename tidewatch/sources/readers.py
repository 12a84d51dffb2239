"""Event sources: JSON lines, array or object bodies, syslog, Kafka and Parquet, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a line beyond which it isn't an event.
LONGEST = 8 << 20
ENVELOPE = T.StructType([T.StructField(n, T.LongType() if n in ("timestamp", "status") else T.StringType()) for n in "id pid name timestamp c_ip uid did sid host page uri_stem method status referer useragent geo_province geo_city".split()])


def parsed(lines: DataFrame, text: str = "value", default_name: str | None = None, now: Column | None = None, schema: T.StructType = ENVELOPE) -> tuple[DataFrame, DataFrame]:
    """(events, rejected lines). Blank lines are neither; what isn't an object, is too long, or lacks a name or time is rejected.

    A missing name or time is filled where a default is given. The whole object is kept as attrs.
    """
    x = lines.where(F.trim(text) != "").withColumn("_line", F.col(text))
    x = x.withColumn("_e", F.from_json("_line", schema, {"mode": "PERMISSIVE"})).withColumn("_a", F.from_json("_line", "map<string,string>", {"mode": "PERMISSIVE"}))
    name = F.coalesce("_e.name", F.lit(default_name)) if default_name else F.col("_e.name")
    ts = F.coalesce("_e.timestamp", now.cast("long")) if now is not None else F.col("_e.timestamp")
    good = F.coalesce((F.octet_length("_line") <= LONGEST) & F.get_json_object("_line", "$").startswith("{") & name.isNotNull() & ts.isNotNull(), F.lit(False))
    fields = [F.col(f"_e.{f.name}") for f in schema if f.name not in ("name", "timestamp")]
    kept = [c for c in lines.columns if c != text]
    return x.where(good).select(*kept, name.alias("name"), ts.alias("ts"), F.timestamp_millis(ts).alias("event_ts"), *fields, F.col("_a").alias("attrs")), x.where(~good).select(*kept, F.col("_line").alias(text))


def json_lines(spark: SparkSession, path: str, **how) -> tuple[DataFrame, DataFrame]:
    return parsed(spark.read.text(path), **how)


def json_stream(spark: SparkSession, path: str, **how) -> DataFrame:
    """The events of a folder to which files of JSON lines are added."""
    return parsed(spark.readStream.text(path), **how)[0]


def bodies(requests: DataFrame, text: str = "value") -> DataFrame:
    """A line for each event of request bodies that are an object or an array of objects."""
    one = F.trim(F.col(text))
    # an element is taken out by its place, as an array of objects of unknown fields has no schema
    several = F.transform(F.sequence(F.lit(0), F.coalesce(F.json_array_length(one), F.lit(1)) - 1), lambda i: F.try_variant_get(F.try_parse_json(one), "$", "array<variant>")[i])
    lines = F.when(one.startswith("["), F.transform(several, lambda v: F.to_json(v))).otherwise(F.array(one))
    return requests.where((one != "") & (F.coalesce(F.json_array_length(one), F.lit(1)) > 0)).withColumn(text, F.explode(lines))


#: The two header forms of syslog.
RFC3164 = r"^<(\d{1,3})>([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (\S+) ([^:\[\s]+)(?:\[([^\]]*)\])?: ?(.*)$"
RFC5424 = r"^<(\d{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (?:-|(?:\[.*?\])+) ?(.*)$"


def syslog(lines: DataFrame, text: str = "value", name: str = "SYSLOG") -> DataFrame:
    """lines with facility, severity, header fields, and a body whose JSON fields (attrs) override; other bodies are the message."""
    x = F.regexp_replace(F.col(text), r"[\r\n]+\z", "")
    new = x.rlike(RFC5424)
    part = lambda a, b: F.nullif(F.when(new, F.regexp_extract(x, RFC5424, a) if a else F.lit("")).otherwise(F.regexp_extract(x, RFC3164, b) if b else F.lit("")), F.lit(""))
    pri = F.regexp_extract(x, r"^<(\d{1,3})>", 1).try_cast("int")
    body = F.coalesce(part(7, 6), F.when(~new & ~x.rlike(RFC3164), F.regexp_replace(x, r"^<\d{1,3}>", "")))
    is_json = F.coalesce(F.get_json_object(body, "$").startswith("{"), F.lit(False))
    nil = lambda c: F.nullif(c, F.lit("-"))
    out = lines.withColumns({"facility": F.floor(pri / 8).cast("int"), "severity": pri % 8, "time": nil(part(2, 2)), "host": nil(part(3, 3)), "app": nil(part(4, 4)), "proc": nil(part(5, 5)), "msgid": nil(part(6, 0)), "attrs": F.when(is_json, F.from_json(body, "map<string,string>")), "message": F.when(~is_json, body)})
    return out.withColumn("name", F.coalesce(F.element_at("attrs", "name"), F.lit(name)))


def kafka(spark: SparkSession, servers: str, topic: str, stream: bool = True, **how) -> DataFrame:
    """The events of a topic's values, from its beginning. Needs the Kafka connector on the class path."""
    reader = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    return parsed(reader.load().select(F.col("value").cast("string").alias("value")), **how)[0]


def millis(t: Column) -> Column:
    """A wall-clock time as epoch milliseconds in UTC, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t.cast("timestamp_ntz"))


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as an event stream."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = millis(F.col("ts"))
    return e.select(F.col("event_id").alias("seq"), ms.alias("ts"), F.col("event_type").alias("name"), F.col("user_id").alias("uid"), F.col("value").alias("amount"), F.get_json_object("props", "$.k").cast("long").alias("grp"))


def orders_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table as a stream of ORDER_SUBMIT events: days as times, so with many ties and late arrivals."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ms = millis(F.col("o_orderdate"))
    return o.select(F.col("o_orderkey").alias("seq"), ms.alias("ts"), F.lit("ORDER_SUBMIT").alias("name"), F.col("o_custkey").alias("uid"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("result"))
