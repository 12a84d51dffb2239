"""Locations of IPv4 addresses from a table of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 16


def number(ip: Column) -> Column:
    """An address as a number; null for what isn't one."""
    parts = [F.get(F.split(ip, r"\."), F.lit(i)).try_cast("long") for i in range(4)]
    good = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}\z") & F.greatest(*parts).between(0, 255)
    return F.when(good, sum((p * (256 ** (3 - i)) for i, p in enumerate(parts)), F.lit(0)))


def located(df: DataFrame, ranges: DataFrame, ip: str, levels: tuple[str, ...] = ("country", "province", "city")) -> DataFrame:
    """df with a column for each level, "unknown" where no range (low, high, levels) holds the address.

    Ranges are cut at the borders of /16 blocks, so that the lookup is an equi-join on the block and never a product;
    of ranges that overlap the narrowest wins. Rows are kept one to one.
    """
    block = 1 << 32 - PREFIX
    cut = ranges.select("low", "high", *levels, F.explode(F.sequence(F.floor(F.col("low") / block), F.floor(F.col("high") / block))).alias("_block"))
    by_block = cut.groupBy("_block").agg(F.sort_array(F.collect_list(F.struct((F.col("high") - F.col("low")).alias("width"), "low", "high", *levels))).alias("_ranges"))
    x = df.withColumn("_n", number(F.col(ip).cast("string"))).withColumn("_block", F.floor(F.col("_n") / block))
    x = x.join(by_block, "_block", "left")
    hit = F.get(F.filter("_ranges", lambda r: (r["low"] <= F.col("_n")) & (F.col("_n") <= r["high"])), F.lit(0))
    return x.withColumns({level: F.coalesce(hit[level], F.lit("unknown")) for level in levels}).drop("_block", "_ranges", "_n")
