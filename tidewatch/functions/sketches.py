"""Distinct counting: murmur3 (x86, 32 bits) and a mergeable register sketch of 2^14 registers, in JVM arithmetic only.

Registers are rows (key, register, rank), so sketches are merged by a grouped maximum, at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 14
MASK = 0xFFFFFFFF


def _times(x: Column, c: int) -> Column:
    """x * c modulo 2^32, for x below 2^32, without overflow of 64 bits."""
    low, high = x.bitwiseAND(0xFFFF), F.shiftright(x, 16)
    return (low * c + F.shiftleft((high * (c & 0xFFFF)).bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK) if c <= MASK else None


def _turn(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseAND(MASK).bitwiseOR(F.shiftright(x, 32 - n))


def _scrambled(k: Column) -> Column:
    return _times(_turn(_times(k, 0xCC9E2D51), 15), 0x1B873593)


def murmur3(x: Column, seed: int = 0) -> Column:
    """The hash of a string's UTF-8 bytes, 0 to 2^32 - 1."""
    h = F.hex(x.cast("string").cast("binary"))
    n = F.octet_length(x.cast("string"))
    byte = lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    word = lambda i: byte(i) + F.shiftleft(byte(i + 1), 8) + F.shiftleft(byte(i + 2), 16) + F.shiftleft(byte(i + 3), 24)
    blocks = F.floor(n / 4).cast("int")
    starts = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))
    mixed = F.aggregate(starts, F.lit(seed).cast("long"), lambda a, i: (_times(_turn(a.bitwiseXOR(_scrambled(word(i * 4))), 13), 5) + 0xE6546B64).bitwiseAND(MASK))
    t, rest = blocks * 4, n % 4
    tail = F.when(rest >= 1, byte(t)).otherwise(0) + F.when(rest >= 2, F.shiftleft(byte(t + 1), 8)).otherwise(0) + F.when(rest >= 3, F.shiftleft(byte(t + 2), 16)).otherwise(0)
    # the parts are bound by one-element transforms, so that each is computed once
    one = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))
    h1 = mixed.bitwiseXOR(F.when(rest > 0, _scrambled(tail)).otherwise(F.lit(0).cast("long"))).bitwiseXOR(n.cast("long"))
    h1 = one(h1, lambda v: _times(v.bitwiseXOR(F.shiftright(v, 16)), 0x85EBCA6B))
    h1 = one(h1, lambda v: _times(v.bitwiseXOR(F.shiftright(v, 13)), 0xC2B2AE35))
    return one(h1, lambda v: v.bitwiseXOR(F.shiftright(v, 16)))


def registers(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, register, rank): the sketch of each key's values; a null value counts for nothing."""
    x = df.where(value.isNotNull()).select(*keys, murmur3(value).alias("h"))
    w = F.shiftleft("h", BITS).bitwiseAND(MASK)
    rank = F.when(w == 0, 32 - BITS + 1).otherwise(32 - F.length(F.bin(w)) + 1)
    return x.groupBy(*keys, F.shiftright("h", 32 - BITS).alias("register")).agg(F.max(rank).alias("rank"))


def merged(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    keys = [c for c in out.columns if c != "rank"]
    return out.groupBy(*keys).agg(F.max("rank").alias("rank"))


def estimate(sketch: DataFrame, keys: list[str], out: str = "estimate") -> DataFrame:
    """The rounded number of distinct values, by linear counting where few registers are set."""
    m = 1 << BITS
    used = sketch.groupBy(*keys).agg(F.count("*").alias("used"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"))
    raw = (0.7213 / (1 + 1.079 / m)) * m * m / (F.col("s") + m - F.col("used"))
    free = m - F.col("used")
    small = (raw <= 2.5 * m) & (free > 0)
    return used.select(*keys, F.round(F.when(small, m * F.log(m / F.nullif(free, F.lit(0)))).otherwise(raw)).cast("long").alias(out))
