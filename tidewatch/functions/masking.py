"""Privacy functions over string columns: redaction, keyed hashes, partial and pattern masks, display masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REDACTED = "<REDACTED>"
#: Fixed value: query parameters whose values are masked.
PARAMETERS = r"(?i)(password|passwd|pwd|token|secret|captcha|authorization|access_token|refresh_token)=([^&]*)"


def drop(x: Column) -> Column:
    """The mark in place of any value; null and empty stay."""
    x = x.cast("string")
    return F.when(x.isNotNull() & (x != ""), F.lit(REDACTED)).otherwise(x)


def hmac_sha256(x: Column, key: bytes) -> Column:
    """Lowercase hex of HMAC-SHA256, composed of JVM functions; null and empty stay."""
    if not key:
        raise ValueError("a key is needed")
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda b: F.lit(bytes(c ^ b for c in block))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), x.cast("string").cast("binary")), 256))
    return F.when(x.isNotNull() & (x != ""), F.sha2(F.concat(pad(0x5C), inner), 256)).otherwise(x)


def hashed(x: Column, key: bytes) -> Column:
    """The collector's short form: "h:" and the first 16 bytes."""
    return F.when(x.isNotNull() & (x != ""), F.concat(F.lit("h:"), F.substring(hmac_sha256(x, key), 1, 32))).otherwise(x)


def partial(x: Column, prefix: int = 3, suffix: int = 4) -> Column:
    """Stars but for the first and last characters; all stars where these would be everything."""
    n = F.length(x)
    kept = F.concat(F.substring(x, 1, prefix), F.repeat(F.lit("*"), n - prefix - suffix), F.right(x, F.lit(suffix)))
    return F.when(n > prefix + suffix, kept).otherwise(F.repeat(F.lit("*"), n))


def pattern(x: Column, regex: str = PARAMETERS, to: str = f"$1={REDACTED}") -> Column:
    return F.regexp_replace(x, regex, to)


def display(x: Column) -> Column:
    """For people: an IPv4 address without its last part; else three characters at either end, one if short, none if very short."""
    n = F.length(x)
    stars = lambda keep: F.concat(F.substring(x, 1, keep), F.repeat(F.lit("*"), n - 2 * keep), F.right(x, F.lit(keep)))
    return (
        F.when(x.rlike(r"^\d{1,3}(\.\d{1,3}){3}\z"), F.regexp_replace(x, r"\d+\z", "*"))
        .when(n <= 2, F.repeat(F.lit("*"), n))
        .when(n <= 6, stars(1))
        .otherwise(stars(3))
    )


METHODS = ("none", "drop", "hash", "partial", "regex")


def resolve(properties: list[dict], rules: dict[str, dict] | None = None) -> dict[str, dict]:
    """By field: its rule. An explicit rule goes before the property's own masking, that before the sensitivity's default."""
    out = {}
    for p in properties:
        rule = (rules or {}).get(p["name"]) or p.get("masking") or ({"method": "drop"} if p.get("sensitivity") == "sensitive" else None)
        if rule and rule["method"] != "none":
            if rule["method"] not in METHODS:
                raise ValueError(f"unknown masking {rule['method']!r}")
            out[p["name"]] = rule
    return out


def mask(df: DataFrame, rules: dict[str, dict], key: bytes = b"") -> DataFrame:
    """df with every field that has a rule masked; wrong rules and a missing key fail before any row is read."""
    out = {}
    for name, rule in rules.items():
        if name in df.columns:
            x = F.col(name).cast("string")
            out[name] = {"drop": lambda x, r: drop(x), "hash": lambda x, r: hashed(x, key), "partial": lambda x, r: partial(x, r.get("prefix", 3), r.get("suffix", 4)), "regex": lambda x, r: pattern(x, r.get("pattern", PARAMETERS), r.get("to", f"$1={REDACTED}"))}[rule["method"]](x, rule)
    return df.withColumns(out) if out else df


def at_rest(df: DataFrame, key: bytes, fields: tuple[str, ...] = ("uid", "did", "sid")) -> DataFrame:
    """Identities as they are stored: the full keyed hash, empty ones as they are."""
    return df.withColumns({f: hmac_sha256(F.col(f).cast("string"), key) for f in fields if f in df.columns})
