"""Secret scan: fixed patterns, and a password guess-cost dynamic programme for other values in credential contexts.

The programme finds the cheapest way to cut a value into dictionary words (plain or with look-alike digits), dates,
repeats, keyboard or alphabet walks and brute-force spans; the logarithms of the guesses add up. A value that would take
at least 10^GUESSES guesses, and that patterns don't cover whole, is a secret of kind "guess". Time is linear in the text.

Null and empty texts have no spans. Spans are (kind, start, end) in code points, the end exclusive, ordered by start and
then by kind as in KINDS; each row is judged by itself, so repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import lean, ship, table

KINDS = ("assign", "access", "hex", "guess")
#: The logarithm of the guesses from which a value counts as a secret.
GUESSES = 8.0
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
#: Keywords stand anywhere in an identifier, the short ones where a word of it begins; what follows must begin another word.
CONTEXT = re.compile(
    r"""(?ai)(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|credential|private[_-]?key|(?:(?<![a-z])|(?=(?-i:[A-Z][a-z])))(?:pass|auth))"""
    r"""s?(?:(?:[_-]|\d|(?-i:[A-Z]))[\w-]{0,64})?["']?[ \t]*[:=][ \t]*["']?([^\s"'<>,;]{6,})"""
)
#: A text in which none of these stands, whatever the case, has no credential context.
HINTS = ("pass", "pwd", "secret", "token", "api", "credential", "private", "auth")
#: Frequent words of passwords and placeholders, the most frequent first.
WORDS = """password admin welcome letmein monkey dragon master login secret qwerty hello shadow sunshine princess
football baseball superman batman iloveyou trustno access flower summer winter spring autumn love angel freedom
whatever changeme change default example sample test user guest root temp demo pass word key token api value your
this here the and for with not none null true false empty string placeholder redacted hidden xxx abc my new old
server database mysql postgres oracle public private company office home computer internet google apple""".split()
#: Rows of a keyboard and of alphabets along which walks go.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "01234567890", "abcdefghijklmnopqrstuvwxyz")
RANK = {w: math.log10(i + 2) for i, w in reversed(list(enumerate(WORDS)))}
LONGEST = max(10, *map(len, RANK))  # of words and dates
STEPS = {pair for row in ROWS for r in (row, row[::-1]) for pair in zip(r, r[1:])}
LOOKS = str.maketrans("4@3015$7!", "aaeoissti")
SEGMENT = math.log10(2)


def guess_cost(value: str) -> float:
    """The logarithm of the guesses that the cheapest segmentation takes; 0 for the empty value."""
    low = "".join(c.lower() if c.isascii() else c for c in value)
    plain = low.translate(LOOKS)
    best, run, walk = [0.0], 1, 1
    for end in range(1, len(low) + 1):
        c = low[end - 1]
        run = run + 1 if end > 1 and low[end - 2] == c else 1
        walk = walk + 1 if end > 1 and (low[end - 2], c) in STEPS else 1
        cost = best[-1] + (1.0 if c.isalnum() else 1.2)
        # a repeat or walk may begin behind a word or date that holds its first characters
        for k in range(max(3, run - LONGEST), run + 1):
            cost = min(cost, best[end - k] + math.log10(36 * k) + SEGMENT)
        for k in range(max(3, walk - LONGEST), walk + 1):
            cost = min(cost, best[end - k] + math.log10(40 * k) + SEGMENT)
        for size in range(3, min(LONGEST, end) + 1):
            start = end - size
            word = low[start:end]
            rank = RANK.get(word)
            if rank is None and (rank := RANK.get(plain[start:end])) is not None:
                rank += 0.6
            if rank is not None:
                cost = min(cost, best[start] + rank + SEGMENT + (0.3 if value[start:end] != word else 0))
        if c in "0123456789":
            if end >= 4 and low[end - 4 : end - 2] in ("19", "20") and low[end - 2 : end].isdigit():
                cost = min(cost, best[end - 4] + math.log10(200) + SEGMENT)
            if end >= 8 and (d := low[end - 8 : end]).isascii() and d.isdigit() and (_date(d[:4], d[4:6], d[6:]) or _date(d[4:], d[2:4], d[:2])):
                cost = min(cost, best[end - 8] + math.log10(365 * 200) + SEGMENT)
            if end >= 10 and (m := re.fullmatch(r"(\d{4})([-/.])(\d\d)\2(\d\d)", low[end - 10 : end], re.A)) and _date(m[1], m[3], m[4]):
                cost = min(cost, best[end - 10] + math.log10(365 * 200 * 4) + SEGMENT)
        best.append(cost)
    return best[-1]


def _date(year: str, month: str, day: str) -> bool:
    return "1900" <= year <= "2099" and "01" <= month <= "12" and "01" <= day <= "31"


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    if not text:
        return []
    found = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        taken: list[list[int]] = []
        for s, e in sorted((s, e) for _, s, e in found):
            if taken and s <= taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], e)
            else:
                taken.append([s, e])
        k = 0
        for m in CONTEXT.finditer(text):
            start, end = m.start(1), m.start(1) + len(m[1].rstrip(")]}."))
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            covered = k < len(taken) and taken[k][0] <= start and end <= taken[k][1]
            if not covered and guess_cost(m[1]) >= GUESSES:
                found.append(("guess", m.start(1), m.end(1)))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(spark: SparkSession, text: Column) -> Column:
    """array<struct<kind, start, end>>: the secrets of each text."""
    ship(spark)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("array<struct<kind: string, start: bigint, end: bigint>>")
    @lean
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t.as_py())] for t in texts], kind)

    return run(text)


def redact(spark: SparkSession, text: Column, mark: str = "[SECRET]") -> Column:
    """Each text with its secrets, or runs of those that overlap, replaced by the mark; null stays null."""
    ship(spark)

    @F.arrow_udf("string")
    @lean
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([redacted(t.as_py(), mark) for t in texts], pa.string())

    return run(text)


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    if not text:
        return text
    out, at = [], 0
    for _, start, end in spans_of(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", find_secrets(spark, F.col("text")).alias("found"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x.kind == kind)).cast("long")
    base = F.filter("found", lambda x: x.kind != "guess")
    return docs.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
