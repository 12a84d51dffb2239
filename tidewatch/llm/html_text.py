"""Main text of web pages, by differencing each page with the page of the nearest URL on its host.

Pages are range-partitioned and sorted by host and URL path, so that a host of any size is spread over tasks, and each
task holds three pages at a time. A page is paired with the neighbour whose path has the longer beginning in common with
its own (the one before on a tie); copies (pages of the same lines in a row) are passed over, and a first pass carries the
pages at the borders of the partitions to their neighbours, so that the partitions make no difference. Both are cut into text lines, a longest common subsequence aligns the lines, and
shared lines go. Two things temper this, as a differencing by itself would take a passage that two articles quote for a
menu, and keep an advert that changes from page to page: lines in an element that says it holds the article (article,
main) are kept though shared, and lines in elements that say they hold something else (MARKS, and class, id and role
names in NAMES) go though not shared.

Null html is empty; empty pages have an empty text and are nobody's neighbour. Pages without a host, null urls included,
are taken as one host's. Every row gives one row, repeated ones too. Unclosed and unopened elements, and markup cut off,
are read as far as they go. Time is linear in the page but for the alignment, which takes 1/64 operations a pair of lines.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import ascii_lower, dealt, partitions, ship, table

#: Elements that hold no text, that aren't of the article, that are, and that end a line.
SILENT = frozenset("script style template noscript svg math iframe object head title select textarea button audio video canvas map".split())
MARKS = frozenset("nav footer aside form menu dialog".split())
HOLDERS = frozenset("article main".split())
LINES = frozenset(
    "p div li ul ol dl dt dd h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption section article main header footer nav aside form fieldset legend label"
    " address blockquote pre hr br figure figcaption details summary menu dialog body html option center".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role names of what isn't of the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner menu nav navbar navigation breadcrumb breadcrumbs sidebar side rail"
    " cookie cookies consent gdpr notice notices alert popup modal overlay comment comments reply replies disqus respond footer foot masthead topbar toolbar"
    " share sharing social related recommended newsletter subscribe signup login search pagination pager widget copyright legal complementary contentinfo dialog".split()
)
TAG = re.compile(r"""<(?:!--.*?(?:-->|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|$)|/?[a-zA-Z][^>]*(?:>|$))""", re.S)
LABEL = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VALUE = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""")
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)""", re.I)
#: What makes an article element one of something else.
SAYINGS = frozenset("comment comments reply replies ad advert advertisement sponsored promo related".split())
CUT = re.compile(r"[^a-z]+")
END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in SILENT}
PLAIN, HELD, OTHER = 0, 1, 2


def _state(name: str, attributes: str, outer: int) -> int:
    """What an element says of its lines, given what the element round it says."""
    if outer == OTHER or name in MARKS:
        return OTHER
    if HIDDEN.search(VALUE.sub("= ", attributes)):
        return OTHER
    named = {w for m in LABEL.finditer(attributes) for w in CUT.split((m[1] or m[2] or m[3] or "").lower())} if "=" in attributes else ()
    if name in HOLDERS:
        return OTHER if not SAYINGS.isdisjoint(named) else HELD
    if name in ("body", "html"):
        return outer
    if not NAMES.isdisjoint(named):
        return OTHER
    return OTHER if outer == PLAIN and (name == "header" or "header" in named) else outer


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """(text, PLAIN, HELD or OTHER) of each line of a page, white space folded and references decoded."""
    lines: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []
    state, at, page = PLAIN, 0, page or ""

    def end_line():
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if line:
                lines.append((line, state))

    n = len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in LINES:
            end_line()
            if not m[1] and stack and stack[-1][0] == "p":  # a paragraph ends where the next element of its kind begins
                state = stack.pop()[1]
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    end_line()
                    state = stack[k][1]
                    del stack[k:]
                    break
        elif name in SILENT:
            if not m[3].endswith("/"):
                e = END[name].search(page, at)
                # an element that is never closed hides the rest, but a head or title ends where the body begins
                at = e.end() if e else page.find("<body", at) if name in ("head", "title") and "<body" in page[at:] else n
        elif name not in VOID and (name in LINES or "=" in m[3]) and not m[3].endswith("/"):
            inner = _state(name, m[3], state)
            if inner != state:
                end_line()
                stack.append((name, state))
                state = inner
            elif any(name == x for x, _ in stack):
                stack.append((name, state))
    end_line()
    return lines


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence of both, by bit-parallel dynamic programming."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    same = {*range(first), *range(len(a) - last, len(a))}
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    where: dict[str, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    kept = [i for i, line in enumerate(a) if line in where]
    if not kept:
        return same
    full = (1 << len(b)) - 1
    v, states = full, []
    for i in kept:
        states.append(v)
        u = v & where[a[i]]
        v = ((v + u) | (v - u)) & full
    # a zero bit j of a state says that the length grows at j; walk back along the steps that made it
    states.append(v)
    j = len(b) - 1
    for k in range(len(kept) - 1, -1, -1):
        while j >= 0 and states[k + 1] >> j & 1:
            j -= 1
        if j < 0:
            break
        if states[k] >> j & 1:  # this line made the length grow at j
            same.add(first + kept[k])
            j -= 1
    return same


def main_text(lines: list[tuple[str, int]], near: list[tuple[str, int]] | None) -> str:
    """The page's text without what it shares with the near page, and without what says it isn't of the article."""
    shared = shared_lines([t for t, _ in lines], [t for t, _ in near]) if near else set()
    return " ".join(t for k, (t, s) in enumerate(lines) if s == HELD or s == PLAIN and k not in shared)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """The columns keep, which don't include out, and the main text of each page."""
    spark = pages.sparkSession
    ship(spark)
    host = F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))
    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = pages.select(*own, host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    kinds = ", ".join(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    rows = rows.mapInArrow(_reader, f"{kinds}, host string, path string, lines binary")
    order = ["host", "path", *(f"k{i}" for i in range(len(keep)))]
    # dealt once and sorted down to the lines, so that both passes see the same rows in the same order
    rows = dealt(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "lines"))
    edges = rows.select("host", "path", "lines").mapInArrow(_edges, "part int, place int, host string, first string, last string, lines binary")
    sent = spark.sparkContext.broadcast(_beside(edges.toArrow().sort_by([("part", "ascending"), ("place", "ascending")]).to_pylist()))
    texts = rows.mapInArrow(_differencer(len(keep), sent), f"{kinds}, text string")
    return texts.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("text").alias(out))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """html read into lines, compressed, after their size; a line holds no line feed."""
    for batch in batches:
        found = []
        for page in batch.column(batch.num_columns - 1):
            body = "\n".join(f"{s}{t}" for t, s in lines_of(page.as_py())).encode()
            found.append(len(body).to_bytes(8) + pa.compress(body, "zstd", asbytes=True) if body else b"")
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], [*batch.schema.names[:-1], "lines"])


def _lines(packed: bytes) -> list[tuple[str, int]]:
    return [(x[1:], int(x[0])) for x in pa.decompress(packed[8:], int.from_bytes(packed[:8]), "zstd", asbytes=True).decode().split("\n")]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first two and the last two runs of copies of a partition: host, first and last path, lines."""
    first, last, count = [], deque(maxlen=2), 0
    for batch in batches:
        for row in zip(*batch.columns):
            host, path, lines = (x.as_py() for x in row)
            if not lines:
                continue
            if last and (last[-1][1], last[-1][4]) == (host, lines):
                last[-1][3] = path
                continue
            last.append([count, host, path, path, lines])
            if count < 2:
                first.append(last[-1])
            count += 1
    found = [*first, *(x for x in last if x[0] >= 2)]
    if found:
        part = TaskContext.get().partitionId()
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*((part, *x) for x in found)), kinds)], ["part", "place", "host", "first", "last", "lines"])


def _beside(edges: list[dict]) -> dict[int, list]:
    """Of each partition: the nearest pages (host, path, lines) before and after it that are no copies of its first and last."""
    same = lambda a, b: (a["host"], a["lines"]) == (b["host"], b["lines"])
    out: dict[int, list] = {x["part"]: [None, None] for x in edges}
    for side, name, order in ((0, "last", edges), (1, "first", edges[::-1])):
        before, other = None, None
        for x in order:
            other = other if before is None or same(before, x) else before
            if before is None or before["part"] != x["part"]:
                out[x["part"]][side] = other and (other["host"], other[name], other["lines"])
            before = x
    return out


def _differencer(n_keep: int, beside):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = lambda x: x and (x[0], x[1], _lines(x[2]))
        before, after = map(edge, beside.value.get(TaskContext.get().partitionId(), (None, None)))
        #: The run of copies at hand: host, packed lines, lines; and its pages' columns and paths. Empty pages are passed over.
        now, held = None, []
        done: list[tuple[tuple, str]] = []

        def end_run(after) -> None:
            sides = [x for x in (before, after) if x and x[0] == now[0]]
            texts: dict[int, str] = {}
            for keys, path in held:
                near = max(range(len(sides)), key=lambda k: len(commonprefix([sides[k][1], path])), default=-1)
                if near not in texts:
                    texts[near] = main_text(now[2], sides[near][2] if sides else None)
                done.append((keys, texts[near]))

        schema = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*(batch.column(i) for i in range(batch.num_columns))):
                *keys, host, path, packed = (x.as_py() for x in row)
                if not packed:
                    done.append((keys, ""))
                elif now and now[:2] == (host, packed):
                    held.append((keys, path))
                else:
                    lines = _lines(packed)
                    if now:
                        end_run((host, path, lines))
                        before = (now[0], held[-1][1], now[2])
                    now, held = (host, packed, lines), [(keys, path)]
            yield batch_of(done, schema)
        if now:
            end_run(after)
            yield batch_of(done, schema)

    def batch_of(done, schema) -> pa.RecordBatch:
        columns = [pa.array([row[i] for row, _ in done], schema.field(i).type) for i in range(n_keep)]
        columns.append(pa.array([t for _, t in done], pa.string()))
        done.clear()
        return pa.RecordBatch.from_arrays(columns, [*(f"k{i}" for i in range(n_keep)), "text"])

    return run


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
