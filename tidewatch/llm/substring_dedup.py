"""Removal of repeated substrings by blockwise suffix sorting under a cover sample.

A string of SIZE bytes is a repeat if it also starts earlier: in a row of a smaller id, or earlier in the same text. Every
byte that a repeat covers is removed; strings are judged on the input.

Full suffix arrays need several times the corpus on disk, so only suffixes that can be repeats are sorted, one bucket at
a time. The cover is a sample of text positions of which every string of SIZE bytes holds one, chosen by the string alone
(the leftmost least hash of GRAM bytes), so that two equal strings hold a sample at the same offset: the property of a
difference cover, here by content, as the two strings need not be aligned. A bucket is all suffixes whose sample has one
hash; buckets of samples that stand in one text only are dropped before any text is moved. Within a bucket the samples
are ranked by the sorted bytes that follow them, and by those that stand before them, with the lengths that neighbours
have in common; a string then needs no comparison of its own: two are equal if their samples' ranks agree over the bytes
after the sample and over those before. Why that is exact: a string's sample, and so its offset, follow from the string's
bytes alone, so equal strings lie in one bucket at one offset; there they are equal if and only if the offset's bytes
before the sample and the rest after it are, which the common lengths of neighbours in sorted order say.

Equal surroundings (by 128-bit hashes) are one row, that of their first place. A bucket of over HOT different surroundings
(the edges of a passage that very many texts hold) isn't sorted in one task: each of its strings is grouped by its own
128-bit hash, with partial minima. So memory is bounded by HOT. Repeats within one text are found in the text.

Null and empty texts have no bytes. Rows that repeat an id and its text are one document; of different texts under one id
the order is that of their hashes. A null id counts as the smallest. Texts are taken whole, as UTF-8 bytes; what is kept
may end or begin within a character, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import dropped, lean, saved, ship, table

SIZE, GRAM = 100, 32
#: Window starts of grams in a string, and positions of a text that are worked on at once.
STARTS = SIZE - GRAM + 1
SEGMENT = 1 << 20
#: Different surroundings of a bucket that are sorted in one task; surroundings that a task remembers.
HOT, SEEN = 4096, 1 << 18
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each position on."""
    x = raw.astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] | x[k:] << np.uint64(8 * k)
    x = _mix(x * _A)
    for k in (8, 16):
        x = _mix(x[:-k] * _A + x[k:] * _B)
    return x


def samples(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first start, last start) of each sample: of the strings from those starts it is the one they hold."""
    mask = np.uint64(SEGMENT * 2 - 1)
    parts = []
    for at in range(0, len(hashes) - STARTS + 1, SEGMENT):
        h = hashes[at : at + SEGMENT + STARTS - 1]
        m = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= STARTS:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        m = np.minimum(m[: len(m) - (STARTS - width)], m[STARTS - width :])
        parts.append((m & mask).astype(np.int64) + at)
    held = np.concatenate(parts)
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    return held[first], first, np.concatenate([first[1:], [len(held)]]) - 1


def own_repeats(hashes: np.ndarray, position: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The starts of strings that also start earlier in the same text."""
    of = hashes[position]
    _, back, times = np.unique(of, return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[back] > 1)
    if not len(some):
        return some
    count = last[some] - first[some] + 1
    starts = np.repeat(first[some] - np.cumsum(count) + count, count) + np.arange(count.sum())
    whole = np.zeros(len(starts), np.uint64)
    for k in (0, GRAM, 2 * GRAM, SIZE - GRAM):
        whole = _mix(whole * _A + hashes[starts + k])
    _, once, back = np.unique(whole, return_index=True, return_inverse=True)
    at = starts[once[back]]
    again = starts != at
    for k in (0, GRAM, 2 * GRAM, SIZE - GRAM):  # each of the grams that make up the string, not only their mixture
        again &= hashes[starts + k] == hashes[at + k]
    return starts[again]


def _active(raw: np.ndarray):
    """Samples of a text whose strings don't all start earlier in it, their hashes, and the starts of those that do."""
    hashes = gram_hashes(raw)
    position, first, last = samples(hashes)
    again = own_repeats(hashes, position, first, last)
    if len(again):
        seen = np.zeros(last[-1] + 2, np.int64)
        seen[again + 1] = 1
        seen = np.cumsum(seen)
        new = seen[last + 1] - seen[first] < last - first + 1
        position, first, last = position[new], first[new], last[new]
    return hashes[position].view(np.int64), position, first, last, again


def _raw(value: pa.Scalar) -> np.ndarray:
    b = value.as_buffer()
    return np.frombuffer(b, np.uint8) if b is not None else np.empty(0, np.uint8)


def _hasher():
    """(bucket, doc) of each text's samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, marks = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for d, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = _raw(v)
                if len(raw) >= SIZE:
                    marks.append(np.unique(_active(raw)[0]))
                    docs.append(np.full(len(marks[-1]), d))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(marks)), pa.array(np.concatenate(docs))], ["bucket", "doc"])

    return lean(run)


def _surroundings():
    """The samples of each text that another text has, too; the bytes round them where none before of a task's equal ones is at an earlier place."""
    names = ["bucket", "same", "id", "version", "place", "low", "high", "bytes"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def record(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = [], {}
        for batch in batches:
            for i, version, v, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                raw = _raw(v)
                if len(raw) < SIZE:
                    continue
                bucket, position, first, last, _ = _active(raw)
                some = np.flatnonzero(np.isin(bucket, wanted.values.to_numpy()))
                data = raw.tobytes()
                for b, p, f, e in zip(bucket[some].tolist(), position[some].tolist(), first[some].tolist(), last[some].tolist()):
                    near = data[f : e + SIZE]
                    same = xxhash.xxh3_128_digest(near, seed=p - f + 1)
                    earlier = same in seen and seen[same] <= (i, version, p)
                    out.append((b, same, i, version, p, p - e, p - f, None if earlier else near))
                    if not earlier:
                        seen[same] = (i, version, p)
                if len(seen) > SEEN:
                    seen.clear()
                if len(out) > 20_000:
                    yield record(out)
                    out = []
        yield record(out)

    return lean(run)


def _windows():
    """(bucket, same, offset, window) of each string of these surroundings: a hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = []
                for b, same, low, high, near in zip(*(c.to_pylist() for c in part.columns)):
                    out += [(b, same, o, xxhash.xxh3_128_digest(near[high - o : high - o + SIZE])) for o in range(low, high + 1)]
                columns = zip(*out) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.binary()))], ["bucket", "same", "offset", "window"])

    return lean(run)


def _common(order: np.ndarray, group: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How many bytes each row has in common with the one before it in this order; none across groups."""
    a, b = order[1:], order[:-1]
    differ = text[a] != text[b]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), text.shape[1])
    return np.concatenate([[0], np.where(group[a] == group[b], n, 0)])


def resolve(group: np.ndarray, rank: np.ndarray, low: np.ndarray, high: np.ndarray, near: list[bytes]) -> np.ndarray:
    """For each surroundings (row) and offset of the sample (column): whether a row of its group with a lower rank has that string.

    low and high: the offsets that a row has strings for; near: the bytes from the sample less high to the sample less low plus SIZE.
    """
    n = len(near)
    after, before = np.zeros((n, SIZE), np.uint8), np.zeros((n, STARTS), np.uint8)
    for i, (x, h) in enumerate(zip(near, high.tolist())):
        b = np.frombuffer(x, np.uint8)
        before[i, :h] = b[:h][::-1]
        after[i, : min(SIZE, len(b) - h)] = b[h : h + SIZE]
    classes = []
    for text in (after, before):
        order = np.lexsort((np.ascontiguousarray(text).view(f"S{text.shape[1]}").ravel(), group))
        classes.append((order, _common(order, group, text)))
    repeat = np.zeros((n, STARTS), bool)
    for offset in range(STARTS):
        has = np.flatnonzero((low <= offset) & (offset <= high))
        if len(has) < 2:
            continue
        named = []
        for (order, common), size in zip(classes, (SIZE - offset, offset)):
            name = np.empty(n, np.int64)
            fresh = common < size
            fresh[1:] |= group[order[1:]] != group[order[:-1]]
            name[order] = np.cumsum(fresh)
            named.append(name[has])
        key = named[0] * (n + 1) + named[1]
        order = np.lexsort((rank[has], key))
        again = np.concatenate([[False], key[order[1:]] == key[order[:-1]]])
        repeat[has[order[again]], offset] = True
    return repeat


def _resolver():
    def groups(part: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket = part.column("bucket").to_numpy()
        group = np.cumsum(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        several = np.flatnonzero(np.bincount(group)[group] > 1)
        runs: list[list[int]] = [[] for _ in range(len(group))]
        if len(several):
            some = part.take(pa.array(several))
            rank = np.empty(len(several), np.int64)
            rank[np.lexsort(tuple(some.column(k).to_numpy() for k in ("place", "version", "id")))] = np.arange(len(several))
            repeat = resolve(group[several], rank, some.column("low").to_numpy(), some.column("high").to_numpy(), some.column("bytes").to_pylist())
            edges = np.diff(np.pad(repeat, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            for row, at in zip(*np.nonzero(edges)):
                runs[several[row]].append(int(at))
        columns = [part.column(k).combine_chunks() for k in ("bucket", "same", "id", "version", "place")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(runs, pa.list_(pa.int32()))], ["bucket", "same", "own", "own_version", "own_place", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = pa.concat_tables([held, part]) if held is not None else part
            bucket = part.column("bucket").to_numpy()
            cut = np.flatnonzero(bucket[1:] != bucket[:-1])
            end = int(cut[-1]) + 1 if len(cut) else 0
            held = part.slice(end)
            if end:
                yield from groups(part.slice(0, end))
        if held is not None and held.num_rows:
            yield from groups(held)

    return lean(run)


def _cutter():
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                spans, kept = [], []
                for v, found in zip(part.column(0), part.column(2).to_pylist()):
                    raw = _raw(v)
                    cover = np.zeros(len(raw) + 1, np.int64)
                    if len(raw) >= SIZE:
                        again = _active(raw)[4]
                        cover[again] += 1
                        cover[again + SIZE] -= 1
                    for x in found or ():
                        cover[x["start"]] += 1
                        cover[x["end"]] -= 1
                    hit = np.cumsum(cover[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2)
                    spans.append([{"start": s, "end": e} for s, e in edge.tolist()])
                    kept.append(raw[~hit].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(0), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "raw", "removed", "kept"])

    return lean(run)


def _wanted(rows: DataFrame) -> DataFrame:
    """(doc, wanted): the buckets of each text's samples that another text has, too."""
    marks = saved(rows.select("doc", "raw").mapInArrow(_hasher(), "bucket bigint, doc bigint"))
    several = marks.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    wanted = saved(marks.join(several, "bucket").groupBy("doc").agg(F.collect_list("bucket").alias("wanted")))
    dropped(marks)
    return wanted


def _sorted(near: DataFrame) -> DataFrame:
    """(bucket, same, own, own_version, own_place, runs): where surroundings stand first, and which of their strings other ones have before."""
    # Equal surroundings are summed up behind the shuffle, where a bucket already lies together.
    once = near.where("bytes is not null").repartition("bucket").groupBy("bucket", "same")
    once = once.agg(F.min(F.struct("id", "version", "place")).alias("least"), *(F.first(c).alias(c) for c in ("low", "high", "bytes")))
    once = once.select("same", "bucket", "least.*", "low", "high", "bytes").sortWithinPartitions("bucket")
    return once.mapInArrow(_resolver(), "bucket bigint, same binary, own bigint, own_version bigint, own_place bigint, runs array<int>")


def _grouped(near: DataFrame) -> DataFrame:
    """The same, for buckets of very many surroundings: their strings, each grouped by its hash."""
    once = near.where("bytes is not null").groupBy("bucket", "same")
    once = once.agg(F.min(F.struct("id", "version", "place")).alias("least"), *(F.first(c).alias(c) for c in ("low", "high", "bytes")))
    once = saved(once)
    strings = once.select("bucket", "same", "low", "high", "bytes").mapInArrow(_windows(), "bucket bigint, same binary, offset int, window binary")
    strings = saved(strings.join(once.select("bucket", "same", "least"), ["bucket", "same"]))
    firsts = saved(strings.groupBy("window").agg(F.min("least").alias("first")))
    again = strings.join(firsts, "window").where("least <> first").groupBy("bucket", "same").agg(F.array_sort(F.collect_list("offset")).alias("at"))
    found = once.select("bucket", "same", "least").join(again, ["bucket", "same"], "left")
    at = F.coalesce("at", F.array().cast("array<int>"))
    begins, ends = F.filter(at, lambda o: ~F.array_contains(at, o - 1)), F.filter(at, lambda o: ~F.array_contains(at, o + 1))
    runs = F.array_sort(F.concat(begins, F.transform(ends, lambda o: o + 1)))
    own = [F.col(f"least.{c}").alias(a) for c, a in (("id", "own"), ("version", "own_version"), ("place", "own_place"))]
    found = saved(found.select("bucket", "same", *own, runs.alias("runs")))
    dropped(once, strings, firsts)
    return found


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, raw, removed, kept) of every row: its bytes, the maximal runs removed of them, and the rest."""
    spark = docs.sparkSession
    ship(spark)
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(id).cast("long").alias("doc_id"), raw.alias("raw"))
    rows = rows.withColumn("version", F.xxhash64("raw")).withColumn("doc", F.xxhash64("id", "version"))
    wanted = _wanted(rows)
    texts = rows.select("doc", "id", "version", "raw").join(wanted, "doc").select("id", "version", "raw", "wanted")
    near = saved(texts.mapInArrow(_surroundings(), "bucket bigint, same binary, id bigint, version bigint, place bigint, low int, high int, bytes binary"))
    dropped(wanted)
    sizes = near.where("bytes is not null").select("bucket", "same").distinct().groupBy("bucket").count()
    large = saved(sizes.where(F.col("count") > hot).select("bucket"))
    if large.isEmpty():
        parts = [saved(_sorted(near))]
    else:
        parts = [saved(_sorted(near.join(large, "bucket", "left_anti"))), _grouped(near.join(large, "bucket", "left_semi"))]
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    found = near.select("bucket", "same", "id", "version", "place", "low", "high").join(found, ["bucket", "same"])
    first = (F.col("id") == F.col("own")) & (F.col("version") == F.col("own_version")) & (F.col("place") == F.col("own_place"))
    runs = F.when(first, F.col("runs")).otherwise(F.array(F.col("low"), F.col("high") + 1))
    # runs: offsets at which repeats begin and end, by turns; the string at an offset starts so much before the sample
    found = found.withColumn("runs", runs).where(F.size("runs") > 0)
    found = found.select("id", "version", "place", "runs", F.explode(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2))).alias("k"))
    span = F.struct((F.col("place") - F.get("runs", F.col("k") + 1) + 1).alias("start"), (F.col("place") - F.get("runs", F.col("k")) + SIZE).alias("end"))
    spans = saved(found.groupBy("id", "version").agg(F.collect_list(span).alias("found")))
    dropped(near, large, *parts)
    done = rows.join(spans, ["id", "version"], "left").select("raw", "doc_id", "found")
    return done.mapInArrow(_cutter(), "doc_id bigint, raw binary, removed array<struct<start: bigint, end: bigint>>, kept binary")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.octet_length("raw") - F.octet_length("kept")
    return cut.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), removed.cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
