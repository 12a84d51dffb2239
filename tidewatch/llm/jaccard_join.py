"""N-gram Jaccard join: documents whose sets of word shingles are alike, by rare-first prefix filtering.

1. How often shingles occur is counted over all documents, in a table of hashed slots.
2. Each set is ordered by that count, rarest first; two sets that are alike share a shingle among the first n - ceil(t n) + 1
   of each, the prefix. Equal sets are one class with one prefix, so copies are never paired.
3. Classes meet in the shingles of their prefixes. First only neighbours in each shingle's list, ordered by size, are
   candidates; what they link is joined to components. Then come each class with the one of its list that has the fewest
   rarer shingles, and neighbours in an order by chance, where they lie in different components; and last all pairs that
   meet and still lie in different ones. So a crowd of near copies, which are most like the text they were made from,
   gives about as many candidates as members, and yet no link between components is lost.
4. Candidates pass the length filter, the positional filter (the places of a shared shingle bound the overlap) and the
   suffix filter (the sets' numbers of shingles in each range of hashes bound it too), and are verified once each on the
   whole sets. For that the compressed texts of the classes in candidates are brought together, which are smaller than
   their sets, and their sets are made again there.

Shingles are told apart by 64-bit hashes, classes by 128-bit ones; lists and candidates name a class by the first half of
its hash, so that two classes that share it only add a candidate. Words are what stands between ASCII white space, A-Z
lower-cased. A text of fewer words than a shingle is one shingle; null, empty and wordless texts have none and link with
nothing, nor do rows without an id. Rows that repeat an id are copies if their sets are equal, else like any two rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import components, dropped, lean, packed, saved, ship, table, unpacked

WORDS, PERCENT = 5, 75
#: The table of counts has 2^BITS slots of a byte, 4 MB, in steps of an eighth of a power of two: it tells shingles that
#: many texts share from others. It only orders shingles; a coarser order gives more candidates and the same links. Slots are
#: added up in chunks of CHUNK.
BITS, CHUNK = 22, 1 << 14
#: Ranges of hashes of the suffix filter, and what a full one shows.
RANGES, FULL = 128, 127
#: Bits of the filter of ids whose texts are needed, 4 MB. Where that many ids are needed that it lets all through, a round
#: of verification shuffles every text once, compressed.
FILTER = 25
#: How often classes are compared in another order before all pairs that are left.
ROUNDS = 2
#: How many of a class's first open shingles a row carries.
EARLY = 8
#: Characters of text that are worked on at once.
SLICE = 1 << 20
#: Classes that a task remembers, so as to post each prefix once.
SEEN = 1 << 18
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


_LETTER = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _base(n: int) -> list[np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    out = []
    for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of all texts in turn, and how many each text has."""
    raw = [b"" if not t else t.encode().translate(_LOWER) for t in texts]
    joined = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(joined):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    blank = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]  # the last byte is blank, so every word ends
    power, inverse = _base(len(joined) + 1)
    sums = np.cumsum(_LETTER[joined] * power[:-1], dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), sums])
    hashes = _mix((sums[end] - sums[start]) * inverse[start])
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return hashes, np.diff(np.searchsorted(start, begins))


def shingle_sets(texts: list[str | None], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owners): the distinct shingles of all texts, ordered by text and then by hash."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    total = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for k in range(size):
        total = (total ^ (total >> np.uint64(31))) * _ODD[k % 5] + words[k : len(words) - size + 1 + k]
    whole = owner[size - 1 :] == owner[: len(total)] if len(total) else np.empty(0, bool)
    hashes, owners = [_mix(total[whole])], [owner[: len(total)][whole]]
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        h = np.full(1, counts[d], np.uint64)
        for w in words[ends[d] - counts[d] : ends[d]]:
            h = _mix(h * _ODD[0] + w)
        hashes.append(h)
        owners.append(np.full(1, d))
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[new], owners[new]


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of parts of about SLICE characters."""
    part, size, first = [], 0, 0
    for i, t in enumerate(texts):
        t = t.as_py()
        part.append(t)
        size += len(t) if t else 0
        if size >= SLICE:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


def class_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def prefixes(hashes: np.ndarray, owners: np.ndarray, n: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, lengths): each set's rarest shingles of which sets alike must share one, rarest first; ties by hash."""
    bits = len(counts).bit_length() - 1
    order = np.lexsort((hashes, counts[(hashes >> np.uint64(64 - bits)).astype(np.int64)], owners))
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)
    length = np.where(n > 0, n + -(percent * n // 100) - (percent * n % 100 > 0) + 1, 0)
    return hashes[order][place < np.repeat(length, n)], length


def _counter(bits: int, size: int):
    """(chunk, counts) of the shingles of a task's texts, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                slots, times = np.unique(shingle_sets(texts, size)[0] >> np.uint64(64 - bits), return_counts=True)
                total[slots.astype(np.int64)] += times.astype(np.uint32)
        if total.any():
            chunks = [packed(x.tobytes()) for x in total.reshape(-1, min(CHUNK, len(total)))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(chunks))), pa.array(chunks, pa.binary())], ["chunk", "counts"])

    return lean(run)


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, ranks): the sums of a partition's chunks in steps of an eighth of a power of two."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.frombuffer(unpacked(counts.as_py()), np.uint32)
            total[chunk] = total[chunk] + own if chunk in total else own.astype(np.uint64)
    ranks = [np.minimum(8 * np.log2(x + 1.0), 255).astype(np.uint8).tobytes() for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(ranks, pa.binary())], ["chunk", "ranks"])


def shingle_ranks(texts: DataFrame, size: int = WORDS, bits: int = BITS) -> np.ndarray:
    """How frequent the shingles of each slot are, over all rows of the one column."""
    chunks = texts.mapInArrow(_counter(bits, size), "chunk bigint, counts binary").repartition("chunk").mapInArrow(lean(_adder), "chunk bigint, ranks binary")
    out = np.zeros((-(-(1 << bits) // CHUNK), min(CHUNK, 1 << bits)), np.uint8)
    for chunk, ranks in zip(*(c.to_pylist() for c in chunks.toArrow().columns)):
        out[chunk] = np.frombuffer(ranks, np.uint8)
    return out.ravel()


def _classes(n: np.ndarray, hashes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(n)
    return [class_of(hashes[e - k : e]) for k, e in zip(n.tolist(), ends.tolist())]


def _key(name: str) -> Column:
    """The first half of a class as a number."""
    return F.conv(F.hex(F.substring(name, 1, 8)), 16, -10).cast("long")


def _describer(size: int):
    """(id, version, n, class, ranges) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _slices(batch.column(2)):
                hashes, owners = shingle_sets(texts, size)
                n = np.bincount(owners, minlength=len(texts))
                ranges = np.bincount(owners * RANGES + (hashes >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64), minlength=len(texts) * RANGES)
                ranges = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * RANGES), pa.array(np.minimum(ranges, FULL).astype(np.int8)))
                columns = [*(c.slice(first, len(texts)) for c in batch.columns[:2]), pa.array(n.astype(np.int32)), pa.array(_classes(n, hashes), pa.binary()), ranges]
                yield pa.RecordBatch.from_arrays(columns, ["id", "version", "n", "class", "ranges"])

    return lean(run)


def _prefixer(counts, size: int, percent: int):
    """(shingle, key, at) of each prefix; of the same class in a task only once. at: the set's size, and the place in 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                hashes, owners = shingle_sets(texts, size)
                n = np.bincount(owners, minlength=len(texts))
                prefix, length = prefixes(hashes, owners, n, counts.value, percent)
                classes = _classes(n, hashes)
                new = np.zeros(len(texts), bool)
                for k, c in enumerate(classes):
                    if n[k] and c not in seen:
                        new[k] = True
                        seen.add(c)
                if len(seen) > SEEN:
                    seen.clear()
                keys = np.frombuffer(b"".join(classes), ">i8")[::2].astype(np.int64)
                of = np.repeat(np.arange(len(texts)), length)
                place = np.arange(len(prefix)) - np.repeat(np.cumsum(length) - length, length)
                some = new[of]
                columns = [prefix.view(np.int64)[some], keys[of][some], ((n[of] << 32) + place)[some]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "key", "at"])

    return lean(run)


def _holds(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _texter(wanted, size: int):
    """(key, text) of the rows that the filter of ids lets through, their texts compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            at = batch.column(1).to_numpy()
            texts = batch.column(0).filter(pa.array(_holds(bits, at)))
            for _, part in _slices(texts):
                hashes, owners = shingle_sets(part, size)
                n = np.bincount(owners, minlength=len(part))
                keys = [int.from_bytes(c[:8], signed=True) for c in _classes(n, hashes)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([packed((t or "").encode()) for t in part], pa.binary())], ["key", "text"])

    return lean(run)


def _verifier(size: int, percent: int):
    """(a, b): the classes of the pairs of compressed texts whose sets are alike."""

    def linked(part: list[tuple[bytes, bytes]]) -> Iterator[tuple[bytes, bytes]]:
        where: dict[bytes, int] = {}
        for pair in part:
            for x in pair:
                where.setdefault(x, len(where))
        hashes, owners = shingle_sets([unpacked(x).decode() for x in where], size)
        n = np.bincount(owners, minlength=len(where))
        ends = np.cumsum(n)
        classes = _classes(n, hashes)
        for a, b in part:
            i, j = where[a], where[b]
            same = len(np.intersect1d(hashes[ends[i] - n[i] : ends[i]], hashes[ends[j] - n[j] : ends[j]], assume_unique=True))
            if classes[i] != classes[j] and _enough(int(n[i]), int(n[j]), same, percent):
                yield min(classes[i], classes[j]), max(classes[i], classes[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, weight, out = [], 0, []
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                part.append((a, b))
                weight += int.from_bytes(a[:8]) + int.from_bytes(b[:8])
                if weight >= SLICE:
                    out += linked(part)
                    part, weight = [], 0
            if part:
                out += linked(part)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (zip(*out) if out else ((), ()))], ["a", "b"])

    return lean(run)


def _met(rows: DataFrame, counts, size: int, percent: int) -> DataFrame:
    """(shingle, key, n, place, key0, n0, place0): classes in the lists of their prefixes' shingles, where another of a
    fitting size stands, with the one before in order of size if that fits. A class comes once in a list, however many copies."""
    # by size and then by class alone, so that a crowd's members have the same neighbours in most of the lists they share
    list_ = Window.partitionBy("shingle").orderBy(F.shiftright("at", 32), "key")
    met = rows.select("text").mapInArrow(_prefixer(counts, size, percent), "shingle bigint, key bigint, at bigint")
    met = met.withColumn("before", F.lag(F.struct("at", "key")).over(list_)).where("before is null or before <> struct(at, key)")
    met = met.withColumns({"before": F.lag(F.struct("key", "at")).over(list_), "after": F.lead("at").over(list_)})
    met = met.select("shingle", "key", *_unpacked("at", "n", "place"), F.col("before.key").alias("key0"), *_unpacked("before.at", "n0", "place0"), F.shiftright("after", 32).alias("n1"))
    follows, leads = 100 * F.col("n0") >= percent * F.col("n"), 100 * F.col("n") >= percent * F.col("n1")
    met = met.where(F.coalesce(follows, F.lit(False)) | F.coalesce(leads, F.lit(False))).drop("n1")
    return met.withColumns({c: F.when(follows, F.col(c)) for c in ("key0", "n0", "place0")})


def _open_lists(met: DataFrame, joined: DataFrame) -> DataFrame:
    """(shingle, key, n, place, component) of the lists whose classes lie in several components."""
    of = joined.select(_key("node").alias("key"), _key("component").alias("component"))
    known = met.select("shingle", "key", "n", "place").join(of, "key", "left")
    whole = Window.partitionBy("shingle")
    known = known.withColumn("component", F.coalesce("component", "key"))
    known = known.withColumns({"low": F.min("component").over(whole), "high": F.max("component").over(whole)})
    return known.where("low < high").drop("low", "high")


def _id_bits(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size that lets these ids through, and others whose hashes meet one of theirs."""
    at = ids.select((F.shiftrightunsigned(F.xxhash64("id"), 64 - FILTER)).alias("h"))
    rows = at.groupBy(F.expr("h div 32768").alias("k")).agg(F.expr("bitmap_construct_agg(h % 32768)").alias("bits")).collect()  # 4 MB at most; an iterator would take a job for each partition
    out = np.zeros(1 << FILTER - 3, np.uint8)
    for r in rows:
        out[r.k << 12 : (r.k + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    return out


def _let_through(wanted):
    """Whether a filter of ids lets these hashes through."""

    @F.arrow_udf("boolean")
    def let(h: pa.Array) -> pa.Array:
        return pa.array(_holds(wanted.value, h.to_numpy()))

    return let


def _unpacked(at: str, n: str, place: str) -> tuple[Column, Column]:
    return F.shiftright(at, 32).cast("int").alias(n), F.col(at).bitwiseAND(0x7FFFFFFF).cast("int").alias(place)


def _enough(n1, n2, overlap, percent: int):
    """Whether such an overlap of sets of these sizes can reach the threshold."""
    return overlap * (100 + percent) >= percent * (n1 + n2)


def _filtered(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass the suffix filter."""
    for s in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("key").alias(s), F.col("n").alias(f"n{s}"), F.col("ranges").alias(f"r{s}")), s)
    # a full range may hold any number
    least = F.zip_with("ra", "rb", lambda x, y: F.when((x == FULL) & (y == FULL), 1 << 30).otherwise(F.least(x, y)).cast("long"))
    most = F.aggregate(least, F.lit(0).cast("long"), lambda x, y: x + y)
    return pairs.where(_enough(F.col("na"), F.col("nb"), most, percent)).select("a", "b").distinct()


def jaccard_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, version, n_shingles, component_id, class_id, first) of every row.

    That is: a hash of its text, its set's size, the smallest id it is linked with and that of its copies, and whether it is
    the first of its component, by id and version. Rows that link with nothing are.
    """
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    described = rows.select("id", F.xxhash64("text").alias("version"), "text").mapInArrow(_describer(size), "id bigint, version bigint, n int, class binary, ranges array<tinyint>")
    made = saved(described)
    able = made.where("n > 0 and id is not null")
    classes = able.groupBy("class", "n", "ranges").agg(F.min("id").alias("id"), F.min(F.struct("id", "version")).alias("least"))
    classes = saved(classes.withColumn("key", _key("class")))

    sent = sc.broadcast(shingle_ranks(rows.select("text"), size))
    met = saved(_met(rows.where("id is not null"), sent, size, percent))
    sent.destroy()
    rest = lambda n, p: n - p - 1
    bound = F.least("place", "place0") + 1 + F.least(rest(F.col("n"), F.col("place")), rest(F.col("n0"), F.col("place0")))
    first = met.where(F.col("key0").isNotNull() & _enough(F.col("n"), F.col("n0"), bound, percent))
    first = first.select(F.least("key", "key0").alias("a"), F.greatest("key", "key0").alias("b")).distinct()
    tested = [saved(_filtered(first, classes, percent))]

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among these pairs, as pairs of classes."""
        some = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        needed = sc.broadcast(_id_bits(classes.join(some, "key", "left_semi").select("id")))
        hashed = rows.where("id is not null").select("text", F.shiftrightunsigned(F.xxhash64("id"), 64 - FILTER).alias("h"))
        texts = hashed.mapInArrow(_texter(needed, size), "key bigint, text binary")
        both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
        links = saved(both.select("ta", "tb").mapInArrow(_verifier(size, percent), "a binary, b binary").distinct())
        needed.destroy()
        return links

    def untested(pairs: DataFrame) -> DataFrame:
        for t in tested:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        return saved(_filtered(pairs, classes, percent))

    def joined_by(joined: DataFrame, more: DataFrame) -> DataFrame:
        out = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        dropped(joined, more)
        return out

    links = verified(tested[0])
    joined = components(links)
    dropped(links)
    # Other orders draw nearly all of a crowd into one component at the cost of a pair a member: first each class with that
    # of its list which has the fewest rarer shingles, so fewest of its own, then neighbours by chance.
    for turn in range(ROUNDS):
        known = _open_lists(met, joined)
        if turn == 0:
            order = Window.partitionBy("shingle").orderBy("place", "key")
            other = F.first(F.struct("key", "n", "component")).over(order)
        else:
            order = Window.partitionBy("shingle").orderBy(F.xxhash64("key", F.lit(turn)))
            other = F.lag(F.struct("key", "n", "component")).over(order)
        pairs = known.withColumn("other", other).where("component <> other.component")
        pairs = pairs.where(100 * F.least("n", "other.n") >= percent * F.greatest("n", "other.n"))
        tested.append(untested(pairs.select(F.least("key", "other.key").alias("a"), F.greatest("key", "other.key").alias("b")).distinct()))
        more = verified(tested[-1])
        if more.isEmpty():
            dropped(more)
            break
        joined = joined_by(joined, more)
    # All pairs that meet in a shingle and still lie in different components.
    # A pair that meets in several lists is made in that of its first shared shingle: a row carries the class's first
    # open shingles that stand before its own, and where two rows have one of those in common, an earlier list has them.
    known = saved(_open_lists(met, joined))
    dropped(met)
    begin = known.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "shingle"))), 1, EARLY).alias("begin"))
    early = F.transform(F.filter("begin", lambda x: x["place"] < F.col("place")), lambda x: x["shingle"])
    lists = saved(known.join(begin, "key").withColumn("early", early).drop("begin"))
    dropped(known)
    other = lists.select("shingle", *(F.col(c).alias(f"{c}2") for c in ("key", "n", "place", "component", "early")))
    # Of similar sets the first shared shingle leaves room for the overlap behind it.
    bound = 1 + F.least(rest(F.col("n"), F.col("place")), rest(F.col("n2"), F.col("place2")))
    fits = _enough(F.col("n"), F.col("n2"), bound, percent) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
    pairs = lists.join(other, "shingle").where((F.col("key") < F.col("key2")) & (F.col("component") != F.col("component2")) & fits & ~F.arrays_overlap("early", "early2"))
    pairs = untested(pairs.select(F.col("key").alias("a"), F.col("key2").alias("b")).distinct())
    dropped(lists, *tested)
    if not pairs.isEmpty():
        joined = joined_by(joined, verified(pairs))
    dropped(pairs)

    named = joined.withColumnRenamed("node", "class").join(classes.select("class", "least"), "class")
    least = saved(named.groupBy("component").agg(F.min("least").alias("first")))
    named = named.join(least, "component").select("class", "first")
    firsts = classes.select("class", "n", F.col("id").alias("class_id"), "least").join(named, "class", "left")
    firsts = saved(firsts.select("class", "n", "class_id", F.coalesce("first", "least").alias("first")))
    dropped(classes, joined, least)
    out = made.select("id", "version", "n", "class").join(firsts, ["class", "n"], "left")
    linked = F.col("id").isNotNull() & (F.col("n") > 0)
    own = lambda c, name: F.when(linked, F.col(c)).otherwise(F.col("id")).alias(name)
    first = (F.when(linked, F.struct("id", "version") == F.col("first")).otherwise(True)).alias("first")
    result = saved(out.select(F.col("id").alias("doc_id"), "version", F.col("n").cast("long").alias("n_shingles"), own("first.id", "component_id"), own("class_id", "class_id"), first))
    dropped(made, firsts)
    return result


def first_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of docs for each component: that of the smallest id, and of the smallest hash of its text where texts share it.

    Rows without shingles or without an id link with nothing and all stay; of rows that repeat id and text one stays.
    """
    groups = jaccard_groups(docs, id, text, size, percent)
    linked = groups.where("n_shingles > 0 and doc_id is not null")
    gone = saved(linked.where(~F.col("first")).select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct())
    twice = saved(linked.where("first").groupBy(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).count().where("count > 1").drop("count"))
    dropped(groups)
    marked = docs.withColumns({"_id": F.col(id).cast("long"), "_version": F.xxhash64(text)})
    # Only rows whose ids the filter lets through are joined, so the texts that surely stay are not shuffled.
    needed = docs.sparkSession.sparkContext.broadcast(_id_bits(gone.unionByName(twice).select(F.col("_id").alias("id"))))
    let = _let_through(needed)(F.shiftrightunsigned(F.xxhash64("_id"), 64 - FILTER))
    left = marked.where(let).join(gone, ["_id", "_version"], "left_anti")
    if not twice.isEmpty():
        once = left.join(twice, ["_id", "_version"], "left_semi").dropDuplicates(["_id", "_version"])
        left = left.join(twice, ["_id", "_version"], "left_anti").unionByName(once)
    left = left.unionByName(marked.where(~let))
    return left.drop("_id", "_version")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents")).drop("version", "first")
