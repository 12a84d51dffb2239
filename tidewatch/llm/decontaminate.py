"""Benchmark decontamination: exact containment of item windows, found by a prefix-filtered join.

A window is SIZE consecutive words of an item (all words of a shorter one). It must be contained whole, so one of its
shingles, any one, must be: the prefix of the filter is a single shingle, and the rarest in the corpus is taken. Shingles
of the documents are joined with those prefix shingles; the shingle's place in the window gives the one place where the
window can lie, which must be inside the document (length and positional bounds), and there it is compared word by word.

The benchmark is taken in blocks of at most BLOCK bytes, each of which is broadcast and held against all documents, so
memory stays bounded however long the benchmark grows. Documents are never shuffled.

Null and wordless texts have no words, hits or items. Null or wordless items have no window, items without an id aren't
counted; equal item ids count once. Repeated documents are each judged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import dropped, lean, saved, ship, table

SIZE, SHINGLE = 13, 4
#: Bytes of item text in a block, and of document text that is worked on at once.
BLOCK, SLICE = 16 << 20, 4 << 20
FOUND = "struct<n_words: bigint, spans: array<struct<start: int, end: int>>, items: array<bigint>>"
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased."""
    return text.encode().translate(_LETTERS).split() if text else []


class Index:
    """The windows of a block of items, with the shingles to find them by."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], size: int = SIZE):
        self.vocab: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], int] = {}
        owners: list[set[int]] = []
        for item, words in items:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab)) for w in words)
            for k in range(max(1, len(ids) - size + 1) if ids else 0):
                w = seen.setdefault(ids[k : k + size], len(seen))
                if w == len(owners):
                    owners.append(set())
                owners[w].add(item)
        self.owners = [sorted(i for i in x if i is not None) for x in owners]
        self.lengths = np.array([len(w) for w in seen], np.int64)
        self.windows = np.full((len(seen), size), -2, np.int64)
        for w, ids in zip(range(len(seen)), seen):
            self.windows[w, : len(ids)] = ids
        #: By shingle length: the sorted keys, and for each window's shingles the index of the key.
        self.keys = {}
        for n in {min(SHINGLE, int(x)) for x in self.lengths}:
            rows = np.flatnonzero(np.minimum(self.lengths, SHINGLE) == n)
            all_keys = np.concatenate([shingles(self.windows[r, : self.lengths[r]], n) for r in rows])
            self.keys[n] = np.unique(all_keys)
        self.prefix: dict[int, tuple] = {}

    def count(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """How often each shingle stands in these words."""
        return {n: np.bincount(self.match(ids, n, keys)[1], minlength=len(keys)) for n, keys in self.keys.items()}

    @staticmethod
    def match(ids: np.ndarray, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, key indices) of the shingles of n words that have one of the keys."""
        if len(ids) < n or not len(keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = ids >= 0
        whole = known[: len(ids) - n + 1].copy()
        for k in range(1, n):
            whole &= known[k : len(ids) - n + 1 + k]
        at = np.flatnonzero(whole)
        key = shingles(ids, n)[at]
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[k] == key
        return at[hit], k[hit]

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Take each window's rarest shingle, the first of equally rare ones, as its prefix."""
        for n, keys in self.keys.items():
            entries = defaultdict(list)
            for w in np.flatnonzero(np.minimum(self.lengths, SHINGLE) == n):
                k = np.searchsorted(keys, shingles(self.windows[w, : self.lengths[w]], n))
                place = int(np.argmin(counts[n][k]))
                entries[int(k[place])].append((int(w), place))
            used = np.array(sorted(entries), np.int64)
            starts = np.cumsum([0, *(len(entries[int(k)]) for k in used)])
            pairs = np.array([p for k in used for p in entries[int(k)]], np.int64).reshape(-1, 2)
            self.prefix[n] = keys[used], starts, pairs

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, windows) of every occurrence in these words; unknown words and borders are negative."""
        places, windows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n, (keys, starts, pairs) in self.prefix.items():
            at, k = self.match(ids, n, keys)
            times = starts[k + 1] - starts[k]
            entry = np.repeat(starts[k] - np.cumsum(times) + times, times) + np.arange(times.sum())
            w, place = pairs[entry].T
            start = np.repeat(at, times) - place
            inside = (start >= 0) & (start + self.lengths[w] <= len(ids))
            w, start = w[inside], start[inside]
            for length in np.unique(self.lengths[w]):
                of = self.lengths[w] == length
                v, s = w[of], start[of]
                same = np.ones(len(s), bool)
                for j in range(int(length)):
                    same &= ids[s + j] == self.windows[v, j]
                places.append(s[same])
                windows.append(v[same])
        return np.concatenate(places), np.concatenate(windows)


def shingles(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit keys; equal shingles have equal keys, and a key that stands for two only adds a candidate."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k].astype(np.uint64) + np.uint64(1)
    return out


def _slices(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    part, size = [], 0
    for t in texts:
        t = t.as_py()
        part.append(words_of(t))
        size += len(t) if t else 0
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def _ids(docs: list[list[bytes]], vocab: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word ids of all documents, each ended by a border; where each begins)."""
    begins = np.cumsum([0, *(len(d) + 1 for d in docs)])
    ids = np.full(begins[-1], -1, np.int64)
    for d, b in zip(docs, begins):
        ids[b : b + len(d)] = np.fromiter(map(vocab.get, d, repeat(-1)), np.int64, len(d))
    return ids, begins


def _blocks(items: DataFrame, item: str, text: str, block: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    part, size = [], 0
    for row in items.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).toLocalIterator():
        part.append((row.i, words_of(row.t)))
        size += len(row.t or "")
        if size >= block:
            yield part
            part, size = [], 0
    if part:
        yield part


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "found", size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """docs with the column out: words, the maximal runs of hit words (end exclusive) and the ids of items found."""
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    none = F.lit(None).cast(FOUND)
    done, last = docs.withColumn(out, none), None
    blocks = 0
    for part in _blocks(items, item, item_text, block):
        index = Index(part, size)
        sent = sc.broadcast(index)
        counts = {n: np.zeros(len(k), np.int64) for n, k in index.keys.items()}
        counted = docs.select(text).mapInArrow(_counter(sent), "n int, k bigint, times bigint").groupBy("n", "k").agg(F.sum("times").alias("times"))
        for row in counted.toLocalIterator():  # at most one row a shingle of the block
            counts[row.n][row.k] = row.times
        sent.destroy()
        index.choose(counts)
        if blocks:
            done, before = saved(done), last
            if before is not None:
                dropped(before)
            last = done
        blocks += 1
        done = done.withColumn(out, _finder(sc.broadcast(index))(F.col(text), F.col(out)))
    return done if blocks else done.withColumn(out, _finder(sc.broadcast(Index([], size)))(F.col(text), F.col(out)))


def _counter(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        total = {n: np.zeros(len(k), np.int64) for n, k in index.keys.items()}
        for batch in batches:
            for docs in _slices(batch.column(0)):
                for n, c in index.count(_ids(docs, index.vocab)[0]).items():
                    total[n] += c
        for n, c in total.items():
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), n, np.int32)), pa.array(k), pa.array(c[k])], ["n", "k", "times"])

    return lean(run)


def _finder(sent):
    @F.arrow_udf(FOUND)
    @lean
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        index = sent.value
        kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.int64()))])
        for texts, before in batches:
            rows, known = [], before.to_pylist()
            for docs in _slices(texts):
                ids, begins = _ids(docs, index.vocab)
                places, windows = index.find(ids)
                cover = np.zeros(len(ids) + 1, np.int32)
                np.add.at(cover, places, 1)
                np.add.at(cover, places + index.lengths[windows], -1)
                hit = np.cumsum(cover[:-1]) > 0
                owner = np.searchsorted(begins, places, side="right") - 1
                found = defaultdict(set)
                for d, w in zip(owner.tolist(), windows.tolist()):
                    found[d].update(index.owners[w])
                for d, words in enumerate(docs):
                    old = known[len(rows)]
                    if d not in found and old is not None:
                        rows.append(old)
                        continue
                    own = hit[begins[d] : begins[d] + len(words)].copy() if d in found else np.zeros(len(words), bool)
                    for s in old["spans"] if old else ():
                        own[s["start"] : s["end"]] = True
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                    items = sorted(found.get(d, set()).union(old["items"] if old else ()))
                    rows.append({"n_words": len(words), "spans": [{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()], "items": items})
            yield pa.array(rows, kind)

    return run


def n_hit(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))


def is_contaminated(found: Column) -> Column:
    """At least a twentieth of the words is hit."""
    return (n_hit(found) > 0) & (n_hit(found) * 20 >= found["n_words"])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    f = F.col("found")
    return found.select(
        "doc_id",
        f["n_words"].alias("n_words"),
        n_hit(f).alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(f["items"].cast("array<string>")), ","), 256).alias("items_sha256"),
        is_contaminated(f).alias("contaminated"),
    )
