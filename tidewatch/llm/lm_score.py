"""Language-model scoring by cross-entropy difference.

Two word-bigram models, of the target texts and of all texts as the background, are counted over the whole corpus with
the same words and the same smoothing. The score of a text is the mean over its words of -log p_target + log p_background:
below zero where it reads more like the target. A text is scored by models that leave it out: its own counts are taken
off those of the background and, if it is of the target, of the target. Copies of it stay in.

Words and pairs are counted by their 64-bit hashes, each for itself, in a table that is spread over the cluster and grows
with the corpus; a word's count as a context is its count less that of the texts it ends. Texts are packed into slices of
SLICE bytes; a slice posts each of its distinct n-grams once, with its counts, to one of the buckets that the hashes are
cut into; a bucket adds up the counts and answers every slice for what it posted; a slice scores its texts by the answers.
Nothing is broadcast. The number of buckets grows with the corpus, so that a bucket's n-grams fit in memory. The uniform
distribution is over 2^bits words, a constant of the smoothing that bounds no table.

Null, empty and wordless texts score 0. Texts that share an id are counted and scored each. Without any target text the
target model is uniform over its smoothing, for all alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import packed as squeezed
from tidewatch.llm.common import lean, saved, ship, table, unpacked

BITS = 20
#: Pseudo-counts of the uniform distribution in the word model, and of the word model in the pair model.
UNIFORM, WORD = 0.5, 2.0
#: Bytes of text in a slice; the least number of buckets, and the bytes of text for each beyond it.
SLICE, LEAST, PER_BUCKET = 4 << 20, 1024, 8 << 20
_LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 0 for c in range(256)], np.uint8)
#: Of the words' hashes, sums of CODES[byte] * BASE^place modulo 2^64.
_CODES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 64, 256, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64; those made before are kept, up to a slice's."""
    have = _powers.get(base)
    if have is None or len(have) < count:
        have = np.full(max(count, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if count <= 2 * SLICE:
            _powers[base] = have
    return have[:count]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, 0 where no word is; where the words begin and end; and the numbers of words."""
    body = _LETTERS[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    inside = np.concatenate([[False], body != 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return body, edges[::2], edges[1::2], np.diff(np.searchsorted(edges[::2], ends), prepend=0)


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes (2, words) of all words in turn and of their pairs with the word before (a text begins with word 0); where texts begin; the numbers of words."""
    body, first, last, sizes = words_of(texts)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[body] * powers(_BASE, len(body)), dtype=np.uint64)])
    word = mixed((sums[last] - sums[first]) * powers(pow(_BASE, -1, 1 << 64), len(body) + 1)[first])
    starts = np.zeros(len(word), bool)
    starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    before = np.where(starts, np.uint64(0), np.roll(word, 1))
    pair = mixed(before * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(3)) + word
    return np.stack([mixed(word + np.uint64(1)), mixed(pair)]), starts, sizes


def gains(counts: np.ndarray, starts: np.ndarray, totals: list[tuple], bits: int) -> np.ndarray:
    """What each word adds to its text's score, by counts (background, target, and both of texts that end; words and pairs; word) and totals (words, texts; numbers, or one a word)."""
    gain = np.zeros(len(starts))
    for side, sign in ((0, 1), (1, -1)):
        words, pairs = counts[side]
        contexts = np.where(starts, totals[side][1], np.roll(words - counts[side + 2, 0], 1))
        p = (words + UNIFORM) / (totals[side][0] + UNIFORM * (1 << bits))
        gain += sign * np.log((pairs + WORD * p) / (contexts + WORD))
    return gain


def left_out(counts: np.ndarray, place: np.ndarray, starts: np.ndarray, sizes: np.ndarray, wanted: np.ndarray, totals: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple]]:
    """counts and totals of each word of a slice without its own text. place: of its n-grams among the slice's; wanted: whether a text is of the target."""
    counts = counts.copy()
    owner, last = np.repeat(np.arange(len(sizes)), sizes), np.roll(starts, -1)
    target = wanted[owner]
    most = int(place.max(initial=0)) + 1
    for kind in (0, 1):
        _, back, times = np.unique(owner * most + place[kind], return_inverse=True, return_counts=True)
        own = times[back]
        counts[0, kind] -= own
        counts[1, kind] -= np.where(target, own, 0)
    ends = place[0][last][np.cumsum(sizes > 0)[owner] - 1] == place[0] if len(owner) else np.empty(0, bool)
    counts[2, 0] -= ends
    counts[3, 0] -= ends & target
    words = sizes[owner]
    return counts, [(totals[0][0] - words, totals[0][1] - 1), (totals[1][0] - np.where(target, words, 0), totals[1][1] - target)]


def means(gain: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out, some = np.zeros(len(sizes)), sizes > 0
    if some.any():
        out[some] = np.add.reduceat(gain, (np.cumsum(sizes) - sizes)[some]) / sizes[some]
    return out


def _parts(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[0])
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def _planes(numbers: np.ndarray) -> bytes:
    """Whole numbers, all lowest bytes first and as many bytes as the largest has, which compresses well."""
    numbers = numbers.astype("<u8").ravel()
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    own = np.frombuffer(planes, np.uint8, offset=1).reshape(planes[0], -1)
    out = np.zeros((own.shape[1], 8), np.uint8)
    out[:, : planes[0]] = own.T
    return out.view("<u8").ravel()


def _counts(planes: bytes) -> np.ndarray:
    return _numbers(unpacked(planes)).reshape(4, -1).astype(np.int64)


def _packer(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for id, text in zip(batch.column(0), batch.column(1)):
                    yield (text.as_py() or "").encode(), id.as_py()

        codec = pa.Codec("zstd", compression_level=3)
        for k, part in enumerate(_parts(rows())):
            texts, ids = zip(*part)
            row = ((TaskContext.get().partitionId() << 32) + k, list(ids), words_of(texts)[3].tolist(), np.array([len(t) for t in texts], "<i8").tobytes(), codec.compress(b"".join(texts), asbytes=True), sum(map(len, texts)))
            kinds = [pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], ["slice", "ids", "words", "sizes", "body", "bytes"])

    return lean(run)


def _unpacked(sizes: bytes, body: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, "<i8")).tolist()
    body = pa.decompress(body, ends[-1], "zstd", asbytes=True) if ends[-1] else b""
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def _poster(bits: int):
    def run(packed: pa.Table, hits: pa.Table) -> pa.Table:
        out = []
        for row in packed.select(["slice", "sizes", "body"]).to_pylist():
            found, starts, words = ngrams(_unpacked(row["sizes"], row["body"]))
            grams, place = np.unique(found, return_inverse=True)
            place = place.reshape(found.shape)
            hit = np.zeros(len(words), bool)
            for places in hits.column("hits").to_pylist():
                hit[places] = True
            wanted, last = np.repeat(hit, words), np.roll(starts, -1)
            counts = np.stack([np.bincount(x.ravel(), minlength=len(grams)) for x in (place, place[:, wanted], place[0, last], place[0, last & wanted])])
            cuts = np.searchsorted(grams, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            low = grams & np.uint64((1 << 64 - bits) - 1)
            # what of the slice is of the target comes back to it beside the answers
            places = np.flatnonzero(hit)
            out.append((-1 - row["slice"] % (1 << bits), row["slice"], _planes(np.append(places, len(words))), b""))
            out += [(b, row["slice"], _planes(np.diff(low[x:y], prepend=np.uint64(0))), squeezed(_planes(counts[:, x:y]))) for b, (x, y) in enumerate(zip(cuts.tolist(), [*cuts[1:].tolist(), len(grams)])) if x < y]
        columns = zip(*out) if out else [[]] * 4
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "slice", "grams", "counts"])

    return run


def _added(posts: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A bucket's n-grams (their low bits), their counts in all slices, and where each slice's posted n-grams are among them."""
    own = [np.cumsum(_numbers(x.as_py()), dtype=np.uint64) for x in posts.column("grams")]
    grams, place = np.unique(np.concatenate(own), return_inverse=True)
    counts = np.concatenate([_counts(x.as_py()) for x in posts.column("counts")], axis=1)
    total = np.zeros((4, len(grams)), np.int64)
    for side in range(4):
        np.add.at(total[side], place, counts[side])
    return grams, total, np.split(place, np.cumsum([len(x) for x in own])[:-1])


def _answers(posts: pa.Table) -> pa.Table:
    if posts.num_rows and posts.column("bucket")[0].as_py() < 0:
        return pa.table({"slice": posts.column("slice"), "bucket": posts.column("bucket"), "counts": posts.column("grams")})
    _, total, places = _added(posts)
    return pa.table({"slice": posts.column("slice"), "bucket": posts.column("bucket"), "counts": pa.array([squeezed(_planes(total[:, p])) for p in places], pa.binary())})


def _adder(bits: int):
    def run(posts: pa.Table) -> pa.Table:
        if posts.column("bucket")[0].as_py() < 0:
            return pa.table({k: pa.array([], pa.int64()) for k in ("gram", "c0", "c1", "c2", "c3")})
        grams, total, _ = _added(posts)
        grams = grams | np.uint64(posts.column("bucket")[0].as_py()) << np.uint64(64 - bits)
        return pa.table({"gram": grams.view(np.int64), **{f"c{k}": c for k, c in enumerate(total)}})

    return run


def _scorer(totals: list[tuple[int, int]], bits: int, kind: pa.DataType):
    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        row = packed.to_pylist()[0]
        found, starts, words = ngrams(_unpacked(row["sizes"], row["body"]))
        grams, place = np.unique(found, return_inverse=True)
        bucket, column = answers.column("bucket").to_numpy(), answers.column("counts")
        order = np.argsort(bucket)
        hit = np.zeros(len(words) + 1, bool)
        hit[_numbers(column[int(order[0])].as_py()).astype(np.int64)] = True
        order = order[bucket[order] >= 0]
        counts = np.concatenate([np.empty((4, 0), np.int64), *(_counts(column[int(k)].as_py()) for k in order)], axis=1)
        if counts.shape[1] != len(grams):
            raise ValueError(f"a slice of {len(grams)} n-grams got {counts.shape[1]} answers")
        place = place.reshape(found.shape)
        own = left_out(counts[:, place], place, starts, words, hit[:-1], totals)
        scores = means(gains(own[0], starts, own[1], bits), words)
        return pa.table({"id": pa.array(row["ids"], kind), "score": pa.array(scores, pa.float64())})

    return run


def _posted(texts: DataFrame, good: DataFrame) -> tuple[DataFrame, DataFrame, list[tuple[int, int]], int]:
    """Of rows (id, text) and the targets' distinct ids: the slices, what they post to the buckets, the numbers of words and of texts with words of both models, and the bits of a bucket."""
    spark = texts.sparkSession
    ship(spark)
    kind = texts.schema["id"].dataType.simpleString()
    packed = saved(texts.select("id", "text").mapInArrow(_packer(_kind(texts)), f"slice bigint, ids array<{kind}>, words array<bigint>, sizes binary, body binary, bytes bigint"))
    each = packed.select("slice", F.posexplode(F.arrays_zip("ids", "words")).alias("place", "of")).select("slice", "place", F.col("of.ids").alias("id"), F.col("of.words").alias("words"))
    # labels grow with the corpus, so they are merged at every size and never broadcast
    hits = each.join(good.select("id").hint("merge"), "id").groupBy("slice")
    hits = saved(hits.agg(F.collect_list("place").alias("hits"), F.sum("words").alias("words"), F.count_if(F.col("words") > 0).alias("texts")))
    size = packed.agg(F.sum("bytes")).first()[0] or 0
    count = lambda df: tuple(x or 0 for x in df.agg(F.sum("words"), F.sum("texts")).first())
    totals = [count(packed.select(F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x).alias("words"), F.size(F.filter("words", lambda x: x > 0)).alias("texts"))), count(hits)]
    bits = (max(LEAST, size // PER_BUCKET) - 1).bit_length()
    packed = packed.select("slice", "ids", "sizes", "body")
    # grouped as in scored(), so that one exchange of the slices serves both
    both = packed.groupBy("slice").cogroup(hits.select("slice", "hits").groupBy("slice"))
    posts = both.applyInArrow(_poster(bits), "bucket int, slice bigint, grams binary, counts binary")
    return packed, posts, totals, bits


def _kind(texts: DataFrame) -> pa.DataType:
    return pa.string() if texts.schema["id"].dataType.simpleString() == "string" else pa.int64()


def scored(texts: DataFrame, good: DataFrame, bits: int = BITS) -> DataFrame:
    """(id, score) of rows (id: bigint or string, text) under models counted from the other rows; the target texts are those whose id is in good (id), each once.

    The score is each text's cross-entropy under the target model less that under the background model, in nats a word.
    """
    packed, posts, totals, _ = _posted(texts, good)
    answers = posts.groupBy("bucket").applyInArrow(_answers, "slice bigint, bucket int, counts binary")
    kind = texts.schema["id"].dataType.simpleString()
    return packed.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_scorer(totals, bits, _kind(texts)), f"id {kind}, score double")


class Model:
    """Both models' counts by n-gram, and the numbers of words and texts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, totals: list[tuple[int, int]], bits: int):
        self.bits, self.totals = bits, totals
        order = np.argsort(grams)
        self.grams, self.counts = grams[order], counts[:, order]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        found, starts, words = ngrams([(t or "").encode() for t in texts])
        counts = np.zeros((4, *found.shape))
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
            counts = np.where(self.grams[at] == found, self.counts[:, at], 0)
        return means(gains(counts, starts, self.totals, self.bits), words)


def fit(texts: DataFrame, bits: int = BITS) -> Model:
    """Models counted from rows (text, target: boolean), to score other texts by; the driver holds every n-gram's counts."""
    good = texts.sparkSession.range(1, 2)
    _, posts, totals, cut = _posted(texts.select(F.col("target").cast("long").alias("id"), "text"), good)
    rows = posts.groupBy("bucket").applyInArrow(_adder(cut), "gram bigint, c0 bigint, c1 bigint, c2 bigint, c3 bigint").toArrow()
    gram, *counts = (c.to_numpy() for c in rows.columns)
    return Model(gram.view(np.uint64), np.stack(counts), totals, bits)


def score(spark: SparkSession, text: Column, model: Model) -> Column:
    """double: each text's cross-entropy under the target model less that under the background model, in nats a word."""
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    @lean
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = _parts((t.as_py() or "",) for t in texts)
            yield pa.array(np.concatenate([np.empty(0), *(sent.value.scores([t for (t,) in part]) for part in parts)]))

    return run(text)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents that are labelled of quality 1."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    return scored(docs, good).select(F.col("id").alias("doc_id"), F.col("score").alias("ce_diff"))
