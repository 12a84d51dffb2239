"""Embedding near-duplicates by a pivot-permutation index.

Each distinct vector is described by its NEAREST reference points (pivots) in order, and posted to the inverted list of
every two of them, so that two vectors meet in a list if and only if they share at least two pivots; the number of lists
grows with the square of the pivots. Lists of one are dropped before vectors are fetched. In each list all cosines are
computed in double precision. A pair that shares more pivots meets in several lists; it is counted in that of its two
smallest shared pivots. A list leaves one row a member (its links, and the smallest member it is connected to), never its
pairs; long lists are cut into blocks that are held against each other in tasks of their own. The connected members are
joined to components.

Exact copies are one class with a multiplicity. Pivots are a bounded sample, MOST_PIVOTS at most, that keeps no two alike,
so that a crowd of near copies gets one; every vector is indexed. Recall is that of sharing two of the pivots: at a
cosine of 0.95, over 0.99 for random directions in 16 to 64 dimensions; pairs below the threshold are never linked.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link with nothing. Each
length of vectors has an index of its own. Repeated rows count as copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import components, lean, saved, ship, table

THRESHOLD, NEAREST, LEAST_PIVOTS, MOST_PIVOTS, PER_PIVOT, ALIKE = 0.95, 8, 64, 4096, 16, 0.7
#: Members of a list that are compared at once.
BLOCK = 1024


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # scaled first, so that no square overflows or vanishes
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """The first vectors of the sample of which no two are alike; where these are too few, the others after them."""
    kept, rest = [], []
    chosen = np.empty((0, sample.shape[1]))
    for v in sample:
        if len(kept) < count and (not kept or (chosen[: len(kept)] @ v).max() < ALIKE):
            kept.append(v)
            if len(kept) > len(chosen):
                chosen = np.concatenate([chosen, np.zeros((max(64, len(chosen)), sample.shape[1]))])
            chosen[len(kept) - 1] = v
        else:
            rest.append(v)
    return np.array(kept + rest[: max(0, min(count, 2 * NEAREST) - len(kept))])


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first."""
    near = vectors @ pivots.T
    k = min(NEAREST, near.shape[1])
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


def _poster(pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                own = np.sort(nearest_pivots(_matrix(part.column(1)), p), axis=1)
                pairs = list(combinations(range(own.shape[1]), 2))
                keys = np.stack([own[:, i] * MOST_PIVOTS + own[:, j] for i, j in pairs], axis=1) if pairs else own * 0
                ends = np.arange(len(own) + 1, dtype=np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends * x.shape[1]), pa.array(x.astype(np.int32).ravel())) for x in (own, keys)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["id", "pivots", "keys"])

    return lean(run)


def _links(key: int, side: np.ndarray, ids: np.ndarray, times: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, threshold: float):
    """(links, smallest connected id) of each member of a list; with two sides, only pairs across them are links."""
    same = np.einsum("ik,jk->ij", vectors, vectors) if len(ids) < 8 else vectors @ vectors.T
    linked = same >= threshold
    np.fill_diagonal(linked, False)
    if (side != side[0]).any():
        linked &= side[:, None] != side[None, :]
    if not linked.any():
        return None
    low, high = divmod(key, MOST_PIVOTS)
    smaller = np.where((pivots < high) & (pivots != low), pivots, -1)
    names, place = np.unique(smaller, return_inverse=True)
    has = np.zeros((len(ids), len(names)), np.float32)
    np.put_along_axis(has, place.reshape(smaller.shape), 1, 1)
    has[:, names < 0] = 0
    first = linked & (has @ has.T == 0)
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == label).all():
            break
        label = new
    return first @ times, label


def _lister(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = pa.concat_tables([held, part]).combine_chunks() if held is not None else part
            marks = np.stack([part.column(k).to_numpy() for k in ("key", "low", "high")])
            cut = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            held = part.slice(cut[-1] if len(cut) else 0)
            yield from _groups(part, cut, threshold)
        if held is not None and held.num_rows:
            yield from _groups(held, np.array([held.num_rows]), threshold)

    return lean(run)


def _groups(part: pa.Table, cut: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """The results of the lists that end at the cuts."""
    if not len(cut):
        return
    part = part.slice(0, cut[-1])
    key, side, ids, times = (part.column(k).to_numpy() for k in ("key", "side", "id", "times"))
    column = lambda k: part.column(k).combine_chunks()
    vectors = _matrix(column("embedding"))
    pivots = column("pivots").flatten().to_numpy().reshape(len(ids), -1)
    out: list[tuple[np.ndarray, ...]] = []
    begin = 0
    for end in cut.tolist():
        s = slice(begin, end)
        if end - begin > 1 and (found := _links(int(key[begin]), side[s], ids[s], times[s], vectors[s], pivots[s], threshold)):
            out.append((ids[s], *found))
        begin = end
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], ["id", "links", "label"])


def near_vectors(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(F.col("id").isNotNull() & ~bad, F.lit(False)))
    classes = rows.where("good").groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("times"))
    classes = saved(classes.select("id", "embedding", "times"))
    found = spark.createDataFrame([], "id long, links long, component long")
    for n, count in classes.groupBy(F.size("embedding").alias("n")).count().where("count > 1").orderBy("n").collect():
        found = found.unionByName(_found(classes.where(F.size("embedding") == n), count, threshold, block))
    classes = classes.join(found, "id", "left").select("embedding", F.lit(True).alias("good"), F.col("id").alias("first"), F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"))
    out = rows.join(saved(classes), ["embedding", "good"], "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _found(classes: DataFrame, count: int, threshold: float, block: int) -> DataFrame:
    """(id, links, component) of the distinct vectors that have links."""
    spark = classes.sparkSession
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, count // PER_PIVOT))
    sample = classes.select("embedding", "id").orderBy(F.xxhash64("embedding"), "id").limit(2 * wanted).select("embedding").toArrow()
    pivots = choose_pivots(_matrix(sample.column(0).combine_chunks()), wanted)
    posted = classes.select("id", "embedding").mapInArrow(_poster(spark.sparkContext.broadcast(pivots)), "id bigint, pivots array<int>, keys array<int>")
    posted = saved(posted)
    lists = posted.select("id", F.explode("keys").alias("key"))
    long = lists.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    member = lists.join(long, "key").withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("id"), blocks).cast("int")})
    member = member.select("key", "id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    member = member.select("key", "id", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    member = member.join(classes.join(posted.select("id", "pivots"), "id"), "id")
    member = member.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    member = member.select("key", "low", "high", "side", "id", "times", "embedding", "pivots")
    linked = saved(member.mapInArrow(_lister(threshold), "id bigint, links bigint, label bigint"))
    joined = components(linked.select(F.col("id").alias("a"), F.col("label").alias("b")))
    return linked.groupBy("id").agg(F.sum("links").alias("links")).join(joined.withColumnRenamed("node", "id"), "id", "left")


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
