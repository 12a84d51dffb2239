"""What the corpus operators share: table reading, written intermediate tables, workers' memory and connected components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[1]
#: Removes an execution's shuffle files when it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Edges up to which one task joins components, in some 30 MB; more are joined by all tasks in rounds.
FEW = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that they need not have the repository."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewatch_shipped", False):
        return
    where = Path(tempfile.mkdtemp()) / "tidewatch_code.zip"
    with zipfile.ZipFile(where, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, Path(ROOT.name) / p.relative_to(ROOT))
    sc.addPyFile(str(where))
    sc._tidewatch_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints. Only a session on this one machine gets a folder of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
            where = tempfile.mkdtemp(prefix="tidewatch-")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def dealt(df: DataFrame) -> DataFrame:
    """df on the files of its shuffle, which is made once: all that reads it sees the same partitions, without a copy.

    Lost files are made anew for the same partitions. The files go when nothing refers to the result any more.
    """
    return DataFrame(df.sparkSession._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), df.sparkSession)


def saved(df: DataFrame) -> DataFrame:
    """df written to a compressed table in the shared folder, and its shuffles let go of; dropped() deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # planned anew, as a plan carries the setting of its time
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that saved() wrote, once nothing that is still to run reads them."""
    for t in tables:
        spark, path = t.sparkSession, t._written
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


_kept: dict = {}


def kept(key, make: Callable):
    """The one large thing that a worker keeps from task to task; work that keeps another, or none, lets go of it."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    _kept.clear()


def give_back() -> None:
    """Return to the system what the allocators of this process hold on to; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def lean(run: Callable, keeps: bool = False) -> Callable:
    """A worker's function over an iterator that ends with its memory given back, and begins without what others kept."""

    @functools.wraps(run)
    def inner(batches: Iterator) -> Iterator:
        if not keeps:
            forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def packed(body: bytes) -> bytes:
    """Compressed, after its length."""
    return len(body).to_bytes(8) + pa.compress(body, "zstd", asbytes=True) if body else b""


def unpacked(body: bytes) -> bytes:
    return pa.decompress(body[8:], int.from_bytes(body[:8]), "zstd", asbytes=True) if body else b""


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges at once."""
    edges = list(batches)
    ends = pa.chunked_array([b.column(k) for k in (0, 1) for b in edges], edges[0].schema.field(0).type if edges else pa.int64())
    if not len(ends):
        return
    coded = ends.combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    nodes = coded.dictionary.take(order)
    place = np.empty(len(nodes), np.int64)
    place[order.to_numpy()] = np.arange(len(nodes))
    u, v = place[coded.indices.to_numpy()].reshape(2, -1).tolist()
    up = list(range(len(nodes)))
    for a, b in zip(u, v):
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[max(a, b)] = min(a, b)
    for k, x in enumerate(up):  # what stands above a node is less, so done
        up[k] = up[x]
    out = pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(up))], ["node", "component"])
    for at in range(0, len(out), 1 << 14):
        yield out.slice(at, 1 << 14)


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge; a saved table.

    Up to `few` edges are joined in one task, as rounds over them would be jobs with next to nothing to do. More alternate
    large-star and small-star steps until the edge set no longer changes; each ends as a star round its smallest node. Minima are written before they are joined, so that the joins are plain ones whose hubs Spark splits.
    Self-loops, nulls and repeated or reversed edges make no difference.
    """
    e = given = saved(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"))
    if e.count() <= few:
        ship(e.sparkSession)
        kind = e.schema["u"].dataType.simpleString()
        out = saved(e.coalesce(1).mapInArrow(lean(_joined), f"node {kind}, component {kind}"))
        dropped(e)
        return out
    e = saved(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    dropped(given)
    before = None
    while True:
        # A state is known by the number, sum and hash of its edges; two equal states in turn are the end.
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = saved(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        dropped(e, low)
        low = saved(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        dropped(large, low)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = saved(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots))
    dropped(e)
    return out
