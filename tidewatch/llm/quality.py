"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text is described by how often each three signs in a row occur in it, after every character has been mapped to one of
the SIGNS classes (letters of either case, digits, spaces, and the kinds of punctuation), so 12^3 terms whatever the
language; one more term counts words like the one before. Weighted terms of a bounded sample of labelled texts (SAMPLE) are reduced by singular value decomposition to
DIMENSIONS latent ones. The sample's latent vectors, of fixed size, are broadcast; every document is compared with all of
them in blocks of exact cosine products, and the NEIGHBOURS nearest vote for their label with their similarity's power.

Null and empty texts have the zero vector, and like texts without a similar neighbour get the labelled sample's mean
label. Labels that are null or lack a text are not learnt from; of several labels of a document, or texts of a label, the
least are taken. Without any label the score is PRIOR. Each document is scored by itself: repeated ones alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import lean, ship, table

#: Labelled rows learnt from: those with the smallest hashes of their ids.
SAMPLE, DIMENSIONS, NEIGHBOURS, POWER, BLOCK, PRIOR, THRESHOLD = 3000, 48, 25, 8, 512, 0.5, 0.3
SIGNS = 12
TERMS = SIGNS**3 + 1


def _signs() -> np.ndarray:
    out = np.full(256, 11, np.uint16)
    for k, which in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "|", "*#$%&@^~=+<>_\\/")):
        out[[ord(c) for c in which]] = k
    out[128:] = 10
    return out


_SIGNS = _signs()


def terms_of(text: str | None) -> np.ndarray:
    """Counts of three signs in a row and, last, of words like the one before, over the whole text.

    UTF-8 bytes beyond ASCII are one sign each. Nothing is counted in texts of under three bytes.
    """
    raw = (text or "").encode()
    s = _SIGNS[np.frombuffer(raw, np.uint8)]
    out = np.zeros(TERMS, np.float32)
    if len(s) >= 3:
        out[:-1] = np.bincount(s[:-2] * SIGNS * SIGNS + s[1:-1] * SIGNS + s[2:], minlength=SIGNS**3)
        words = raw.split()
        out[-1] = sum(map(eq, words, words[1:]))
    return out


def _damped(counts: np.ndarray) -> np.ndarray:
    """Shares of each row's terms, damped so that rare terms count as well as frequent ones."""
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def principal_axes(x: np.ndarray, rounds: int = 8) -> np.ndarray:
    """The right singular vectors of the DIMENSIONS largest singular values, by subspace iteration from a fixed start."""
    q = np.random.default_rng(0).standard_normal((x.shape[1], DIMENSIONS + 16)).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :DIMENSIONS]


class Model:
    def __init__(self, counts: np.ndarray, labels: np.ndarray, prior: float = PRIOR):
        self.labels = labels.astype(np.float64)
        self.prior = float(labels.mean()) if len(labels) else prior
        x = _damped(counts)
        seen = (counts > 0).sum(axis=0)
        self.weight = (np.log((1 + len(counts)) / (1 + seen)) + 1).astype(np.float32)
        self.mean = (x * self.weight).mean(axis=0) if len(counts) else np.zeros(counts.shape[1], np.float32)
        if len(counts):
            x = x * self.weight - self.mean
            self.axes = principal_axes(x)
        else:
            self.axes = np.zeros((counts.shape[1], DIMENSIONS), np.float32)
        self.vectors = self.latent(counts)

    def latent(self, counts: np.ndarray) -> np.ndarray:
        out = _unit((_damped(counts) * self.weight - self.mean) @ self.axes)
        out[counts.sum(axis=1) == 0] = 0
        return out

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        out = np.empty(len(counts))
        for at in range(0, len(counts), BLOCK):
            v = self.latent(counts[at : at + BLOCK])
            near = v @ self.vectors.T
            k = min(NEIGHBOURS, near.shape[1])
            cut = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
            votes = np.where((near >= cut) & (near > 0), near, 0).astype(np.float64) ** POWER
            total = votes.sum(axis=1)
            out[at : at + BLOCK] = np.where(total > 0, votes @ self.labels / np.maximum(total, 1e-300), self.prior)
        return np.clip(out, 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model learnt from at most `sample` labelled documents that aren't held out; only their term counts reach the driver."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "quality", _terms(F.col("text")).alias("terms"))
    rows = sorted(texts.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("terms").alias("terms")).collect())
    counts = np.stack([np.frombuffer(r.terms, np.float32) for r in rows]) if rows else np.zeros((0, TERMS), np.float32)
    return Model(counts, np.array([r.quality for r in rows], np.float64))


def _terms(text: Column) -> Column:
    @F.arrow_udf("binary")
    @lean
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([terms_of(t.as_py()).tobytes() for t in texts], pa.binary())

    return run(text)


def score(spark: SparkSession, text: Column, model: Model) -> Column:
    """double: how likely each text is of label 1."""
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    @lean
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = [np.empty(0)]
            for at in range(0, len(texts), BLOCK):
                out.append(sent.value.scores(np.stack([terms_of(t.as_py()) for t in texts[at : at + BLOCK]])))
            yield pa.array(np.concatenate(out))

    return run(text)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(spark, F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
