"""The corpus pipeline: quality, near duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir), is written as Parquet and reread as the next one's docs. All but the last return
the columns of documents, so a later stage works on whatever the one before it kept or changed.

Null and empty texts are judged by the classifier like others; those that stay link with nothing, hold no items or secrets
and have no tokens. Rows that repeat an id and a text with words are one document. Columns beside those of documents go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, decontaminate, jaccard_join, quality, secrets
from tidewatch.llm.common import dropped, saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return docs.where(quality.score(spark, F.col("text"), model) >= quality.THRESHOLD).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return jaccard_join.first_of_each(docs.select(*COLUMNS))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't contaminate."""
    found = decontaminate.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), out="found")
    return found.where(~decontaminate.is_contaminated(F.col("found"))).select(*COLUMNS)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    docs = docs.withColumn("text", secrets.redact(spark, F.col("text")))
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document."""
    ids = bpe.encode(spark, F.col("text"), bpe.default_path())
    return docs.select("doc_id", "lang", "source", ids.alias("ids")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", clean), ("secrets", redacted), ("tokens", encoded)]
#: No stage but the third and fourth could be put in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
            if before is not None:
                dropped(before)
            before = docs
    return docs
