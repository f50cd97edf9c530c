"""Corpus pipeline: quality, exact copies, near copies, mixing, encoding. Each stage works on all that the one before kept.

NULLs, empty and long texts, ties and repeated rows have the results that the
operators define. An empty table passes through all stages. Stages before the last carry
all columns of the documents, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import catalog, exact_dedup, jaccard_join, mixing, quality_classifier, sentencepiece_fst
from corvane.session import Stored

#: Training a model and sampling a mix are not expressed in SQL; the stages are tested one by one.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    packed = docs.select(F.struct(*docs.columns).alias("_all"), "text")
    scored = quality_classifier.score(packed, catalog.quality_model(docs, spark, sf_dir))
    return scored.filter(F.col("score") >= catalog.QUALITY_FROM).select("_all.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document taken n times comes as n rows."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = sentencepiece_fst.load_model(catalog.vocabulary("piece_bpe_32k.model"))
    return sentencepiece_fst.encode(docs, model, keep=["doc_id", "lang", "source"])


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("SentencePiece encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again, and deleted when the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        stored = Stored(stage(spark, docs, sf_dir), f"pipeline-{i}")
        docs = stored.df
        if before is not None:
            before.drop()
        before = stored
    return docs
