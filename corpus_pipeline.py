"""The corpus pipeline: toxicity, quality, near-duplicates, decontamination, packing. Each stage works on all that the one before kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import decontamination, packing, quality, simhash, toxicity
from tablewright.llm.common import narrow_reads, shared_dir

#: A document from this toxicity on goes; a document below this quality goes.
TOXIC, POOR = 0.3, 0.5


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC. Null and empty texts are scored like any other; rows with a null doc_id take part."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.fit_rows(F.col("doc_id")))
    return model.score(docs, "__toxicity").where(F.col("__toxicity") < TOXIC).drop("__toxicity")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored POOR or better."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.fit_rows(F.col("doc_id")))
    return model.score(docs, "__quality").where(F.col("__quality") >= POOR).drop("__quality")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each component: fingerprints within 2 bits, or 5-word Jaccard similarity of 0.8."""
    return simhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.packed(docs)


def _narrow(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        narrow_reads(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _narrow(stage)) for name, stage in (("toxicity", remove_toxic), ("quality", keep_quality), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("packing", pack))]

#: The stages' models and tokenizer are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written to the shared folder and read again."""
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{base}/{i}-{name}")
        docs = spark.read.parquet(path)
    return docs
