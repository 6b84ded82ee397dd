"""The corpus pipeline: quality, near-duplicates, benchmark leaks, packing; each stage written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigweave.llm.common import materialize, table
from sigweave.llm.decontaminate import drop_leaked
from sigweave.llm.near_dedup import keep_one
from sigweave.llm.packing import pack
from sigweave.llm.quality_kn import keep_good
from sigweave.llm.queries import BPE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's quantile."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or near-equal texts."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in full windows, mixed by source."""
    return pack(docs, BPE)


STAGES = [("quality classifier", quality), ("near-dedup", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Perplexities, samples, fingerprints and token ids are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
