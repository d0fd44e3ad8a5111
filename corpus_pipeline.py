"""Stages that turn raw documents into training data; each is written and read again."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import textquarry
from textquarry.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from textquarry.llm.common import stored, table

# Send the code of Python functions with them, so that executors need no install.
cloudpickle.register_pickle_by_value(textquarry)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels, does not take for toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one with the smallest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of the SimHash near-dedup operator (3-word shingles, fingerprints linked at
    2 or fewer differing bits, as in its contract), the document with the smallest id stays."""
    return simhash.drop_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of benchmark."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded again: their number and digests."""
    return bpe.token_digests(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", tokens_stage),
]

#: Stages with trained or hashed decisions have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each result is written as Parquet and is the next stage's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
