"""The corpus pipeline: toxicity, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver of the pipeline writes it as Parquet and rereads
it as the next stage's ``docs``. All but the last stage return the columns of ``docs``. ``run`` does the same in the
session's shared folder. No SQL expresses these stages, so ``ORACLE_SQL`` is None; tests compare them with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalloom.llm import packing, secrets, simhash, suffix, toxicity
from evalloom.llm.common import discard, scratch, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels and lets documents with a score of 0.7 or more go."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each SimHash group."""
    return simhash.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every string of 50 bytes that an earlier document has, too; no document goes."""
    return suffix.deduplicated(docs, docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; no document goes."""
    return secrets.redacted(docs, docs.columns)


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assigns every document to a batch of an optimal length bucket."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("secret_scan", redact_secrets),
    ("packing", pack_lengths),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages write on their way goes when they are done, and so does each stage's input."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as tables:
            docs = written(stage(spark, docs, sf_dir), name)
            tables.remove(docs._table)
        if before is not None:
            discard(before)
        before = docs
    return docs
