"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays,
benchmark passages are cut out, and what is left is packed into training sequences.

Each stage is written as Parquet and read back as the documents of the next.

Edge cases: null and empty texts are clean, duplicate nothing, hold no passage and are
packed as the end id alone; a null column stays as it is; a null id, or one that stands at different texts,
makes no documents the same, and of exact copies with one id one row stays; ties go to the
smallest id; a passage whose item has no id is cut like any other; very long texts are whole until they are packed in
pieces; extra columns stay up to the last stage, whatever their names; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from searchpulse.llm.common import stored, table
from searchpulse.llm.decontaminate import decontaminate
from searchpulse.llm.near_duplicates import deduplicate
from searchpulse.llm.packing import pack_documents
from searchpulse.llm.tokens import tokenizer_path
from searchpulse.llm.toxicity import reject_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or over sentence scores stays below the threshold."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of documents of which 80 % of the five-word shingles agree."""
    return deduplicate(docs, shingle_words=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their benchmark passages; those that are mostly benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their ids."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), drops_blanks=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: SQL can express neither a fitted model nor the packing; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
