"""A corpus from raw documents to packed sequences: each stage reads what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserine.llm.lines import drop_lines
from tesserine.llm.neardup import drop_near_duplicates
from tesserine.llm.packing import pack_documents
from tesserine.llm.quality import filter_quality
from tesserine.llm.secrets import redact
from tesserine.llm.store import materialize, read_table, release, scratch


# Each stage keeps the columns of its input, whatever their names, and judges rows that repeat alike. An empty table
# stays empty, texts are taken whole, and what a null or an empty text comes to stands with each stage.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule, or come from a host that mostly does, go; so do null and empty texts. A null source is no host, and condemns none."""
    return filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents have stay in one of them only, that with the largest id. Null and empty texts stay as they are; rows with a null id lose such lines."""
    return drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least id. Null and empty texts are in no group, nor are rows with a null id; all of these stay."""
    return drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, and null and empty texts stay as they are."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences. A null or empty text is one token. Of the capacities only that of tokens can bind here."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("secret scans", secret_scan),
    ("packing", packing),
]

#: The stages of shingles, tokens and packing can't be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again. What a stage has stored on the way goes when its result is there, and that when the next one's is."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            kept = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), outlive=True)
        release(docs)
        docs = kept
    return docs
