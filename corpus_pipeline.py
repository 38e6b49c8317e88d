"""The corpus pipeline: five stages over documents, each a table that the next one reads.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbrank.llm import binary, fmindex, jaccard, mixing, queries, toxicity
from plumbrank.session import fresh_path, read_table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores 0.5 or more go."""
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return jaccard.near_duplicates_removed(docs, words=5, percent=80)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words benchmark windows cover 5 % or more go."""
    return fmindex.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics meet their target shares."""
    return mixing.mixed(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of what is left, and what reading them back gives."""
    return binary.binary_query(docs, queries.tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", remove_toxic),
    ("jaccard_join", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: A fitted model and tokens are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; the rows of the last, read back from the token-id files.

    Null, empty and very long texts and repeated rows are each stage's own cases; an empty
    table gives none; further columns of any name pass through all stages but the last.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
