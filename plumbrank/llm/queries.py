"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import read_table
from . import balltree, binary, divergence, fingerprint, fmindex, jaccard, langid, licences, mixing, packing, secrets, tokens, toxicity


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every text and of its edited text, and their likeness; null texts count as empty, repeated rows follow one another."""
    return fingerprint.fingerprint_query(read_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text; null and empty texts have none, repeated rows stay."""
    return tokens.count_query(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and linked findings of every text; null and empty texts have none, repeated rows stay apart."""
    return secrets.secrets_query(read_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows of every text; null and empty texts have no words, items without words match nothing."""
    return fmindex.decontamination_query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences of every text, and the licences and duties that rules read from them."""
    return licences.licences_query(read_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every text; `und` for null texts and texts without letters, and for all where nothing could be learned."""
    return langid.language_query(read_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document; null and empty texts are alone, a null id has no component."""
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text; null and empty texts have the score of the bias, without labels all have 0.5."""
    return toxicity.toxicity_query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, probability and draw of every document; null sources and languages are `?`, null and empty texts weigh one token."""
    return mixing.mixing_query(read_table(spark, sf_dir, "documents"))


def op10_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, written to shards and read back through their index; null texts hold the end id alone, null ids come first."""
    return binary.binary_query(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between sources of a language over its terms, and the terms that each source has more of; null texts, languages and sources are empty."""
    return divergence.divergence_query(read_table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every text; null texts hold the end id alone, repeated rows are documents of their own."""
    return packing.packing_query(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for each anchor's positives; rows that lack a label, a vector or a finite component take no part."""
    return balltree.negatives_query(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_fingerprint, op2_token_counts, op3_secrets, op4_decontamination, op5_licences, op6_language, op7_jaccard_join, op8_toxicity, op9_mixing, op10_binary, op11_divergence, op12_packing, op13_hard_negatives)
}
ORACLE_SQL: dict[str, str] = {"op3_secrets": secrets.oracle_sql(), "op5_licences": licences.oracle_sql(), "op9_mixing": mixing.oracle_sql(), "op11_divergence": divergence.oracle_sql(), "op13_hard_negatives": balltree.oracle_sql()}
