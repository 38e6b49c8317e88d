"""Inverted indexes as tables: postings, document frequency, lengths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..session import spread


def term_frequency(tokens: DataFrame, unit: str, term: str = "term") -> DataFrame:
    return tokens.groupBy(unit, term).agg(F.count(F.lit(1)).cast("double").alias("tf"))


def document_frequency(postings: DataFrame, term: str = "term") -> DataFrame:
    """postings: one row for each unit and term."""
    return postings.groupBy(term).agg(F.count(F.lit(1)).cast("double").alias("df"))


def lengths(tokenised: DataFrame, unit: str) -> DataFrame:
    """tokenised: unit and its array `terms`."""
    return tokenised.select(unit, F.size("terms").cast("double").alias("dl"))


def length_stats(lengths_: DataFrame) -> DataFrame:
    """One row: number of units and their mean length."""
    return lengths_.agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


@dataclass
class TermIndex:
    """postings(unit, term, tf, dl), frequency(term, df), stats(n, avgdl), units(unit), as parts of a plan."""

    unit: str
    postings: DataFrame
    frequency: DataFrame
    stats: DataFrame
    units: DataFrame

    @classmethod
    def build(cls, units: DataFrame, unit: str, stopwords: str | None, stemmer: str | None, lower: bool, pattern: str) -> TermIndex:
        """Occurrences are counted ahead of the exchange, which no text goes through."""
        found = text.stem_column(text.terms(F.col("text"), stopwords, lower, pattern), stemmer)
        tokenised = spread(units.select(unit, "text")).select(unit, found.alias("terms"))
        # dl rides along: postings then need no join with lengths.
        exploded = tokenised.select(unit, F.size("terms").cast("double").alias("dl"), F.explode("terms").alias("term"))
        postings = exploded.groupBy(unit, "term").agg(F.count(F.lit(1)).cast("double").alias("tf"), F.first("dl").alias("dl"))
        return cls(unit, postings, document_frequency(postings), length_stats(lengths(tokenised, unit)), units.select(unit))


def smoothed_idf(corpus: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(term, idf) over the distinct words of documents; `only`: a table of the terms that are wanted."""
    # Words are counted where the texts lie, before they meet the wanted ones: a join first would shuffle each word of each document.
    found = spread(corpus.select("text")).select(F.explode(text.word_set(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    if only is not None:
        found = found.join(only.select("term").distinct(), "term", "left_semi")
    n = corpus.agg(F.count(F.lit(1)).cast("double").alias("n"))
    return found.crossJoin(F.broadcast(n)).select("term", "df", scoring.smooth_idf(F.col("n"), F.col("df")).alias("idf"))
