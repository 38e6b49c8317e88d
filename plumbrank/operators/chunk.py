"""Cutting documents into chunks, and folding chunk runs back to documents."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .ranking import rank

#: Chunks fetched for each document wanted, as several may come from one document.
OVERFETCH = 5


@dataclass(frozen=True)
class Whole:
    """Each document is its own chunk."""

    kind: str = "whole"

    def descriptor(self) -> dict[str, Any]:
        return {"kind": self.kind}

    def cut(self, corpus: DataFrame) -> DataFrame:
        return corpus.select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")


@dataclass(frozen=True)
class FixedWords:
    """Windows of `size` words, each sharing `overlap` with the one before; a document without words has none."""

    size: int = 180
    overlap: int = 40
    kind: str = "fixed_words"

    def descriptor(self) -> dict[str, Any]:
        return {"kind": self.kind, "size": self.size, "overlap": self.overlap}

    def cut(self, corpus: DataFrame) -> DataFrame:
        if self.size < 1 or not 0 <= self.overlap < self.size:
            raise ValueError(f"overlap {self.overlap} must be at least 0 and less than size {self.size}")
        step = self.size - self.overlap
        rows = corpus.select("doc_id", text.words(F.col("text")).alias("w")).filter(F.size("w") > 0)
        last = F.greatest(F.lit(1), F.size("w") - self.overlap) - 1
        windows = rows.select("doc_id", "w", F.posexplode(F.sequence(F.lit(0), last, F.lit(step))).alias("i", "at"))
        return windows.select(F.concat_ws("#", "doc_id", F.col("i").cast("string")).alias("chunk_id"), "doc_id", F.array_join(F.slice("w", F.col("at") + 1, self.size), " ").alias("text"))


def chunks_of(chunks: DataFrame, doc_id: str) -> DataFrame:
    """The chunks of one document."""
    return chunks.filter(F.col("doc_id") == doc_id)


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def mean_chunks(chunks: DataFrame) -> DataFrame:
    """One row: documents with chunks, chunks, and chunks for each of these documents."""
    return chunks_per_document(chunks).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"), F.avg("n_chunks").alias("mean_chunks"))


def fold(run: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """A chunk run (query_id, chunk_id, score) as a document run: a document scores as its best chunk; unknown chunks drop out."""
    best = run.join(chunks.select("chunk_id", "doc_id"), "chunk_id").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return rank(best, k)
