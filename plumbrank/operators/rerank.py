"""Rerankers: coverage and cross-encoder, and the stage that applies one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, ClassVar, NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text
from . import models
from .ranking import rank


class Reranker(Protocol):
    name: str

    @property
    def descriptor(self) -> dict[str, Any]: ...
    def score(self, query: Column, document: Column) -> Column: ...


@dataclass(frozen=True)
class CoverageReranker:
    """Share of the query's distinct words that a candidate has, less `length_penalty` times the log of its distinct words."""

    uses: ClassVar[tuple[str, ...]] = ()
    version: ClassVar[int] = 1
    name: str = "coverage"
    lower: bool = True
    length_penalty: float = 0.0

    @property
    def descriptor(self) -> dict[str, Any]:
        return {"kind": "coverage", "lower": self.lower, "length_penalty": self.length_penalty, "impl_version": self.version}

    def score(self, query: Column, document: Column) -> Column:
        return scoring.coverage(text.word_set(query, self.lower), text.word_set(document, self.lower), self.length_penalty)


@dataclass(frozen=True)
class CrossEncoderReranker:
    """Scores pairs with an injected model, loaded once for each worker process: `load()` gives a function from two lists of texts to scores.

    Calls hold pairs of like length; a null text counts as empty.
    """

    uses: ClassVar[tuple[str, ...]] = ("pandas", "pyarrow")
    version: ClassVar[int] = 2
    model_id: str = "injected"
    name: str = "cross_encoder"
    revision: str | None = None
    device: str = "cpu"
    dtype: str = "float32"
    max_length: int | None = None
    batch_size: int = 32
    load: Callable[[], Callable[[list[str], list[str]], list[float]]] | None = None

    @property
    def descriptor(self) -> dict[str, Any]:
        names = ("model_id", "revision", "device", "dtype", "max_length", "batch_size")
        return {"kind": "cross_encoder", **{x: getattr(self, x) for x in names}, "impl_version": self.version}

    def score(self, query: Column, document: Column) -> Column:
        if self.load is None:
            raise ValueError("a cross-encoder needs `load`")
        key, load, count = models.name_of(self.descriptor, self.load), self.load, self.batch_size

        @F.pandas_udf("double")
        def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = models.loaded(key, load)
            for q, d in batches:
                q, d = q.fillna("").tolist(), d.fillna("").tolist()
                found = [0.0] * len(q)
                for call in models.calls([models.size(a) + models.size(b) for a, b in zip(q, d, strict=True)], count):
                    for i, x in zip(call, model([q[i] for i in call], [d[i] for i in call]), strict=True):
                        found[i] = float(x)
                yield pd.Series(found, dtype=float)

        return scores(query, document)


RERANKERS: dict[str, Callable[..., Reranker]] = {"coverage": CoverageReranker, "cross_encoder": CrossEncoderReranker}


def build_reranker(kind: str, **options: Any) -> Reranker:
    if kind not in RERANKERS:
        raise ValueError(f"unknown reranker {kind!r}; known: {', '.join(RERANKERS)}")
    return RERANKERS[kind](**options)


class Reranked(NamedTuple):
    before: DataFrame
    after: DataFrame


def rerank(run: DataFrame, reranker: Reranker, queries: DataFrame, corpus: DataFrame, k: int) -> Reranked:
    """Candidates scored anew and cut to k; `before` keeps the ranking that they came in."""
    pairs = run.select("query_id", "doc_id").join(queries.select("query_id", F.col("text").alias("_q")), "query_id").join(corpus.select("doc_id", F.col("text").alias("_d")), "doc_id")
    scored = pairs.select("query_id", "doc_id", reranker.score(F.col("_q"), F.col("_d")).alias("score"))
    return Reranked(run, rank(scored, k))
