"""Scoring formulas as column expressions over tf, df, dl, n and avgdl."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal places that scores keep, so that one tie is a tie on every engine.
PLACES = 9
DELTA = 0.5
METHODS = ("lucene", "robertson", "atire", "bm25+", "bm25l")


def check_method(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"unknown BM25 method {method!r}; known: {', '.join(METHODS)}")


def bm25_idf(method: str, n: Column, df: Column) -> Column:
    odds = (n - df + 0.5) / (df + 0.5)
    return {
        "lucene": lambda: F.ln(1 + odds),
        "robertson": lambda: F.ln(F.greatest(F.lit(1.0), odds)),
        "atire": lambda: F.ln(n / df),
        "bm25+": lambda: F.ln((n + 1) / df),
        "bm25l": lambda: F.ln((n + 1) / (df + 0.5)),
    }[method]()


def bm25_tf(method: str, k1: float, b: float, tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a matching term adds for each unit of idf, beyond `bm25_absent`."""
    norm = 1 - b + b * dl / avgdl
    if method in ("lucene", "robertson"):
        return tf / (tf + k1 * norm)
    if method in ("atire", "bm25+"):
        return tf * (k1 + 1) / (tf + k1 * norm)
    c = tf / norm
    return (k1 + 1) * (c + DELTA) / (k1 + c + DELTA) - bm25_absent(method, k1)


def bm25_absent(method: str, k1: float) -> float:
    """What a query term adds to units that lack it, for each unit of idf."""
    return {"bm25+": DELTA, "bm25l": (k1 + 1) * DELTA / (k1 + DELTA)}.get(method, 0.0)


def smooth_idf(n: Column, df: Column, smooth: bool = True) -> Column:
    return F.ln((1.0 + n) / (1.0 + df)) + 1.0 if smooth else F.ln(n / F.greatest(df, F.lit(1.0))) + 1.0


def tf_weight(tf: Column, sublinear: bool = True) -> Column:
    return 1.0 + F.ln(tf) if sublinear else tf


def coverage(query: Column, doc: Column, penalty: float = 0.0) -> Column:
    """Part of the query's words that a document has, less a penalty on its distinct words; 0 for an empty query."""
    share = F.size(F.array_intersect(query, doc)).cast("double") / F.size(query)
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(share - penalty * F.log1p(F.size(doc).cast("double")))


def weight_rank(rank: Column) -> Column:
    """A missing rank is worse than any."""
    return F.coalesce(rank, F.lit(1 << 30))


def direction(left: Column, right: Column) -> Column:
    return F.when(weight_rank(right) < weight_rank(left), "improved").when(weight_rank(right) > weight_rank(left), "regressed").otherwise("unchanged")
