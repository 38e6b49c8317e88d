"""Tokenisers and text expressions. All but the stemmer stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word characters as Python's \w has them; Java's own \w is ASCII alone.
WORD = r"[\p{L}\p{N}_]+"
TERM = r"[\p{L}\p{N}_]{2,}"
#: White space as Unicode has it: without (?U), Java's \S takes a no-break space for text.
CHUNK_WORD = r"(?U)\S+"

# The classic English stop words.
ENGLISH_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such",
    "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
STOPWORDS: dict[str | None, tuple[str, ...]] = {"en": ENGLISH_STOPWORDS, None: ()}


def extract_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def word_set(text: Column, lower: bool = True) -> Column:
    """Distinct words."""
    return F.array_distinct(extract_all(F.lower(text) if lower else text, WORD))


def terms(text: Column, stopwords: str | None = "en", lower: bool = True, pattern: str = TERM) -> Column:
    """Index terms in order, with repeats, without stop words."""
    if stopwords not in STOPWORDS:
        raise ValueError(f"unknown stop words {stopwords!r}; known: {', '.join(map(repr, STOPWORDS))}")
    found = extract_all(F.lower(text) if lower else text, pattern)
    stop = STOPWORDS[stopwords]
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def words(text: Column) -> Column:
    """Runs of anything but Unicode white space."""
    return extract_all(text, CHUNK_WORD)


def snippet(text: Column, size: int = 400) -> Column:
    return F.substring(text, 1, size)


def titled(title: Column, body: Column) -> Column:
    return F.trim(F.concat_ws(" ", title, body))


def char_ngrams(texts: DataFrame, id_column: str, low: int = 3, high: int = 5, lower: bool = True, text: str = "text", block: int = 64) -> DataFrame:
    """(id, gram): every substring of `low` to `high` code points, white space included.

    A text is cut into blocks that overlap by `high` - 1 first: taking substrings of a
    whole long text costs its length each time.
    """
    t = F.lower(F.col(text)) if lower else F.col(text)
    cut = (
        texts.select(id_column, t.alias("_t"))
        .withColumn("_n", F.length("_t"))
        .filter(F.col("_n") >= low)
        .select(id_column, "_t", "_n", F.explode(F.sequence(F.lit(1), F.col("_n"), F.lit(block))).alias("_at"))
        .select(id_column, F.expr(f"substring(_t, _at, {block + high - 1})").alias("_b"))
        .withColumn("_left", F.length("_b"))
    )
    sizes = F.explode(F.array(*[F.lit(n) for n in range(low, high + 1)]))
    return (
        cut.select(id_column, "_b", "_left", F.explode(F.sequence(F.lit(1), F.least(F.lit(block), F.col("_left")))).alias("_i"))
        .select(id_column, "_b", "_left", "_i", sizes.alias("_size"))
        .filter("_i + _size - 1 <= _left")
        .select(id_column, F.expr("substring(_b, _i, _size)").alias("gram"))
    )


def stem_column(tokens: Column, stemmer: str | None) -> Column:
    """Stems of an array of tokens; an Arrow function, as no built-in stems."""
    if stemmer is None:
        return tokens
    if stemmer != "snowball-en":
        raise ValueError(f"unknown stemmer {stemmer!r}; known: 'snowball-en', None")
    from .stemmer import stem

    @F.pandas_udf("array<string>")
    def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = lru_cache(200_000)(stem)
        for batch in batches:
            yield batch.map(lambda ws: None if ws is None else [of(w) for w in ws])

    return stems(tokens)
