"""Operator 1, document fingerprints: bottom-k sketches of shingle hashes.

The k smallest distinct 64-bit hashes of a document's word shingles. Sketches of
parts merge into the sketch of the whole, and two sketches estimate resemblance,
containment and the number of distinct shingles. A sketch of fewer than k hashes
is the whole set, and what it says is exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shuffle_partitions
from . import text as tx

SIZE = 128
WORDS = 5


def sketches(texts: tx.Texts, size: int = SIZE, words: int = WORDS) -> list[np.ndarray]:
    """The ascending bottom-`size` hashes of each text's shingles of lower-cased words."""
    texts = texts.lowered()
    at = tx.spans(texts, tx.NOT_SPACE)
    hashes, begin = tx.shingles(tx.span_hashes(texts.data, at.starts, at.ends), at.first, words)
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        h = hashes[a:b]
        if len(h) > 4 * size:  # a first cut; repeats may leave too few distinct ones, then all count
            low = np.unique(np.partition(h, 2 * size)[: 2 * size])
            if len(low) >= size:
                out.append(low[:size])
                continue
        out.append(np.unique(h)[:size])
    return out


def merged(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The sketch of the two documents together."""
    return np.union1d(a, b)[:size]


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity: the part of the joint sketch that both sketches hold. Two empty sets are alike."""
    both = np.concatenate([a, b])
    both.sort()
    low = np.flatnonzero(np.append(True, both[1:] != both[:-1]))[:size] if len(both) else both
    if not len(low):
        return 1.0
    return float(np.count_nonzero(both[low[low + 1 < len(both)]] == both[low[low + 1 < len(both)] + 1])) / len(low)


def distinct(a: np.ndarray, size: int = SIZE) -> float:
    """Estimated number of distinct shingles."""
    if len(a) < size:
        return float(len(a))
    return (size - 1) / ((float(a[size - 1]) + 1.0) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated part of a's shingles that b has too."""
    n = distinct(a, size)
    if not n:
        return 1.0
    return min(1.0, resemblance(a, b, size) * distinct(merged(a, b, size), size) / n)


def encoded(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def decoded(x: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(x), ">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, text: str = "text", size: int = SIZE, words: int = WORDS, into: str = "fingerprint") -> DataFrame:
    """Append each text's sketch as an ascending array<long> of hashes (unsigned order, stored as signed).

    Null and empty texts have the empty sketch; a text of fewer than `words` words
    has one shingle; repeated rows stay; a column named `into` is replaced.
    """
    kept = [x for x in docs.columns if x != into]
    schema = T.StructType([docs.schema[x] for x in kept] + [T.StructField(into, T.ArrayType(T.LongType()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in tx.blocks(batch, text):
                yield tx.with_columns(part, **{into: pa.array([x.view(np.int64) for x in sketches(texts, size, words)], pa.list_(pa.int64()))})

    return docs.select(*kept).mapInArrow(sketch, schema)


def _unsigned(x: Column) -> Column:
    """Maps the unsigned order of stored hashes to the signed one, and back."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def merge_fingerprints(sketched: DataFrame, by: list[str], size: int = SIZE, sketch: str = "fingerprint") -> DataFrame:
    """The sketch of each group's documents together, in DataFrame operations.

    Equal hashes of a group fold before the shuffle, and no more than `size` rows
    of a group and a task get past the window's own limit: no group is gathered.
    """
    rows = sketched.select(*by, F.explode_outer(sketch).alias("_h")).groupBy(*by, "_h").agg(F.count(F.lit(1)).alias("_n"))
    low = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(_unsigned(F.col("_h")).asc_nulls_last()))).filter(F.col("_at") <= size)
    hashes = F.transform(F.array_sort(F.collect_list(_unsigned(F.col("_h")))), _unsigned)  # nulls, of empty sketches, aren't collected
    return low.groupBy(*by).agg(hashes.alias(sketch))


def _successors(docs: DataFrame, parts: int) -> DataFrame:
    """Documents dealt out in ascending doc_id order, each part with its successor's first row.

    Columns: bucket, peek, doc_id, text. Cut points are quantiles of the ids alone;
    only they and each bucket's least id (at most `parts` numbers) reach the driver.
    A bucket ends with a peek row: a copy of the next bucket's first document, or
    for the last bucket of the first one.
    """
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))  # null ids first
    rows = docs.select("doc_id", "text", ids.alias("_id"))
    probs = [i / parts for i in range(1, parts)]
    cuts = sorted({int(x) for x in (rows.select("_id").approxQuantile("_id", probs, 0.2 / parts) if probs else [])})
    wide = max(1, int(len(cuts) ** 0.5))
    coarse, fine = cuts[wide - 1 :: wide], [cuts[i : i + wide] for i in range(0, len(cuts), wide)] + [[]]
    longs = lambda x: F.array(*[F.lit(y) for y in x]).cast("array<bigint>")
    passed = lambda x: F.size(F.filter(x, lambda c: c <= F.col("_id")))
    step = passed(longs(coarse))
    rows = rows.withColumn("_step", step).withColumn("_bucket", F.col("_step") * wide + passed(F.get(F.array(*[longs(x) for x in fine]), F.col("_step"))))
    heads = sorted((r[0], r[1]) for r in rows.groupBy("_bucket").agg(F.min("_id")).collect())
    if not heads:
        return rows.select(F.lit(0).alias("bucket"), F.lit(False).alias("peek"), "doc_id", "text")
    before = dict(zip([h for _, h in heads], [heads[i - 1][0] for i in range(len(heads))], strict=True))
    head = F.get(longs([before[h] for _, h in heads]), F.array_position(longs([h for _, h in heads]), F.col("_id")).cast("int") - 1)
    places = F.filter(F.array(F.struct(F.col("_bucket").cast("long").alias("bucket"), F.lit(False).alias("peek")), F.struct(head.alias("bucket"), F.lit(True).alias("peek"))), lambda p: p["bucket"].isNotNull())
    dealt = rows.select("doc_id", "text", F.explode(places).alias("_p")).select(F.col("_p.bucket").cast("int").alias("bucket"), F.col("_p.peek").alias("peek"), "doc_id", "text")
    return dealt.repartitionById(parts, "bucket").sortWithinPartitions("bucket", "peek", "doc_id", "text")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_by_edit double, n_distinct double"


def fingerprint_query(docs: DataFrame, size: int = SIZE, words: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Beside resemblance stand the part of a text's shingles that its edited text contains,
    and the number of its distinct shingles, as the sketches estimate them.
    The edited text takes its last half from the next document by doc_id. Texts
    are shuffled once. Null texts count as empty; null ids come first; repeated ids
    follow one another in order of their texts; a table of one document is its own
    successor. Two empty texts are alike (1.0).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (bucket, doc_id, text, sketch), the last row of which waits for its successor
        for batch in batches:
            for part, texts in tx.blocks(batch, "text"):
                found = sketches(texts, size, words)
                strings = ["" if x is None else x for x in part.column(3).to_pylist()]
                new = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strings, found, strict=True))
                rows = held + new
                ready = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if a[0] == b[0] and not a[1]]
                held = rows[-1:]
                if ready:
                    yield compare(ready)

    def compare(pairs: list[tuple]) -> pa.RecordBatch:
        edited = []
        for (_, _, _, own, _), (_, _, _, other, _) in pairs:
            half = len(own) // 2
            edited.append(own[: len(own) - half] + other[:half])
        second = sketches(tx.Texts.of(edited), size, words)
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([a[2] for a, _ in pairs], pa.int64()),
            "n_chars": pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
            "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited],
            "fingerprint": [encoded(a[4]) for a, _ in pairs],
            "edited_fingerprint": [encoded(x) for x in second],
            "near_edited": [resemblance(a[4], x, size) for (a, _), x in zip(pairs, second, strict=True)],
            "near_next": [resemblance(a[4], b[4], size) for a, b in pairs],
            "kept_by_edit": [containment(a[4], x, size) for (a, _), x in zip(pairs, second, strict=True)],
            "n_distinct": [distinct(a[4], size) for a, _ in pairs],
        })

    return _successors(docs, shuffle_partitions(docs.sparkSession)).mapInArrow(run, _OUT)
