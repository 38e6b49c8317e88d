"""Operator 8, toxicity: FTRL-proximal logistic regression over hashed word features.

Features are words, their stems (leading bytes, as insults inflect), neighbouring
pairs and pairs with one word between (skip-grams), hashed into 2^20 places; a
feature has a weight for its first, second and third occurrence in a text. Training keeps a learning rate
for each coordinate and an L1 term that leaves most weights exactly 0, so the model
is a short list of (place, weight) that any task can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

BITS = 20
#: Labelled documents that a fit sees at most, chosen by a hash of their ids.
TRAIN_ROWS = 12_000
EPOCHS = 3
#: Leading bytes of a word that make a stem.
STEMS = (6, 7)
#: Occurrences in a text that count, each with a weight of its own.
LEVELS = 3
#: Bytes of text whose features are made at once: some hundred bytes of arrays for each word.
FEATURE_BYTES = 512 << 10


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    positive: float = 3.0  # weight of an example with label 1, of which there are few
    epochs: int = EPOCHS


def features(texts: tx.Texts, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature places with the text that each belongs to (with repeats)."""
    low = texts.lowered()
    at = tx.spans(low, tx.ALNUM)
    w, doc = tx.span_hashes(low.data, at.starts, at.ends), at.text_of
    shift = np.uint64(64 - bits)
    places, owner = [w >> shift], [doc]
    for size in STEMS:
        long = at.ends - at.starts > size
        places.append(tx.combine(tx.span_hashes(low.data, at.starts[long], at.starts[long] + size), seed=23) >> shift)
        owner.append(doc[long])
    for gap, seed in ((1, 21), (2, 22)):
        if len(w) > gap:
            same = doc[gap:] == doc[:-gap]
            places.append(tx.combine(w[:-gap][same], w[gap:][same], seed=seed) >> shift)
            owner.append(doc[gap:][same])
    return np.concatenate(places).astype(np.int64), np.concatenate(owner)


def occurrences(at: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (place, text), with an entry for the first, second, ... occurrence: place + occurrence * 2^bits."""
    pair, count = np.unique(doc << bits | at, return_counts=True)
    level = np.minimum(count, LEVELS)
    pair, level = np.repeat(pair, level), tx.ragged(np.zeros(len(pair), np.int64), level)
    return (pair & ((1 << bits) - 1)) | level << bits, pair >> bits


def fit_rows(examples: Iterator[tuple[np.ndarray, int]] | list, params: Ftrl, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over (distinct feature places, label 0 or 1): places and values of the non-zero weights, and the bias."""
    z, n = np.zeros(LEVELS << bits), np.zeros(LEVELS << bits)
    bias_z = bias_n = 0.0
    rows = list(examples)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= params.l1, 0.0, -(zi - np.sign(zi) * params.l1) / ((params.beta + np.sqrt(ni)) / params.alpha + params.l2))

    for _ in range(params.epochs):
        for at, label in rows:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            bias = -bias_z / ((params.beta + bias_n**0.5) / params.alpha)
            p = 1.0 / (1.0 + np.exp(-min(max(w.sum() + bias, -35.0), 35.0)))
            g = (p - label) * (params.positive if label else 1.0)
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / params.alpha
            z[at], n[at] = zi + g - sigma * w, ni + g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / params.alpha * bias
            bias_n += g * g
    kept = np.flatnonzero(np.abs(z) > params.l1)
    return kept, weights(z[kept], n[kept]), -bias_z / ((params.beta + bias_n**0.5) / params.alpha)


@dataclass(frozen=True)
class Model:
    places: np.ndarray  # ascending
    weights: np.ndarray
    bias: float
    bits: int = BITS

    @cached_property
    def live(self) -> np.ndarray:
        """Whether a place has a weight at any level; made once for each worker that holds the model."""
        out = np.zeros(1 << self.bits, bool)
        out[self.places & ((1 << self.bits) - 1)] = True
        return out

    def scores(self, texts: tx.Texts) -> np.ndarray:
        at, doc = features(texts, self.bits)
        some = np.flatnonzero(self.live[at])
        at, doc = occurrences(at[some], doc[some], self.bits)
        total = np.zeros(len(texts))
        if len(at):
            where = np.minimum(np.searchsorted(self.places, at), len(self.places) - 1)
            total = np.bincount(doc, weights=np.where(self.places[where] == at, self.weights[where], 0.0), minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(total + self.bias, -35.0, 35.0)))


def held_out(id_column: str = "doc_id"):
    """Documents that no fit may learn from: crc32 of the id as text, modulo 5, is 0. Null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, params: Ftrl = Ftrl(), bits: int = BITS) -> Model:
    """Learn from at most `rows` labelled documents that aren't held out, in the order of a hash of their ids.

    Ids alone are ranked; the few that are chosen are broadcast (at most `rows`
    numbers) to fetch their texts, whose features meet in one task. Repeated labels
    of an id count once, as the highest; repeated documents of an id as the least
    text; null ids, labels and texts are left out. No labels: a model that says 0.5.
    """
    mine = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).filter(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out("_id"))
    chosen = mine.groupBy("_id").agg(F.max("_y").alias("_y")).withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(rows)
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t")).filter(F.col("_t").isNotNull())
    sample = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_h", "_y").agg(F.min("_t").alias("_t"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            for part, block in tx.blocks(batch, "_t", FEATURE_BYTES):
                at, doc = occurrences(*features(block, bits), bits)
                cut = np.searchsorted(doc, np.arange(len(block) + 1))
                at = at.astype(np.int32)  # one array for a block, of which examples are views: memory that goes back as a whole
                examples += [(at[a:b], y) for a, b, y in zip(cut[:-1].tolist(), cut[1:].tolist(), part.column(2).to_pylist(), strict=True)]
        places, values, bias = fit_rows(examples, params, bits)
        del examples
        tx.release()
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.append(places, -1), pa.int64()), "weight": pa.array(np.append(values, bias))})

    learned = sample.repartition(1).sortWithinPartitions("_h", "_id").mapInArrow(train, "place long, weight double").collect()
    places, values = np.array([r.place for r in learned], np.int64), np.array([r.weight for r in learned], float)
    return Model(places[places >= 0], values[places >= 0], float(values[places < 0].sum()), bits)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Append the probability of label 1 to the columns `keep` (default: all).

    Null and empty texts have the bias alone; whole texts count, in any language;
    repeated rows stay; a column named `into` is replaced. The model is broadcast:
    at most 2^bits places, and L1 leaves a small part of them.
    """
    kept = [x for x in (docs.columns if keep is None else keep) if x != into]
    schema = T.StructType([docs.schema[x] for x in kept] + [T.StructField(into, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in tx.blocks(batch, text, FEATURE_BYTES):
                yield tx.with_columns(part.select(kept), **{into: pa.array(shared.value.scores(texts))})

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5) for every row; null and empty texts have the bias's score."""
    found = score(docs, fit(docs, labels), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with their own columns, whatever these are named.

    Where nothing could be learned, nothing is known against any document, and all stay.
    """
    model = fit(docs, labels)
    if not len(model.places) and not model.bias:
        return docs
    return score(tx.packed(docs), model, into="score", keep=["own"]).filter(F.col("score") < threshold).select("own.*")
