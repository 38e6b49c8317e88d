"""Exact top-k search over dense vectors in cells.

Vectors are clustered around centres that a seeded k-means finds on a bounded sample;
a cell is a cluster, or a share of one that is large, with its own mean and radius r. By the
triangle inequality no vector of a cell scores more than q.c + |q|r against a query q, so a
cell is left out for a query whose k-th best score lies above that. Queries travel to the cells as rows and
pass by as a stream: neither queries nor units ever reach the driver, but for the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import PLACES
from ..session import materialise, shuffle_partitions

#: The sample for centres: rows, and bytes of their vectors, at most; rounds of k-means, and its seed.
SAMPLE_ROWS, SAMPLE_BYTES, ROUNDS, SEED = 8192, 16 << 20, 6, 20261127
#: Vectors of a cell, about; bytes of a task's cells; queries that are compared at once; searches of so many tasks run in two waves.
CELL_ROWS, PART_BYTES, QUERIES, TWO_WAVES = 256, 64 << 20, 1024, 16

_CELL = "cell long, part int, ids array<string>, vectors binary, centre binary, radius double"


def centres_of(sample: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    """k-means of a sample: seeded starts among its distinct rows, a few rounds; empty clusters go."""
    rows = np.unique(sample, axis=0)
    centres = rows[np.sort(np.random.default_rng(seed).permutation(len(rows))[:k])]
    for _ in range(ROUNDS if len(centres) > 1 else 0):
        own = nearest(sample, centres)
        some = np.unique(own)
        centres = np.stack([sample[own == c].mean(axis=0) for c in some.tolist()])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None] - 2 * (x @ centres.T), axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


@dataclass
class Best:
    """The best k of each query so far: scores descending, equal ones by the place of their ids."""

    scores: np.ndarray
    ids: np.ndarray

    def push(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        some = (scores >= self.scores[queries, -1][:, None]).any(axis=1)
        queries, scores, k = queries[some], scores[some], self.scores.shape[1]
        s = np.concatenate([self.scores[queries], scores], axis=1)
        i = np.concatenate([self.ids[queries], np.broadcast_to(ids, scores.shape)], axis=1)
        best = np.lexsort((i, -s), axis=1)[:, :k]
        self.scores[queries], self.ids[queries] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)


@dataclass
class Cells:
    """Cells of one part; `places` are the units' places in the order of their ids."""

    names: np.ndarray
    places: list[np.ndarray]
    vectors: list[np.ndarray]
    centres: np.ndarray
    radii: np.ndarray
    compared: int = 0
    skipped: int = 0

    @classmethod
    def of(cls, rows: list[dict]) -> Cells:
        ids = [x for r in rows for x in r["ids"]]
        order = sorted(range(len(ids)), key=lambda i: ids[i].encode())
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        sizes = np.array([len(r["ids"]) for r in rows])
        vectors = [np.frombuffer(r["vectors"]).reshape(n, -1) for r, n in zip(rows, sizes.tolist(), strict=True)]
        return cls(np.array(ids, object)[order], np.split(place, np.cumsum(sizes)[:-1]), vectors, np.stack([np.frombuffer(r["centre"]) for r in rows]), np.array([r["radius"] for r in rows]))

    def best(self, q: np.ndarray, k: int, floor: np.ndarray, single: bool) -> Best:
        """floor: scores that the k-th best has at least, as another search found."""
        found = Best(np.full((len(q), k), -np.inf), np.full((len(q), k), len(self.names)))
        norms, dots = np.linalg.norm(q, axis=1), q @ self.centres.T
        size = norms[:, None] * (np.linalg.norm(self.centres, axis=1) + self.radii)[None]
        bound = dots + norms[:, None] * self.radii[None] + (1e-5 if single else 1e-9) * (1 + size)
        first = bound.argmax(axis=1)
        for own in (True, False):  # each query starts with its most promising cell
            for c in np.argsort(-bound.max(axis=0), kind="stable").tolist():
                wanted = np.flatnonzero((first == c) == own)
                active = wanted[bound[wanted, c] >= np.maximum(found.scores[wanted, -1], floor[wanted])]
                self.compared += len(active)
                self.skipped += len(wanted) - len(active)
                if not len(active):
                    continue
                x = self.vectors[c]
                score = (q[active].astype(np.float32) @ x.astype(np.float32).T).astype(float) if single else q[active] @ x.T
                found.push(active, np.round(score, PLACES), self.places[c])
        return found


def build(vectors: DataFrame) -> DataFrame:
    """Cells of rows (unit_id, vector), a row for each: `part` says which task of a search has it."""
    spark = vectors.sparkSession
    vectors = materialise(vectors.select(F.col("unit_id").cast("string").alias("unit_id"), "vector"), "vectors")
    n, dims = vectors.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], _CELL)
    sampled = vectors.orderBy(F.xxhash64("unit_id", F.lit(SEED)), "unit_id").limit(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(dims, 1))))).select("vector").toArrow()
    sample = matrix(sampled["vector"].combine_chunks())
    centres = centres_of(sample, max(1, min(len(sample) // 8, 2 * math.isqrt(n), -(-n // CELL_ROWS) * 4)))
    parts = max(1, -(-n * 8 * dims // PART_BYTES), min(shuffle_partitions(spark), -(-n // (4 * CELL_ROWS))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(nearest(matrix(batch.column(1)), centres).astype(np.int64)), *batch.columns], names=["cluster", "unit_id", "vector"])

    def cell(rows: pa.Table) -> pa.Table:
        x = matrix(rows["vector"].combine_chunks())
        mean = x.mean(axis=0)
        name = rows["cell"][0].as_py()
        return pa.table({"cell": pa.array([name], pa.int64()), "part": pa.array([name % parts], pa.int32()), "ids": pa.array([rows["unit_id"].to_pylist()], pa.list_(pa.string())), "vectors": pa.array([x.tobytes()], pa.binary()), "centre": pa.array([mean.tobytes()], pa.binary()), "radius": pa.array([float(np.linalg.norm(x - mean, axis=1).max())])})

    assigned = materialise(vectors.mapInArrow(assign, "cluster long, unit_id string, vector array<double>"), "assigned")
    # A large cluster is several cells, dealt by id. Cells are numbered one after the other, so parts are even.
    shares = assigned.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / (2 * CELL_ROWS)).alias("shares")).withColumn("before", F.sum("shares").over(Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)))
    named = assigned.join(F.broadcast(shares), "cluster").withColumn("cell", F.coalesce("before", F.lit(0)) + F.pmod(F.xxhash64("unit_id"), F.col("shares")))
    return materialise(named.groupBy("cell").applyInArrow(cell, _CELL), "cells")


def search(cells: DataFrame, queries: DataFrame, k: int, single: bool) -> DataFrame:
    """(query_id, unit_id, score): the k best units of each part for queries (query_id, vector)."""
    parts = (cells.agg(F.max("part")).first()[0] or 0) + 1
    queries = materialise(queries, "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], None
        for batch in batches:
            at = int(np.count_nonzero(batch.column("ids").is_valid().to_numpy(zero_copy_only=False)))  # cells come first
            held += batch.slice(0, at).select(["ids", "vectors", "centre", "radius"]).to_pylist()
            for lo in range(at, batch.num_rows, QUERIES) if held else ():
                part = part or Cells.of(held)
                some = batch.slice(lo, QUERIES)
                found = part.best(matrix(some.column("vector")), k, some.column("floor").to_numpy(), single)
                q, place = np.nonzero(found.ids < len(part.names))
                yield pa.RecordBatch.from_pydict({"query_id": some.column("query_id").take(pa.array(q)), "unit_id": pa.array(part.names[found.ids[q, place]], pa.string()), "score": pa.array(found.scores[q, place])})

    def wave(first: int, last: int, asked: DataFrame) -> DataFrame:
        some = cells.filter((F.col("part") >= first) & (F.col("part") < last)).drop("cell")
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
        both = some.unionByName(asked, allowMissingColumns=True).withColumn("part", F.col("part") - first)
        return both.repartitionById(last - first, "part").sortWithinPartitions(F.asc_nulls_first("query_id"), "radius").mapInArrow(run, "query_id string, unit_id string, score double")

    low = F.lit(float("-inf"))
    if parts < TWO_WAVES:
        return wave(0, parts, queries.withColumn("floor", low))
    early = math.isqrt(parts)
    found = materialise(wave(0, early, queries.withColumn("floor", low)), "early")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    floor = found.withColumn("_place", place).filter(F.col("_place") == k).select("query_id", F.col("score").alias("floor"))
    return found.unionByName(wave(early, parts, queries.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", low))))
