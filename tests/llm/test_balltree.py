"""Operator 13 against all inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbrank.llm import balltree as bt

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=10):
    """rows: (vec_id, vector, label) as the contract has them."""
    kept = []
    for at, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((at, i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for at, i, v, label in kept:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for b, j, w, other in kept if j != i and len(w) == len(v))
        near = [(-s, j) for s, j, other in scored if other == label][:positives]
        far = [(-s, j) for s, j, other in scored if other != label]
        for ps, p in near:
            hits = [(s, j) for s, j in far if 30 * ps <= 100 * s <= 90 * ps][:negatives]
            out += [(i, p, r + 1, j, ps, s) for r, (s, j) in enumerate(hits)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def vectors(seed, n, dims=6, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize(("seed", "spread", "part_rows"), [(1, 1.0, 4096), (2, 0.1, 60), (3, 0.0, 50), (4, 2.0, 30)])
def test_against_all_pairs(spark, monkeypatch, seed, spread, part_rows):
    monkeypatch.setattr(bt, "PART_ROWS", part_rows)  # several parts: two waves
    rows = vectors(seed, 700, spread=spread)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert result(bt.negatives_query(df)) == brute(rows)


def test_nulls_ties_repeats_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(bt, "PART_ROWS", 20)
    rows = vectors(5, 150, dims=3)
    same = [(1000 + i, [1.0, 2.0, 0.5], i % 3) for i in range(60)]  # equal vectors: ties by id, and anchors 1000
    odd = [(200, None, 1), (300, [1.0, None, 2.0], 1), (400, [float("nan"), 1.0, 1.0], 2), (500, [float("inf"), 1.0, 1.0], 2), (600, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    other = [(700, [1.0, 2.0], 1), (701, [1.0, 1.0], 1), (702, [0.5, 0.5], 2), (800, [], 1), (801, [], 1), (802, [], 2), (900, [0.0] * 3, 3), (-100, [-1.0, -2.0, 0.0], 1), (-101, [-0.5, -0.5, -0.5], 1)]
    rows = rows + same + odd + other + rows[:12] + [(5, [9.0, 9.0, 9.0], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", row string").repartition(4)
    got = result(bt.negatives_query(df))
    assert got == brute(rows)
    assert len(got) > 200 and not {200, 300, 400, 500, 600} & {r[0] for r in got}
    assert bt.negatives_query(df.limit(0)).count() == 0


def test_large_components(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([1, -1]) * 10.0 ** rng.randrange(0, 6) for _ in range(4)], i % 3) for i in range(210)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(bt.negatives_query(df)) == brute(rows)
    huge = spark.createDataFrame([(i, [3e38, 1.0], i % 2) for i in range(4)], SCHEMA)
    got = bt.hard_negatives(huge, F.col("vec_id") == 0, low=0, high=100).collect()
    assert {r.negative_id for r in got} == {1, 3} and {r.positive_score for r in got} == {(1 << 63) - 1}


def test_products_are_exact():
    rng = np.random.default_rng(7)
    for most in (1 << 15, 1 << 30, 1 << 40):
        q, x = rng.integers(-most, most, (5, 9)), rng.integers(-most, most, (7, 9))
        want = [[max(-(1 << 63) + 1, min((1 << 63) - 1, sum(a * b for a, b in zip(u, v, strict=True)))) for v in x.tolist()] for u in q.tolist()]
        assert bt.products(q, x).tolist() == want


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold_and_prune(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 100, (12, 8))
    points = np.floor(centres[rng.integers(0, 12, 4000)] + rng.normal(0, 4, (4000, 8))).astype(np.int64)
    tree = bt.BallTree.build(np.arange(4000), points)
    assert sorted(tree.ids.tolist()) == list(range(4000))
    for node, (_, _, a, b) in enumerate(tree.nodes.tolist()):
        assert (np.linalg.norm(tree.points[a:b] - tree.centres[node], axis=1) <= tree.radii[node] * (1 + 1e-9) + 1e-9).all()
    q = points[:16]
    scores = bt.products(q, tree.points)
    leaves = int((tree.nodes[:, 0] < 0).sum())
    low, high = np.quantile(scores, 0.3, axis=1).astype(np.int64), np.quantile(scores, 0.6, axis=1).astype(np.int64)
    none, least = np.full(16, bt._LOW), np.full(16, bt._HIGH)
    for lo, hi in ((low, high), (none, least)):
        w = bt.Windows.of(np.arange(16), lo, hi, none, least, 5)
        seen = sum(bt.visit(tree, q, np.full(16, -1), w, np.array([i])) for i in range(16))
        assert seen < 0.7 * 16 * leaves
        for i in range(16):
            fits = [(-s, j) for s, j in zip(scores[i].tolist(), tree.ids.tolist(), strict=True) if lo[i] <= s <= hi[i]]
            assert [(-s, j) for s, j in zip(w.scores[i].tolist(), w.ids[i].tolist(), strict=True)] == sorted(fits)[:5]
    # What the search began with prunes too, and its answers are then only those that beat it.
    floor, floor_id = w.scores[:, 2].copy(), w.ids[:, 2].copy()
    again = bt.Windows.of(np.arange(16), none, least, floor, floor_id, 5)
    bt.visit(tree, q, np.full(16, -1), again, np.arange(16))
    assert (again.scores[:, :2] == w.scores[:, :2]).all() and (again.ids[:, :2] == w.ids[:, :2]).all() and (again.ids[:, 2] == bt._HIGH).all()
