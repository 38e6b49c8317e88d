"""Dense search in cells, and injected models."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbrank.operators import cells, models, rerank, retrieve

IDS = "unit_id string, vector array<double>"


def clustered(seed, n, dims=8, centres=12, spread=0.05):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1, (centres, dims))[rng.integers(0, centres, n)] + rng.normal(0, spread, (n, dims))


def plainly(x, q, k, cosine):
    if cosine:
        x, q = (v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, n) for v in (x, q))
    scores = np.round(q @ x.T, 9)
    return [[(i, f"u{i:05d}") for i in sorted(range(len(x)), key=lambda j: (-row[j], f"u{j:05d}"))[:k]] for row in scores], scores


@pytest.mark.parametrize(("waves", "part_bytes", "cosine"), [(16, 64 << 20, True), (2, 4096, True), (2, 4096, False)])
def test_search_is_exact(spark, monkeypatch, waves, part_bytes, cosine):
    monkeypatch.setattr(cells, "TWO_WAVES", waves)
    monkeypatch.setattr(cells, "PART_BYTES", part_bytes)
    monkeypatch.setattr(cells, "CELL_ROWS", 20)
    x = clustered(1, 1500)
    x[100:400] = x[0]  # a hot vector: ties by id
    x[401] = 0.0
    q = np.concatenate([x[[0, 5, 700, 401]], clustered(2, 6)])
    units = spark.createDataFrame([(f"u{i:05d}", v.tolist()) for i, v in enumerate(x)] + [("none", None)], IDS).repartition(4)
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "query_id string, vector array<double>")
    r = retrieve.build("dense", normalize=cosine)
    r.index(units)
    got = {}
    for row in r.search(queries, 10).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.unit_id, row.score))
    want, scores = plainly(x, q, 10, cosine)
    for i, best in enumerate(want):
        assert [u for _, u, _ in sorted(got[f"q{i}"])] == [u for _, u in best], i
        assert [s for *_, s in sorted(got[f"q{i}"])] == pytest.approx([scores[i, j] for j, _ in best], abs=2e-9)


def test_most_cells_are_left_out():
    x, q = clustered(3, 20_000, 16, 40), clustered(3, 64, 16, 40)
    centres = cells.centres_of(x[:2000], 80)
    own = cells.nearest(x, centres)
    rows = []
    for c in np.unique(own).tolist():
        v = x[own == c]
        mean = v.mean(axis=0)
        rows.append({"ids": [f"u{i:05d}" for i in np.flatnonzero(own == c)], "vectors": v.tobytes(), "centre": mean.tobytes(), "radius": float(np.linalg.norm(v - mean, axis=1).max())})
    part = cells.Cells.of(rows)
    found = part.best(q, 10, np.full(len(q), -np.inf), False)
    want, _ = plainly(x, q, 10, False)
    assert [[part.names[i] for i in row] for row in found.ids] == [[u for _, u in best] for best in want]
    assert part.skipped > 0.7 * (part.skipped + part.compared)
    # With scores that another part found, still more is left out, and nothing that beats them.
    before = part.compared
    part.compared = 0
    again = part.best(q, 10, found.scores[:, 4].copy(), False)
    assert part.compared <= before and (again.ids[:, :4] == found.ids[:, :4]).all()


def test_centres_are_seeded_and_odd_samples_work():
    x = clustered(4, 500)
    assert (cells.centres_of(x, 9) == cells.centres_of(x, 9)).all()
    assert cells.centres_of(np.zeros((30, 3)), 5).shape == (1, 3)
    assert cells.centres_of(x[:1], 5).tolist() == x[:1].tolist()


def test_empty_tables(spark):
    units, queries = spark.createDataFrame([], IDS), spark.createDataFrame([("q", [1.0, 2.0])], "query_id string, vector array<double>")
    r = retrieve.build("dense")
    r.index(units)
    assert r.search(queries, 3).collect() == []
    r.index(spark.createDataFrame([("a", [1.0, 0.0])], IDS))
    assert r.search(queries.limit(0), 3).collect() == []
    assert [x.unit_id for x in r.search(queries, 3).collect()] == ["a"]


def test_calls_are_of_like_length_and_bounded():
    sizes = [5, 900, 3, 4, 800, 2, 10_000, 1]
    found = list(models.calls(sizes, 3, 1000))
    assert found == [[7, 5, 2], [3, 0, 4], [1], [6]] and sorted(i for c in found for i in c) == list(range(8))
    assert list(models.calls([], 3)) == []


def stub(folder):
    """A model that notes where it was loaded and what it was called with."""

    def load():
        open(os.path.join(folder, f"load-{os.getpid()}-{os.urandom(4).hex()}"), "w").close()

        def encode(texts):
            open(os.path.join(folder, f"call-{max(map(len, texts)) - min(map(len, texts))}-{len(texts)}-{os.urandom(4).hex()}"), "w").close()
            return [[len(t), t.count("e"), 1.0] for t in texts]

        return encode

    return load


def test_a_model_is_loaded_once_for_a_process(spark, tmp_path):
    rows = [(f"d{i:03d}", "e" * (i % 3) + "x" * ((i * 37) % 100)) for i in range(200)]
    units = spark.createDataFrame([*rows, ("null", None)], "doc_id string, text string").repartition(6)
    queries = spark.createDataFrame([("q", "exx")], "query_id string, text string")
    r = retrieve.build("dense", load=stub(str(tmp_path)), batch_size=8, normalize=False, query_prompt="e: ", document_prompt="x: ")
    got = [(x.doc_id, x.score) for x in retrieve.retrieve(r, units, queries, 5).orderBy("rank").collect()]
    q = np.array([6, 2, 1.0])
    score = {d: float(q @ [len(t) + 3, t.count("e"), 1.0]) for d, t in [*rows, ("null", "")]}
    assert got == sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]
    names = os.listdir(tmp_path)
    loads = [n.split("-")[1] for n in names if n.startswith("load")]
    assert len(loads) == len(set(loads)) <= 8
    spreads = [tuple(map(int, n.split("-")[1:3])) for n in names if n.startswith("call")]
    assert max(n for _, n in spreads) <= 8 and np.mean([s for s, n in spreads if n == 8]) < 40


def test_cross_encoder_restores_order(spark):
    r = rerank.build_reranker("cross_encoder", load=lambda: lambda a, b: [len(x) - len(y) for x, y in zip(a, b, strict=True)], batch_size=3)
    rows = [(i, "q" * (i % 5), "d" * ((i * 7) % 11) if i % 6 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, q string, d string")
    got = {x.i: x.s for x in df.select("i", r.score(F.col("q"), F.col("d")).alias("s")).collect()}
    assert got == {i: float(len(q) - len(d or "")) for i, q, d in rows}


def test_matrix_of_a_slice():
    assert cells.matrix(pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]).slice(1)).tolist() == [[3.0, 4.0], [5.0, 6.0]]
