"""Operator 13, hard-negative mining by branch and bound over ball trees.

Vectors are integers: their components are scaled and rounded down, and every score is
an exact inner product. They are dealt into parts of bounded size, and each part's
vectors of a label are a ball tree, built once and kept as a table.

A search gives each query a number of windows of scores. The inner product of a query q and
any vector of a node with centre c and radius r lies within q.c - |q|r and q.c + |q|r, so
a node is left out where that range misses the window, or lies strictly beneath the k-th
best score that the window has so far (equal scores go by id: there the least id of the node
decides). Queries travel to the parts in rows and pass by the part's trees as a stream, so a
task holds the trees of one part and a block of queries. The search runs in two waves: a
few parts first, whose k-th best scores then prune the nodes of all others.

Positives are a search with one open window among the trees of the query's own label;
negatives one with a window for each positive's score among the trees of other labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, shuffle_partitions
from . import text as tx

#: Vectors in a leaf, at most.
LEAF = 128
#: Bytes of a part's vectors in a search, about, and vectors of a part that is smaller so that all tasks have one.
PART_BYTES, PART_ROWS = 32 << 20, 4096
#: Queries that are compared at once.
QUERIES = 1024
#: Components beyond are set to it; scores beyond 64 bits likewise.
MOST = 1 << 53

_LOW, _HIGH = 1 - (1 << 63), (1 << 63) - 1
_TREE = "ids binary, points binary, kind string, centres binary, radii binary, nodes binary"
_WINDOW = "array<struct<name: bigint, low: bigint, high: bigint, kth: bigint, kth_id: bigint>>"


@dataclass
class BallTree:
    """Rows of `nodes` are (left, right, begin, end); leaves have no left and right, and node 0 is the root."""

    ids: np.ndarray
    points: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    nodes: np.ndarray

    def __post_init__(self):
        self.least = np.array([self.ids[a:b].min() for a, b in self.nodes[:, 2:].tolist()], np.int64)

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray) -> BallTree:
        """Halves a node along the line between two of its farthest points until it is a leaf, or all its points are equal."""
        x, order = points.astype(np.float64), np.argsort(ids, kind="stable")
        centres, radii, nodes, todo = [], [], [], [(0, len(ids), -1, 0)]
        while todo:
            begin, end, up, side = todo.pop()
            own = x[order[begin:end]]
            centre = own.mean(axis=0)
            away = np.linalg.norm(own - centre, axis=1)
            centres.append(centre)
            radii.append(away.max())
            nodes.append([-1, -1, begin, end])
            if up >= 0:
                nodes[up][side] = len(nodes) - 1
            if end - begin <= LEAF or not (own != own[0]).any():
                continue
            one = own[away.argmax()]
            line = own[np.linalg.norm(own - one, axis=1).argmax()] - one
            order[begin:end] = order[begin:end][np.argsort(own @ line, kind="stable")]
            middle = (begin + end) // 2
            todo += [(begin, middle, len(nodes) - 1, 0), (middle, end, len(nodes) - 1, 1)]
        return cls(ids[order], points[order], np.array(centres), np.array(radii), np.array(nodes, np.int64))

    def row(self) -> dict:
        return {"ids": self.ids.tobytes(), "points": self.points.tobytes(), "kind": self.points.dtype.str, "centres": self.centres.tobytes(), "radii": self.radii.tobytes(), "nodes": self.nodes.tobytes()}

    @classmethod
    def of(cls, row: dict) -> BallTree:
        ids, radii = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["radii"])
        return cls(ids, np.frombuffer(row["points"], row["kind"]).reshape(len(ids), -1), np.frombuffer(row["centres"]).reshape(len(radii), -1), radii, np.frombuffer(row["nodes"], np.int64).reshape(-1, 4))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors as int64, those beyond 64 bits set to the nearest."""
    most = [max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0)))) for v in (q, x)]
    bound = most[0] * most[1] * max(q.shape[1], 1)
    if bound < 1 << 53:
        return np.rint(q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return q.astype(np.int64) @ x.T.astype(np.int64)
    return np.clip(q.astype(object) @ x.T.astype(object), _LOW, _HIGH).astype(np.int64)


@dataclass
class Windows:
    """Windows of a block of queries, and the best k of each so far: scores descending, ids ascending."""

    query: np.ndarray
    low: np.ndarray
    high: np.ndarray
    scores: np.ndarray
    ids: np.ndarray
    floor: np.ndarray
    floor_id: np.ndarray

    @classmethod
    def of(cls, query: np.ndarray, low: np.ndarray, high: np.ndarray, kth: np.ndarray, kth_id: np.ndarray, k: int) -> Windows:
        n = len(query)
        return cls(query, low, high, np.full((n, k), _LOW), np.full((n, k), _HIGH), kth, kth_id)

    def kth(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id that a window's next must beat: the k-th so far here, or what the search began with."""
        s, i = self.scores[w, -1], self.ids[w, -1]
        given = (self.floor[w] > s) | ((self.floor[w] == s) & (self.floor_id[w] < i))
        return np.where(given, self.floor[w], s), np.where(given, self.floor_id[w], i)

    def push(self, w: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Take what vectors `ids` score in the windows w; a query (its id: own) isn't its own partner."""
        kth, kth_id = (x[:, None] for x in self.kth(w))
        better = (scores >= self.low[w, None]) & (scores <= self.high[w, None]) & (ids[None] != own[:, None])
        better &= (scores > kth) | ((scores == kth) & (ids[None] < kth_id))
        some = better.any(axis=1)
        w, better, k = w[some], better[some], self.scores.shape[1]
        s = np.concatenate([self.scores[w], np.where(better, scores[some], _LOW)], axis=1)
        i = np.concatenate([self.ids[w], np.where(better, ids[None], _HIGH)], axis=1)
        best = np.lexsort((i, -s), axis=1)[:, :k]
        self.scores[w], self.ids[w] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)


def visit(tree: BallTree, q: np.ndarray, own: np.ndarray, windows: Windows, of: np.ndarray) -> int:
    """Search a tree for the windows `of`; returns how many leaves were compared with any."""
    dots, norms = q.astype(np.float64) @ tree.centres.T, np.linalg.norm(q.astype(np.float64), axis=1)
    # Scores are whole numbers, so bounds are too; what rounding may have taken is given back.
    away = norms[:, None] * tree.radii[None]
    spare = 1e-9 * (np.abs(dots) + away + norms[:, None] * np.linalg.norm(tree.centres, axis=1)[None]) + 1e-6
    upper, lower = (np.clip(x, float(_LOW), float(_HIGH)) for x in (np.floor(dots + away + spare), np.ceil(dots - away - spare)))
    todo, seen = [(0, of)], 0
    while todo:
        node, w = todo.pop()
        a = windows.query[w]
        kth, kth_id = windows.kth(w)
        u = upper[a, node]
        w = w[(u >= windows.low[w]) & (lower[a, node] <= windows.high[w]) & ((u > kth) | ((u == kth) & (tree.least[node] < kth_id)))]
        if not len(w):
            continue
        left, right, begin, end = tree.nodes[node].tolist()
        if left < 0:
            seen += 1
            queries, at = np.unique(windows.query[w], return_inverse=True)
            for b in range(begin, end, LEAF):  # equal points are a leaf of any size
                e = min(b + LEAF, end)
                windows.push(w, products(q[queries], tree.points[b:e])[at], tree.ids[b:e], own[windows.query[w]])
        else:  # the more promising child comes first
            a = windows.query[w]
            todo += [(left, w), (right, w)] if upper[a, left].sum() < upper[a, right].sum() else [(right, w), (left, w)]
    return seen


def _integers(rows: DataFrame, scale: float) -> DataFrame:
    """(id, label, anchor, dims, width, vector): scaled vectors as raw integers of `width` bytes; rows that take no part are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                vectors = part.column(3)
                sizes = vectors.value_lengths().to_numpy()
                x = np.clip(np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * scale), -MOST, MOST).astype("<i8")
                each = np.split(x, np.cumsum(sizes)[:-1])
                most = np.array([np.abs(v).max(initial=0) for v in each])
                width = np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))
                raw = [v.astype(f"<i{w}").tobytes() for v, w in zip(each, width.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(sizes.astype(np.int32)), pa.array(width.astype(np.int32)), pa.array(raw, pa.binary())], names=["id", "label", "anchor", "dims", "width", "vector"])

    whole = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.filter(whole).filter(finite).mapInArrow(run, "id long, label long, anchor boolean, dims int, width int, vector binary")


def _matrix(width: np.ndarray, raw: list[bytes], dims: int) -> np.ndarray:
    """Vectors of the same length, in the narrowest type that holds them all."""
    out = np.empty((len(raw), dims), f"<i{int(width.max())}")
    for w in np.unique(width).tolist():
        some = np.flatnonzero(width == w)
        out[some] = np.frombuffer(b"".join(raw[i] for i in some), f"<i{w}").reshape(len(some), dims)
    return out


def _trees(vectors: DataFrame, parts: int) -> DataFrame:
    """(part, label, dims, and a tree): vectors are dealt out by their row numbers, whatever their ids and values."""

    def build(table: pa.Table) -> pa.Table:
        dims = table["dims"][0].as_py()
        tree = BallTree.build(table["id"].to_numpy(), _matrix(table["width"].to_numpy(), table["vector"].to_pylist(), dims))
        return pa.Table.from_pylist([{"part": table["part"][0].as_py(), "label": table["label"][0].as_py(), "dims": dims, **tree.row()}], schema)

    schema = pa.schema([("part", pa.int32()), ("label", pa.int64()), ("dims", pa.int32()), ("ids", pa.binary()), ("points", pa.binary()), ("kind", pa.string()), ("centres", pa.binary()), ("radii", pa.binary()), ("nodes", pa.binary())])
    dealt = vectors.withColumn("part", F.pmod("row", F.lit(parts)).cast("int"))
    return dealt.groupBy("part", "label", "dims").applyInArrow(build, f"part int, label long, dims int, {_TREE}")


def _search(trees: DataFrame, queries: DataFrame, k: int, same: bool, first: int, last: int) -> DataFrame:
    """(query, name, score, id): the k best that each of the parts `first` to `last` - 1 has for each window.

    queries: row, id, label, dims, width, vector, windows. same: trees of the query's label, or else of all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, BallTree]] = []
        for batch in batches:
            at = batch.num_rows - int(np.count_nonzero(batch.column("row").is_valid().to_numpy(zero_copy_only=False)))  # trees come first
            held += [(x["label"], x["dims"], BallTree.of(x)) for x in batch.slice(0, at).to_pylist()]
            while at < batch.num_rows:
                yield _answers(held, batch.slice(at, QUERIES), k, same)
                at += QUERIES
        tx.release()

    part = F.col("part")
    some = trees.filter((part >= first) & (part < last)).withColumns({"part": part - first, "id": F.lit(None).cast("long"), "row": F.lit(None).cast("long"), "width": F.lit(None).cast("int"), "vector": F.lit(None).cast("binary"), "windows": F.lit(None).cast(_WINDOW)})
    asked = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(last - first - 1))))
    columns = ["part", "label", "dims", *(x.split()[0] for x in _TREE.split(", ")), "row", "id", "width", "vector", "windows"]
    both = some.select(*columns).unionByName(asked.select("part", "label", "dims", "row", "id", "width", "vector", "windows"), allowMissingColumns=True)
    return both.repartitionById(last - first, "part").sortWithinPartitions(F.asc_nulls_first("row"), "label", "dims").mapInArrow(run, "query long, name long, score long, id long")


def _answers(held: list[tuple[int, int, BallTree]], asked: pa.RecordBatch, k: int, same: bool) -> pa.RecordBatch:
    """What the trees of a part have for the windows of some queries."""
    row, own, label, dims, width = (asked.column(x).to_numpy() for x in ("row", "id", "label", "dims", "width"))
    windows, raw = asked.column("windows"), asked.column("vector").to_pylist()
    many = windows.value_lengths().to_numpy()
    fields = dict(zip(("name", "low", "high", "kth", "kth_id"), (x.to_numpy(zero_copy_only=False) for x in windows.flatten().flatten()), strict=True))
    of, found = np.repeat(np.arange(len(row)), many), []
    for size in np.unique(dims).tolist():
        these = np.flatnonzero(dims == size)
        q = _matrix(width[these], [raw[i] for i in these], size)
        mine = np.flatnonzero(dims[of] == size)
        query = np.searchsorted(these, of[mine])
        w = Windows.of(query, *(fields[x][mine] for x in ("low", "high", "kth", "kth_id")), k)
        for tree_label, tree_dims, tree in held:
            if tree_dims == size:
                visit(tree, q, own[these], w, np.flatnonzero((label[these][query] == tree_label) == same))
        r, c = np.nonzero((w.ids != _HIGH) | (w.scores != _LOW))
        found.append((row[these][query[r]], fields["name"][mine][r], w.scores[r, c], w.ids[r, c]))
    return pa.RecordBatch.from_pydict({x: pa.array(np.concatenate([f[i] for f in found])) for i, x in enumerate(("query", "name", "score", "id"))})


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query", "name").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _top(trees: DataFrame, parts: int, queries: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """(query, name, rank, score, id): the k best in each window (query, name, low, high), in two waves over the parts."""

    def ask(some: DataFrame) -> DataFrame:
        asked = some.groupBy("query").agg(F.collect_list(F.struct("name", "low", "high", "kth", "kth_id")).alias("windows"))
        return queries.join(asked.withColumnRenamed("query", "row"), "row")

    start = windows.withColumns({"kth": F.lit(_LOW), "kth_id": F.lit(_HIGH)})
    first = max(1, math.isqrt(parts))
    found = materialise(_best(_search(trees, ask(start), k, same, 0, first), k), "wave")
    if first < parts:
        kth = found.filter(F.col("rank") == k).select("query", "name", F.col("score").alias("_kth"), F.col("id").alias("_id"))
        raised = start.join(kth, ["query", "name"], "left").withColumns({"kth": F.coalesce("_kth", "kth"), "kth_id": F.coalesce("_id", "kth_id")})
        rest = _search(trees, ask(raised), k, same, first, parts)
        found = materialise(_best(found.drop("rank").unionByName(rest), k), "found")
    return found


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, id_: str = "vec_id", label: str | Column = "label", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows that `anchor` marks.

    An anchor's positives are its `positives` best rows of the same label; a positive's
    negatives are the `negatives` best rows of other labels that score `low` to `high` percent
    of it. Scores are inner products of components rounded down after scaling; equal scores
    go by the lesser id. A row with a null id, label, vector or component, or one that is not finite,
    takes no part. Vectors of unlike lengths don't meet; empty ones all score 0. Rows that
    repeat an id are rows like others, but none is a partner of an anchor with its id. A negative
    positive score leaves no window, 0 that of 0 alone. Other columns are not read; an empty table
    gives none. Scaled components beyond 2^53 are set to it, scores beyond 64 bits likewise.
    """
    label = F.col(label) if isinstance(label, str) else label
    given = rows.select(F.col(id_).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("vector"))
    vectors = materialise(_integers(given, scale), "vectors").withColumn("row", F.monotonically_increasing_id())
    n, size = vectors.agg(F.count(F.lit(1)), F.sum(F.length("vector"))).first()
    parts = max(1, -(-(size or 0) // PART_BYTES), min(shuffle_partitions(rows.sparkSession), -(-n // PART_ROWS)))
    anchors = materialise(vectors.filter("anchor").drop("anchor"), "anchors")
    trees = materialise(_trees(vectors, parts), "trees")
    all_ = anchors.select(F.col("row").alias("query"), F.lit(0).cast("long").alias("name"), F.lit(_LOW).alias("low"), F.lit(_HIGH).alias("high"))
    near = _top(trees, parts, anchors, all_, positives, True)
    score = F.col("name").cast("decimal(20,0)")
    windows = near.select("query", F.col("score").alias("name")).distinct().filter("name >= 0")
    windows = windows.select("query", "name", F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high"))
    far = _top(trees, parts, anchors, windows, negatives, False)
    pairs = near.select("query", F.col("score").alias("name"), F.col("id").alias("positive_id")).join(far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}), ["query", "name"])
    return pairs.join(anchors.select(F.col("row").alias("query"), F.col("id").alias("anchor_id")), "query").select("anchor_id", "positive_id", "rank", "negative_id", F.col("name").alias("positive_score"), "negative_score")


def negatives_query(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every hundredth vector, with a seventh of the labels shifted."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings, F.col("vec_id") % 100 == 0, label=label)


def oracle_sql() -> str:
    """All scores of the anchors, which are a hundredth of the rows, and two rankings over them."""
    return """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS x
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
            CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
        WHERE a.vec_id % 100 = 0
    ), p AS (
        SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
    ), n AS (
        SELECT p.*, s.other AS negative_id, s.score AS negative_score,
            CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
        WHERE 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
    )
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """
