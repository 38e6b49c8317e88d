"""Operator 7, n-gram Jaccard self-join through prefix trees.

Documents are sets of word shingles; two link when their Jaccard similarity is at
least a threshold. The join is exact and never lists the pairs of a group:

1. Each text becomes its sorted shingle hashes. Equal sets are one class.
2. Support filter. In hash order, the first (1 - t) n + l shingles of linked sets
   share at least l. Only those first shingles are exchanged, as rows, and read in
   their sorted order as a stream, to learn which occur in another set; a set with
   too few of them has no link and is done. Most documents end here.
3. The remaining sets count their shingles, by partial aggregation. Of those that occur
   in another set, each set has a prefix in the global order, rare shingles first; linked
   sets share a shingle of their prefixes. Sets that share one, directly or over others,
   form a bundle, and no link leads out of one. A bundle that is too large for a task is
   dealt in pairs of blocks, or by shingle where that sends fewer sets.
4. A task holds a bundle (or a pair of blocks) as a radix tree of its globally ordered
   sets, frequent shingles first. Each set walks down to the sets that share a rare shingle
   with it: what sets have in common is compared once, subtrees whose remaining lengths
   cannot reach the threshold are cut, and so are those that are already in the set's own
   component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialise, shuffle_partitions
from . import text as tx
from .components import connected_components

#: Sets in a block at most, and bytes of their shingles on average; a larger bundle is dealt out.
BLOCK_SETS, BLOCK_BYTES = 4000, 8 << 20
#: Blocks of a bundle only to spread it more evenly, at most: each of them is a copy of the bundle.
EVEN_BLOCKS = 4
#: Candidates whose ids are broadcast to fetch their texts, at most; more of them meet the texts in a shuffle.
BROADCAST_ROWS = 500_000


def needed(n: np.ndarray | int, percent: int):
    """Shingles that a linked set of n has in common with its partner, at least."""
    return -(-n * percent // 100)


def support(n: np.ndarray | int, percent: int) -> tuple:
    """Size of the exchanged prefix, and how many of it must occur in another set."""
    spare = n - needed(n, percent)
    partner = needed(n, percent)  # the least size of a partner
    return np.minimum(n, 2 * spare + 1), np.minimum(spare, partner - needed(partner, percent)) + 1


def class_key(x: np.ndarray) -> bytes:
    """128 bits that name a set."""
    if not len(x):
        return b""
    a, b = x * np.uint64(0x9E3779B97F4A7C15), tx.mix64(x ^ np.uint64(0x5851F42D4C957F2D))
    return np.array([a.sum(), b.sum() + np.uint64(len(x))], "<u8").tobytes()


def shingle_sets(texts: tx.Texts, words: int) -> list[np.ndarray]:
    texts = texts.lowered()
    at = tx.spans(texts, tx.NOT_SPACE)
    return tx.distinct_by_text(*tx.shingles(tx.span_hashes(texts.data, at.starts, at.ends), at.first, words))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def _rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, key, short, tokens) of each document: the set's size, name, 63 bits of the name, and exchanged prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in tx.blocks(batch, "text"):
                found = shingle_sets(texts, words)
                keys = [class_key(x) for x in found]
                short = [int.from_bytes(k[:8], "little") >> 1 for k in keys]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(keys, pa.binary()), pa.array(short, pa.int64()), _lists([x[: support(len(x), percent)[0]] for x in found])], names=["doc_id", "n", "key", "short", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, key binary, short long, tokens array<long>")


def _keyed(texts: DataFrame, words: int) -> DataFrame:
    """The rows with the name of their text's set in place of the text."""
    names = [x for x in texts.columns if x != "text"]
    schema = T.StructType([*(texts.schema[x] for x in names), T.StructField("key", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in tx.blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), pa.array([class_key(x) for x in shingle_sets(block, words)], pa.binary())], names=[*names, "key"])

    return texts.select(*names, "text").mapInArrow(run, schema)


def _whole(texts: DataFrame, words: int) -> DataFrame:
    """(set, tokens): the whole sets of rows (set, key, text) whose text is of the class that `key` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in tx.blocks(batch, "text"):
                found = shingle_sets(block, words)
                own = [i for i, (x, want) in enumerate(zip(found, part.column("key").to_pylist(), strict=True)) if class_key(x) == want]
                yield pa.RecordBatch.from_arrays([part.column("set").take(pa.array(own, pa.int64())), _lists([found[i] for i in own])], names=["set", "tokens"])

    return texts.select("set", "key", "text").mapInArrow(run, "set long, tokens array<long>")


def _supported(rows: DataFrame, percent: int) -> DataFrame:
    """(short) of classes that may have a link: enough shingles of their prefix occur in another class.

    A shingle goes out once for a batch of sets, whatever the number of them that have
    it (then for no class by name), so a very frequent one is as many rows as there are
    batches. What a batch knows of its classes by itself goes along as a row of its own.
    Shingles arrive sorted and pass by as a stream: a task's memory hangs neither on the
    number of partitions nor on any shingle. A class in several batches may count a shingle
    twice, and two whose 63 bits clash count as one: that keeps a set too many. Only if such
    two shared shingles would they not be told apart: with 10^10 classes a chance of 1 in 10^9.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once = {k: i for i, k in reversed(list(enumerate(batch.column("key").to_pylist())))}  # of equal sets the first speaks
            batch = batch.take(pa.array(sorted(once.values()), pa.int64()))
            name, n = batch.column("short").to_numpy(), batch.column("n").to_numpy()
            tokens = batch.column("tokens")
            token, owner = tokens.flatten().to_numpy(), np.repeat(np.arange(len(name)), tokens.value_lengths().to_numpy())
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            fresh = np.append(True, token[1:] != token[:-1])
            first = np.flatnonzero(fresh)
            many = np.diff(np.append(first, len(token))) > 1
            count = np.bincount(owner[many[np.cumsum(fresh) - 1]], minlength=len(name))
            yield pa.RecordBatch.from_pydict({
                "token": pa.array(np.concatenate([token[first], tx.mix64(name.view(np.uint64)).view(np.int64)])),
                "short": pa.array(np.concatenate([np.where(many, -1, name[owner[first]]), name])),
                "own": pa.array(np.concatenate([np.zeros(len(first), np.int64), count << 32 | support(n, percent)[1]])),
            })
        tx.release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # of the last shingle: itself, the last class that has it, whether it is shared, whether that class was not told so
        for batch in batches:
            token, name, own = (batch.column(i).to_numpy() for i in range(3))
            head = own > 0
            names, counts, needs = [name[head]], [own[head] >> 32], [own[head] & 0xFFFFFFFF]
            token, name = token[~head], name[~head]
            if len(token):
                if last is not None:
                    token, name = np.append(last[0], token), np.append(last[1], name)
                start = np.append(True, token[1:] != token[:-1])
                first = np.flatnonzero(start)
                shared = (name[first] != name[np.append(first[1:], len(token)) - 1]) | (name[first] < 0)
                shared[0] |= last is not None and last[2]
                told = (start | np.append(True, name[1:] != name[:-1])) & shared[np.cumsum(start) - 1] & (name >= 0)
                told[0] &= last is None or last[3]
                last = token[-1], name[-1], bool(shared[-1]), not shared[-1]
                names.append(name[told])
                counts.append(np.ones(len(names[1]), np.int64))
                needs.append(np.zeros(len(names[1]), np.int64))
            yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(v)) for k, v in (("short", names), ("count", counts), ("need", needs))})
        tx.release()

    sent = rows.select("short", "n", "key", "tokens").mapInArrow(pack, "token long, short long, own long")
    met = sent.repartition(shuffle_partitions(rows.sparkSession), "token").sortWithinPartitions("token", "short").mapInArrow(meet, "short long, count long, need long")
    return met.groupBy("short").agg(F.sum("count").alias("count"), F.max("need").alias("need")).filter("count >= need").select("short")


def _prefixes(whole: DataFrame, percent: int) -> DataFrame:
    """(set, token): the prefix of each set in the global order, rare shingles first, equal ones by hash.

    Sets that link share a shingle of these prefixes. Only shingles of two sets or more
    are ordered: a set that has too few of them for a link is left out.
    """
    every = whole.select("set", "n", F.explode("tokens").alias("token"))
    often = materialise(every.groupBy("token").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "frequencies")
    least = F.ceil(F.col("n") * percent / 100).cast("int")
    ordered = every.join(often, "token").groupBy("set", "n").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("o"))
    return ordered.filter(F.size("o") >= least).select("set", F.explode(F.slice("o", F.lit(1), F.size("o") - least + 1)["token"]).alias("token"))


class PrefixTree:
    """A radix tree over ascending token sequences; node arrays, children as lists."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.tokens: list[np.ndarray] = [np.zeros(0, np.int64)]  # of the edge above a node
        self.depth, self.children, self.ends = [0], [[]], [-1]  # ends: the set that ends in a node
        self.least, self.most = [0], [0]
        path, last = [0], np.zeros(0, np.int64)
        for i in order:
            x = sets[i]
            m = min(len(x), len(last))
            differ = np.flatnonzero(x[:m] != last[:m])
            common = int(differ[0]) if len(differ) else m
            while self.depth[path[-1]] > common:
                below = path.pop()
                if self.depth[path[-1]] < common:  # split the edge
                    up, cut = path[-1], common - self.depth[path[-1]]
                    middle = self._node(self.tokens[below][:cut], common)
                    self.children[up][self.children[up].index(below)] = middle
                    self.children[middle].append(below)
                    self.tokens[below] = self.tokens[below][cut:]
                    path.append(middle)
            if len(x) == self.depth[path[-1]]:
                self.ends[path[-1]] = i
            else:
                leaf = self._node(x[common:], len(x))
                self.children[path[-1]].append(leaf)
                self.ends[leaf] = i
                path.append(leaf)
            last = x
        self.node_of = {i: node for node, i in enumerate(self.ends) if i >= 0}
        self.above = [-1] * len(self.depth)
        for node, below in enumerate(self.children):
            for c in below:
                self.above[c] = node
        self.label = list(self.ends)  # a set of the node's component where all below are in one, else -1
        for node in self.bottom_up():
            sizes = [self.least[c] for c in self.children[node]] + [self.most[c] for c in self.children[node]]
            sizes += [self.depth[node]] if self.ends[node] >= 0 else []
            self.least[node], self.most[node] = (min(sizes), max(sizes)) if sizes else (0, 0)
            if self.children[node]:
                self.label[node] = -1

    def _node(self, tokens: np.ndarray, depth: int) -> int:
        self.tokens.append(tokens)
        self.depth.append(depth)
        self.children.append([])
        self.ends.append(-1)
        self.least.append(0)
        self.most.append(0)
        return len(self.depth) - 1

    def bottom_up(self) -> list[int]:
        out, stack = [], [0]
        while stack:
            node = stack.pop()
            out.append(node)
            stack += self.children[node]
        return out[::-1]


def links(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the link graph of distinct, non-empty sets of hashes: pairs of indices.

    side: with two blocks of sets, only what connects them is looked for beyond what
    each walk meets; links within a block may be found or not.
    """
    if len(sets) < 2:
        return []
    size = np.array([len(x) for x in sets], np.int64)
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    flat = rank[which]
    ordered = [np.sort(x) for x in np.split(flat, np.cumsum(size)[:-1])]
    tree = PrefixTree(ordered)
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # Sets that link share one of their rarest shingles: only these are walked to.
    rare = [x[needed(len(x), percent) - 1 :].tolist() for x in ordered]
    holders: dict[int, list[int]] = {}
    for i, x in enumerate(rare):
        for t in x:
            holders.setdefault(t, []).append(i)
    whole = {}  # a set of the component that all holders of a shingle are in

    def partners(i: int) -> set[int]:
        """Sets of other components that share a rare shingle with set i."""
        own, out = find(i), set()
        for t in rare[i]:
            if t in whole and find(whole[t]) == own:
                continue
            roots = {j: find(j) for j in holders[t]}
            if len(set(roots.values())) == 1:
                whole[t] = i
            out.update(j for j, r in roots.items() if r != own)
        return out

    mine, out = np.zeros(len(count), bool), []
    walkers = range(len(sets)) if side is None else np.flatnonzero(side == 0).tolist()
    for i in walkers:
        near = partners(i)
        if not near:
            continue
        paths = set()
        for j in near:
            node = tree.node_of[j]
            while node >= 0 and node not in paths:
                paths.add(node)
                node = tree.above[node]
        x, n = ordered[i], len(ordered[i])
        mine[x] = True
        stack, visited = [(0, 0)], []
        while stack:
            node, overlap = stack.pop()
            label = tree.label[node]
            if node not in paths or (label >= 0 and find(label) == find(i)):
                continue
            tokens = tree.tokens[node]
            if len(tokens):
                overlap += int(np.count_nonzero(mine[tokens]))
                left = n - int(np.searchsorted(x, tokens[-1], side="right"))
            else:
                left = n
            depth = tree.depth[node]
            best = min(max(depth + left, tree.least[node]), tree.most[node])
            if (100 + percent) * (overlap + min(best - depth, left)) < percent * (n + best):
                continue
            end = tree.ends[node]
            if end >= 0 and find(end) != find(i) and (100 + percent) * overlap >= percent * (n + depth):
                parent[find(end)] = find(i)
                out.append((i, end))
            if tree.children[node]:
                visited.append(node)
                stack += [(c, overlap) for c in tree.children[node]]
        mine[x] = False
        for node in reversed(visited):  # children come after their parents
            below = {find(tree.label[c]) if tree.label[c] >= 0 else -1 for c in tree.children[node]}
            if tree.ends[node] >= 0:
                below.add(find(tree.ends[node]))
            if len(below) == 1 and -1 not in below:
                tree.label[node] = below.pop()
    return out


def _blocks(sets: Column, size: Column, total: int, tasks: int, limit: int) -> Column:
    """Blocks of a bundle: no block passes the bounds, and up to `EVEN_BLOCKS` its pairs are as many as its share of all tasks."""
    share = F.sqrt(2.0 * tasks * size / F.lit(float(max(total, 1))))
    return F.ceil(F.greatest(sets / limit, size / BLOCK_BYTES, F.least(share, F.lit(float(EVEN_BLOCKS))))).cast("int")


def _bundles(postings: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """(set, kind, bundle, blocks): each pair of sets that share a shingle of their prefixes meets in a bundle.

    Bundles are closed under sharing. One that has more blocks than its sets have
    prefix shingles to be dealt by (of shingles that the same sets hold, one) goes by shingle.
    """
    tasks = shuffle_partitions(postings.sparkSession)
    least = materialise(postings.groupBy("token").agg(F.min("set").alias("m"), F.max("set").alias("x")).filter("m <> x").select("token", "m"), "least")
    near = connected_components(postings.join(least, "token").select(F.col("set").alias("a"), F.col("m").alias("b")).distinct())
    member = materialise(near.select(F.col("node").alias("set"), F.col("component").alias("bundle")).join(sizes, "set"), "members")
    size = member.groupBy("bundle").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("size"))
    total = size.agg(F.sum("size")).first()[0] or 0
    size = materialise(size.withColumn("blocks", _blocks(F.col("sets"), F.col("size"), total, tasks, limit)), "bundles")
    closed = size
    by_shingle = None
    if size.filter("blocks > 1").limit(1).count():
        wide = postings.join(member.join(size.filter("blocks > 1").select("bundle"), "bundle"), "set")
        held = wide.groupBy("bundle", "token").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("set")).alias("x"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("y"))
        chosen = held.filter("sets > 1").groupBy("bundle", "sets", "size", "x", "y").agg(F.min("token").alias("token"))
        chosen = materialise(chosen.withColumn("blocks", _blocks(F.col("sets"), F.col("size"), total, tasks, limit)).select("bundle", "token", "sets", "blocks"), "shingles")
        cost = chosen.groupBy("bundle").agg(F.sum(F.col("sets") * F.col("blocks")).alias("cost"))
        dealt = materialise(size.join(cost, "bundle").filter("cost < sets * blocks").select("bundle"), "dealt")
        closed = size.join(dealt, "bundle", "left_anti")
        by_shingle = postings.join(chosen.join(dealt, "bundle").select("token", "blocks"), "token").select("set", F.lit(1).alias("kind"), F.col("token").alias("bundle"), "blocks")
    whole = member.select("set", "bundle").join(closed.select("bundle", "blocks"), "bundle").select("set", F.lit(0).alias("kind"), "bundle", "blocks")
    return whole if by_shingle is None else whole.unionByName(by_shingle)


def _joined(bundles: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between sets: a spanning forest of each bundle's links. bundles: set, tokens, kind, bundle, blocks."""
    blocks, own = F.col("blocks"), F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    seats = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), own.alias("own")))
    dealt = bundles.select("kind", "bundle", "set", "tokens", F.explode(seats).alias("seat")).select("kind", "bundle", "set", "tokens", "seat.*")

    def join(table: pa.Table) -> pa.Table:
        names, own = table["set"].to_numpy(), table["own"].to_numpy()
        tokens = table["tokens"].combine_chunks()
        ends = np.cumsum(tokens.value_lengths().to_numpy())
        sets = np.split(tokens.flatten().to_numpy(), ends[:-1])
        two = table["i"][0].as_py() != table["j"][0].as_py()
        found = np.array(links(sets, percent, (own != own[0]).astype(int) if two else None), np.int64).reshape(-1, 2)
        if len(names) > 100:
            tx.release()
        return pa.table({"a": pa.array(names[found[:, 0]]), "b": pa.array(names[found[:, 1]])})

    return dealt.groupBy("kind", "bundle", "i", "j").applyInArrow(join, "a long, b long")


def _components(docs: DataFrame, words: int, percent: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, key), and classes (key, rep, copies, component_id, component_key) of named, non-empty sets.

    A component's id is its least doc_id, its key that of the class with it, the least of
    several. Both are tables in the shared folder.
    """
    rows = materialise(_rows(docs, words, percent), "sets")
    named = rows.filter("doc_id is not null and n > 0")
    classes = materialise(named.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("short").alias("short")), "classes")
    reps = materialise(classes.join(_supported(named, percent), "short").select(F.monotonically_increasing_id().alias("set"), "key", "rep"), "candidates")

    few = reps.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(F.broadcast(reps) if few else reps, "rep").select("set", "key", "text")
    whole = _whole(texts, words).dropDuplicates(["set"])
    whole = materialise(whole.select("set", F.size("tokens").cast("long").alias("n"), "tokens"), "whole-sets")
    postings = materialise(_prefixes(whole, percent), "postings")
    bundles = _bundles(postings, whole.select("set", (F.col("n") * 8).alias("size")), limit)
    linked = connected_components(_joined(whole.join(bundles, "set"), percent))

    member = linked.select(F.col("node").alias("set"), "component").join(reps, "set")
    least = member.groupBy("component").agg(F.min(F.struct("rep", "key")).alias("of"))
    found = member.join(least, "component").select("key", F.col("of.rep").alias("component_id"), F.col("of.key").alias("component_key"))
    return rows.select("doc_id", "n", "key"), materialise(classes.join(found, "key", "left").withColumns({"component_id": F.coalesce("component_id", "rep"), "component_key": F.coalesce("component_key", "key")}), "components")


def _with_components(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The columns of rows, component_id and component_key; rows without a class are their own component.

    A class with more rows than a quarter of a task's fair share may be a hot key. There are at
    most four times as many of them as partitions, so they are broadcast.
    """
    fair = (classes.agg(F.sum("copies")).first()[0] or 0) // (4 * shuffle_partitions(rows.sparkSession))
    found = classes.select("key", "copies", "component_id", "component_key")
    large = F.broadcast(found.filter(F.col("copies") > fair).drop("copies"))
    named = rows.filter("doc_id is not null and n > 0")
    alone = rows.filter("doc_id is null or n = 0").withColumns({"component_id": F.col("doc_id"), "component_key": F.col("key")})
    hot = named.join(large, "key").select(*rows.columns, "component_id", "component_key")
    rest = named.join(large.select("key"), "key", "left_anti").join(found.filter(F.col("copies") <= fair).drop("copies"), "key").select(*rows.columns, "component_id", "component_key")
    return rest.unionByName(hot).unionByName(alone)


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, limit: int = BLOCK_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of documents.

    Two documents link when 100 * |A and B| >= percent * |A or B| over their sets of
    lower-cased word shingles; component_id is the least doc_id that links reach. Null
    and empty texts have no shingles and are their own component; a text of fewer
    than `words` words has one shingle; repeated rows stay; a null doc_id reaches
    nobody and has a null component. Other columns are not read. limit: sets in a block at most.
    """
    rows, classes = _components(docs, words, percent, limit)
    return _with_components(rows, classes).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def near_duplicates_removed(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """One row of each component, with the columns of docs: that with the least doc_id, of several the least set's least text.

    Rows are told apart by id and set, so a text that shares its id with a removed one stays.
    Null ids come last; null and empty texts link with nothing and all stay, repeated ones too.
    Rows are looked up by their sets, whatever their ids: only sets of several rows, and those that
    go, are listed. A list that is too long to be broadcast meets the rows in a shuffle, but
    for the sets of very many rows.
    """
    last = F.lit((1 << 63) - 1)
    own = F.coalesce(F.col("doc_id").cast("long"), last)
    rows, classes = _components(docs.select(own.alias("doc_id"), "text"), words, percent, BLOCK_SETS)
    stays = F.expr("rep = component_id and key = component_key")
    listed = classes.filter(~stays | (F.col("copies") > 1)).select("key", "copies", F.when(stays, F.col("rep")).alias("_stays"))
    again = rows.join(listed.filter("_stays is not null"), "key").filter("doc_id = _stays").groupBy("key").agg((F.count(F.lit(1)) > 1).alias("_again"))
    listed = materialise(listed.join(again, "key", "left"), "listed")
    # The caller's columns travel in one, so that none can clash with those of this plan.
    keyed = _keyed(docs.select(own.alias("_id"), "text", F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("_own")), words)
    if listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = keyed.join(F.broadcast(listed), "key", "left")
    else:
        fair = (classes.agg(F.sum("copies")).first()[0] or 0) // (4 * shuffle_partitions(docs.sparkSession))
        large = F.broadcast(listed.filter(F.col("copies") > fair))
        few = keyed.join(large.select("key"), "key", "left_anti").join(listed.filter(F.col("copies") <= fair), "key", "left")
        found = keyed.join(large, "key").unionByName(few)
    kept = found.filter("copies is null or _id = _stays")
    once = kept.filter(~F.coalesce("_again", F.lit(False))).select("_own.*")
    return once.unionByName(kept.filter("_again").groupBy("key").agg(F.min_by("_own", "_own.text").alias("_own")).select("_own.*"))
