"""Operator 7 against brute force."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbrank.llm import components, jaccard, text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(x, words=4):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), x or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1) if w else 0)}


def brute(rows, words=4, percent=85):
    """Counter of (doc_id, n_shingles, component_id), by an inverted index over all shingles."""
    sets = [shingles(x, words) for _, x in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    places = defaultdict(list)
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        common = Counter(j for t in s for j in places[t])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for t in s:
            places[t].append(i)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return Counter((name, len(sets[i]), None if name is None else least[find(i)]) for i, (name, _) in enumerate(rows))


@pytest.fixture(scope="module")
def planted():
    """Near copies around the threshold, exact copies, a shared passage, awkward rows."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6)))
    passage, rows = [word() for _ in range(60)], []
    for group in range(12):
        base = [word() for _ in range(rng.choice((1, 3, 4, 5, 30, 90, 200)))]
        for _ in range(rng.choice((1, 2, 5, 25))):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy += [word() for _ in range(len(copy) // 20)]
            rows.append(" ".join(copy))
            if rng.random() < 0.2:
                rows.append(rows[-1].upper().replace(" ", "\n "))
    rows += [" ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)]) for _ in range(40)]
    rows = [(i * 3 % 1009, x) for i, x in enumerate(rows)]
    return rows + [(5000, None), (5001, ""), (None, rows[0][1]), (None, None), (rows[3][0], rows[3][1]), (rows[4][0], "another text under a known id"), (5002, " \n ")]


@pytest.mark.parametrize("limit", [4000, 7])
def test_components_are_brute_force(spark, planted, limit):
    docs = spark.createDataFrame(planted, "doc_id long, text string").withColumn("component_id", __import__("pyspark").sql.functions.lit("clash"))
    got = Counter(map(tuple, jaccard.jaccard_components(docs, limit=limit).collect()))
    want = brute(planted)
    assert got == want
    assert len({c for _, _, c in want}) < len(planted) - 20


def test_five_words_and_four_fifths(spark, planted):
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    assert Counter(map(tuple, jaccard.jaccard_components(docs, 5, 80).collect())) == brute(planted, 5, 80)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter(map(tuple, jaccard.jaccard_components(docs).collect())) == want


def test_one_of_each_group_stays(spark, planted):
    """By row: a text that shares its id with another document's is no copy of it, and copies without an id go."""
    rows = planted + [(None, planted[0][1] + " more words of its own at the end of it"), (5000, None)]
    docs = spark.createDataFrame([(*r, i, i, i) for i, r in enumerate(rows)], "doc_id long, text string, _first int, key int, _id int")
    kept = jaccard.near_duplicates_removed(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert all((r.doc_id, r.text) == rows[r._first] and r._first == r.key == r._id for r in kept)  # own columns come back as they were
    by_row = Counter((i, c) for i, _, c in brute([(i, x) for i, (_, x) in enumerate(rows)]))
    group = {i: c for i, c in by_row}
    last = lambda i: (rows[i][0] is None, rows[i][0])
    full = [r._first for r in kept if shingles(r.text)]
    assert sorted(group[i] for i in full) == sorted({group[i] for i, (_, x) in enumerate(rows) if shingles(x)})
    assert all(last(i) == min(last(j) for j in group if group[j] == group[i]) for i in full)
    assert sorted(r._first for r in kept if not shingles(r.text)) == [i for i, (_, x) in enumerate(rows) if not shingles(x)]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(none).count() == 0
    assert jaccard.near_duplicates_removed(none).count() == 0


def test_tree_walk_finds_all_links():
    rng = np.random.default_rng(3)
    base = text.mix64(np.arange(4000))
    sets = []
    for g in range(30):
        core = rng.choice(base, rng.integers(1, 80), replace=False)
        for _ in range(8):
            x = core[rng.random(len(core)) > 0.06]
            sets.append(np.unique(np.concatenate([x, rng.choice(base, 2)])))
    sets = [np.frombuffer(x, np.uint64) for x in {x.tobytes() for x in sets if len(x)}]

    def roots(pairs):
        parent = list(range(len(sets)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in pairs:
            parent[find(i)] = find(j)
        return Counter(tuple(i for i in range(len(sets)) if find(i) == r) for r in map(find, range(len(sets))))

    every = [(i, j) for i in range(len(sets)) for j in range(i) if 185 * len(np.intersect1d(sets[i], sets[j])) >= 85 * (len(sets[i]) + len(sets[j]))]
    assert roots(jaccard.links(sets, 85)) == roots(every)


def test_components_of_a_path_a_star_and_a_ring(spark):
    path = [(i, i + 1) for i in range(1, 40)]
    star = [(100, 100 + i) for i in range(1, 50)]
    ring = [(200 + i, 200 + (i + 1) % 17) for i in range(17)] + [(300, 300)]
    edges = spark.createDataFrame(path + star + ring, "a long, b long")
    got = dict(components.connected_components(edges).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, **{100 + i: 100 for i in range(50)}, **{200 + i: 200 for i in range(17)}}
    assert components.connected_components(edges.limit(0)).count() == 0


def _staying(rows, words, percent):
    """Indices of rows (id, text) that one plain pass over all pairs keeps."""
    sets = []
    for _, text in rows:
        w = [x for x in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()]
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))) if w else frozenset())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return sets, group


def test_removal_with_null_and_repeated_ids(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices("abcdefghijklmnopqrst", k=40)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(None, t) for t in base[:3]] + [(None, base[0] + " x")] + [(None, "only here " * 9)] * 3 + [(7, base[2]), (7, "an id again with a text of its own")]
    rows += [(3, base[3])] * 4 + [(None, None), (None, ""), (5, ""), (5, None)] + [(100 + i, base[5] + " y") for i in range(20)]
    df = spark.createDataFrame([(*r, {"m": 1}, "k") for r in rows], "doc_id long, text string, extra map<string,int>, key string").repartition(4)
    got = Counter((r.doc_id, r.text) for r in jaccard.near_duplicates_removed(df, 4, 85).collect())
    sets, group = _staying(rows, 4, 85)
    want = Counter()
    for g in set(group):
        members = [i for i, x in enumerate(group) if x == g]
        if not sets[members[0]]:
            want.update(rows[i] for i in members)
            continue
        best = min(((rows[i][0] is None, rows[i][0] or 0, rows[i][1]) for i in members))
        want[None if best[0] else best[1], best[2]] += 1
    assert got == want


@pytest.mark.parametrize("limit", [500_000, 1])
def test_removal_without_ids_is_linear(spark, monkeypatch, limit):
    """Rows without an id are looked up by their sets: ten times the rows take no hundred times as long."""
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", limit)
    took = []
    for n in (3_000, 30_000):
        text = F.concat_ws(" ", *[F.md5(F.concat(F.lit(f"{i}-"), (F.col("id") - F.when(F.col("id") % 10 == 0, 1).otherwise(0)).cast("string"))) for i in range(8)])
        df = spark.range(1, n + 1).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"))
        began = time.time()
        assert jaccard.near_duplicates_removed(df, 5, 80).count() == n - n // 10
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 10
