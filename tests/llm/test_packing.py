"""Operator 12: every id is in one place, sequences are gapless and within their capacity, and few."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbrank.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def best_fit_plainly(lengths, capacity):
    """Numbers of bins that best fit, longest first, needs; and their fills."""
    bins = []
    for x in sorted(lengths, reverse=True):
        room = [b for b in range(len(bins)) if bins[b] + x <= capacity]
        if room:
            bins[max(room, key=lambda b: bins[b])] += x
        else:
            bins.append(x)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    lengths = np.array([rng.randint(1, capacity) for _ in range(400)])
    opener, place, filled = packing.best_fit(lengths, capacity)
    fills = {}
    for b in set(opener.tolist()):
        inside = sorted((int(place[i]), int(lengths[i])) for i in np.flatnonzero(opener == b))
        at = 0
        for start, size in inside:
            assert start == at
            at += size
        assert at <= capacity and place[b] == 0
        fills[b] = at
        assert (filled[opener == b] == at).all()
    assert sorted(fills.values()) == best_fit_plainly(lengths.tolist(), capacity)


def checked(rows, capacity, library, texts):
    """Asserts the contract for rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset); returns the number of sequences."""
    want = {}
    for doc, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        parts = [ids[a : a + capacity] for a in range(0, len(ids), capacity)]
        for i, part in enumerate(parts):
            x = (doc, i, i * capacity, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            want[x] = want.get(x, 0) + 1
    got, sequences = {}, {}
    for *x, sequence, offset in rows:
        got[tuple(x)] = got.get(tuple(x), 0) + 1
        sequences.setdefault(sequence, []).append((offset, x[3]))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def documents(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(1, 9)))
    texts = [(i, " ".join(word() for _ in range(int(rng.paretovariate(0.8)) % 900))) for i in range(n)]
    return [*texts, (n, None), (n + 1, ""), (None, "no id"), (3, "an id again"), (n + 2, "long " * 9000), (n + 3, "日本" * 4000), *texts[:5]]


@pytest.mark.parametrize(("parts", "capacity"), [(1, 2048), (9, 2048), (9, 16)])
def test_contract(spark, library, parts, capacity):
    texts = documents(parts + capacity, 150)
    df = spark.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, text string, item string").repartition(parts)
    found = packing.pack(df, PATH, capacity=capacity)
    rows = found.placed("doc_id", "piece", "start", "length", "ids").collect()
    rows = [(*r[:4], zlib.crc32(r.ids), *r[5:]) for r in rows]
    n = checked(rows, capacity, library, texts)
    assert n <= 1 + -(-sum(r[3] for r in rows) // capacity) * 1.02
    whole = {r.sequence_id: r for r in found.sequences().collect()}
    assert len(whole) == n and sum(r.n_pieces for r in whole.values()) == len(rows)
    for *_, crc, sequence, offset in rows:
        assert 4 * whole[sequence].n_tokens == len(whole[sequence].ids)
    one = rows[0]
    assert zlib.crc32(whole[one[5]].ids[4 * one[6] : 4 * (one[6] + one[3])]) == one[4]


def test_query(spark, library):
    texts = documents(2, 60)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert checked([tuple(r) for r in packing.packing_query(df, PATH).collect()], 2048, library, texts)
    assert packing.packing_query(df.limit(0), PATH).count() == 0


def test_rounds_find_what_tasks_could_not(spark, monkeypatch):
    """Tasks of a few pieces leave bins half empty; later rounds bring these together."""
    monkeypatch.setattr(packing, "LEAST_ITEMS", 10)
    rounds, one = [], packing._round
    monkeypatch.setattr(packing, "_round", lambda items, capacity: rounds.append(items) or one(items, capacity))
    df = spark.createDataFrame([(i, "a " * 99) for i in range(80)], "doc_id long, text string").repartition(3)
    found = packing.pack(df, PATH)
    assert len(rounds) > 1
    first = one(rounds[0], 2048).select("bin").distinct().count()
    fills = [r.n_tokens for r in found.sequences().collect()]
    assert sum(fills) == 8000 and 4 <= len(fills) < first and max(fills) <= 2048


def test_what_fits_nowhere_ends_the_rounds(spark):
    df = spark.createDataFrame([(i, "a " * 1100) for i in range(64)], "doc_id long, text string").repartition(8)
    assert packing.pack(df, PATH).places.select("sequence_id").distinct().count() == 64
