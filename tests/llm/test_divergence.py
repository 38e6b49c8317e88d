"""Operator 11 against plain Python: exact shares, all pairs, best terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbrank.llm import divergence as dv
from plumbrank.llm import text as tx

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top=50, smooth=5):
    """rows: (lang, source, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, words = lang or "", source or "", TERM.findall((text or "").translate(lower))
        groups[lang].add(source)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = Counter()
        for s in sources:
            total.update({t: counts[lang, s][t] for t in kept})

        def share(c, kept=kept):
            of = sum(c[t] for t in kept) + smooth * len(kept)
            return {t: 1 + 10**9 * (c[t] + smooth) // of for t in kept}

        q, p = share(total), {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            best = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", best)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[: top if part == "term" else None])}
    return out


def result(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "élan", "ÉTÉ", "été", "日本", "x", "Zeta", "z" * 70, "k9k", "under_score", "a\u0085b"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s0", "s1", "s2", "s0", "é", None]), " ".join(rng.choices(words, k=rng.randrange(30)))) for _ in range(120)]
    rows += [("en", "s0", None), ("en", "empty", ""), ("en", "empty", "12 34"), ("solo", "s0", "one two"), ("", "", "Alpha"), ("xx", "a", "rare"), ("xx", "b", "rarer")]
    return rows + rows[:15]


@pytest.mark.parametrize(("terms", "sources"), [(4096, 256), (3, 2), (1, 1)])
def test_against_plain_python(spark, monkeypatch, terms, sources):
    monkeypatch.setattr(dv, "TILE_TERMS", terms)
    monkeypatch.setattr(dv, "TILE_SOURCES", sources)
    rows = corpus(terms)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "lang string, source string, text string, term int").repartition(5)
    assert result(dv.divergence(df, least_docs=8, top=4)) == brute(rows, 8, top=4)


def test_nothing_kept_and_no_rows(spark):
    rows = [("en", "a", "one"), ("en", "b", "two"), ("en", "c", None)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    found = result(dv.divergence_query(df))
    assert found == brute(rows, 30)
    assert {x[2] for x in found} == {"pair"} and {x[4] for x in found} == {0}
    assert dv.divergence_query(df.limit(0)).count() == 0


def test_very_long_texts_and_one_hot_source(spark):
    rows = [("en", "hot", "alpha Beta " * 40_000)] + [("en", "hot" if i % 3 else "cold", "alpha gamma" + "y" * (i * 1000)) for i in range(40)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert result(dv.divergence_query(df)) == brute(rows, 30)


def test_shares_are_exact_for_counts_of_terabytes():
    rng = random.Random(5)
    count = np.array([0, 1, 7, *(rng.randrange(10**13) for _ in range(200))], np.int64)
    for total, n in ((int(count.sum()), len(count)), (int(count.max()) * 3, 10**7)):
        want = [1 + 10**9 * (c + 5) // (total + 5 * n) for c in count.tolist()]
        assert dv.shares(count, np.int64(total), 5, n).tolist() == want
    assert dv.shares(np.array([4], np.int64), np.int64(4), 5, 1).tolist() == [10**9 + 1]


def test_terms_are_those_of_the_pattern():
    texts = ["Ab c-d É日 x1y", "", " ", "9", "ABC"]
    found, of = dv.terms(tx.Texts.of(texts))
    assert found.to_pylist() == ["ab", "c", "d", "É日", "x", "y", " ", "abc"]
    assert of.tolist() == [0] * 6 + [2, 4]
