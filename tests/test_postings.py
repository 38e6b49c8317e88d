"""Block postings against plain scoring: any number of segments, parts and waves."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from plumbrank.functions import scoring, text
from plumbrank.operators import postings, retrieve

WORDS = [f"w{i:03d}" for i in range(300)]


def zipf_texts(seed, n, longest=60):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [" ".join(rng.choices(WORDS, weights, k=rng.randint(1, longest))) for _ in range(n)]


def bm25_plainly(texts, query, method, k1=1.5, b=0.75):
    """Score of each text, as the formulas have it."""
    toks = [t.split() for t in texts]
    n, avgdl = len(toks), sum(map(len, toks)) / len(toks)
    df = Counter(w for t in toks for w in set(t))
    out = []
    for t in toks:
        tf, s = Counter(t), 0.0
        for w in query.split():
            if not df[w]:
                continue
            odds = (n - df[w] + 0.5) / (df[w] + 0.5)
            idf = {"lucene": math.log(1 + odds), "robertson": math.log(max(1, odds)), "atire": math.log(n / df[w]), "bm25+": math.log((n + 1) / df[w]), "bm25l": math.log((n + 1) / (df[w] + 0.5))}[method]
            absent = scoring.bm25_absent(method, k1)
            s += idf * ((scoring.bm25_tf(method, k1, b, tf[w], len(t), avgdl) if tf[w] else 0.0) + absent)
        out.append(s)
    return out


@pytest.mark.parametrize(("method", "parts", "waves"), [("lucene", 1, 16), ("lucene", 12, 2), ("robertson", 5, 2), ("atire", 9, 2), ("bm25+", 7, 2), ("bm25l", 3, 16)])
def test_bm25_is_exact_in_segments_parts_and_waves(spark, monkeypatch, method, parts, waves):
    monkeypatch.setattr(postings, "LEAST_POSTINGS", 50)
    monkeypatch.setattr(postings, "PART_POSTINGS", 400)
    monkeypatch.setattr(postings, "TWO_WAVES", waves)
    texts = zipf_texts(parts, 400)
    texts += texts[:30] + [texts[7]] * 40  # ties, and a hot text
    units = spark.createDataFrame([(f"u{i:04d}", t) for i, t in enumerate(texts)], "unit_id string, text string").repartition(parts)
    asked = {"rare": "w290 w250 w200", "common": "w000 w001 w002", "mixed": "w000 w003 w150 w299 w299", "itself": texts[7], "none": "nothing here"}
    queries = spark.createDataFrame(list(asked.items()), "query_id string, text string")
    r = retrieve.build("bm25", method=method, stopwords=None)
    r.index(units)
    got = {}
    for x in r.search(queries, 10).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.unit_id, x.score))
    for q, words in asked.items():
        scores = bm25_plainly(texts, words, method)
        want = sorted((-round(s, 9), f"u{i:04d}") for i, s in enumerate(scores))[:10]
        assert [(i, u) for i, u, _ in sorted(got[q])] == [(i + 1, u) for i, (_, u) in enumerate(want)], q
        assert [s for *_, s in sorted(got[q])] == pytest.approx([-s for s, _ in want], abs=2e-9)


@pytest.mark.parametrize("dtype", ["float64", "float32"])
def test_tfidf_is_exact_in_segments_and_waves(spark, monkeypatch, dtype):
    monkeypatch.setattr(postings, "LEAST_POSTINGS", 50)
    monkeypatch.setattr(postings, "TWO_WAVES", 2)
    texts = zipf_texts(3, 120, 25) + ["É日本 ok", "", "ab", "é日本 OK", None]
    texts += texts[:20]
    units = spark.createDataFrame([(f"u{i:04d}", t) for i, t in enumerate(texts)], "unit_id string, text string").repartition(6)
    asked = {"a": texts[3], "b": "w010 w011", "c": "日本", "d": "É日本 ok zzz"}
    r = retrieve.build("tfidf", dtype=dtype)
    r.index(units)
    got = {}
    for x in r.search(spark.createDataFrame(list(asked.items()), "query_id string, text string"), 7).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.unit_id, x.score))
    grams = lambda t: Counter(t.lower()[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)) if t else Counter()
    docs = [grams(t) for t in texts]
    df = Counter(g for d in docs for g in d)
    idf = {g: math.log((1 + len(docs)) / (1 + n)) + 1 for g, n in df.items()}
    vector = lambda c: {g: (1 + math.log(n)) * idf[g] for g, n in c.items() if g in idf}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1.0
    vectors = [vector(d) for d in docs]
    for q, t in asked.items():
        v = vector(grams(t))
        cos = [sum(w * d.get(g, 0.0) for g, w in v.items()) / norm(v) / norm(d) for d in vectors]
        shown = [round(float(np.float32(s)) if dtype == "float32" else s, 9) for s in cos]
        want = sorted((-s, f"u{i:04d}") for i, s in enumerate(shown))[:7]
        if dtype == "float64":
            assert [u for _, u, _ in sorted(got[q])] == [u for _, u in want], q
        assert [s for *_, s in sorted(got[q])] == pytest.approx([-s for s, _ in want], abs=2e-7 if dtype == "float32" else 2e-9)


def blocks_of(texts, impact):
    """Blocks of one segment of texts."""
    rows = pa.table({"unit_id": [f"u{i:06d}" for i in range(len(texts))], "terms": pa.array([t.split() for t in texts], pa.list_(pa.string())), "stop": pa.array([0] * len(texts), pa.int32())})
    made, units = postings._of_terms(5, rows)
    names = ["segment", "term", "n", "data"]
    rows = made.select(names).take(pa.array(sorted(range(made.num_rows), key=lambda i: (made["term"][i].as_py(), made["at"][i].as_py()))))
    return postings.Blocks.of([units.select(names), rows], postings.COUNTED, impact), units["units"][0].as_py()


def test_blocks_are_left_out(monkeypatch):
    texts = zipf_texts(11, 20_000, 80)
    avgdl = sum(len(t.split()) for t in texts) / len(texts)
    blocks, units = blocks_of(texts, lambda of, units: scoring.bm25_tf("lucene", 1.5, 0.75, of["tf"].astype(float), units["dl"].astype(float), avgdl))
    at = {u: i for i, u in enumerate(units)}
    df = Counter(w for t in texts for w in set(t.split()))
    for words, share in (("w299 w280 w000 w001", 0.8), ("w050 w000 w002 w001 w004", 0.4), ("w150 w151 w152 w000", 0.8)):
        query = [(w, math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5))) for w in words.split()]
        blocks.scored = blocks.skipped = 0
        _, doc, _, shown = blocks.best(query, 10, 0.0, postings.shown_as("float64", 0.0), postings.SPARE, False)
        want = sorted((-round(s, 9), at[f"u{i:06d}"]) for i, s in enumerate(bm25_plainly(texts, words, "lucene")))[:10]
        assert sorted(zip((-shown).tolist(), doc.tolist(), strict=True))[:10] == [(pytest.approx(s, abs=2e-9), d) for s, d in want]
        assert blocks.skipped > share * (blocks.scored + blocks.skipped), words
        # The threshold of another part leaves out more.
        before, least = blocks.scored, -want[4][0]
        blocks.scored = blocks.skipped = 0
        _, doc, _, _ = blocks.best(query, 10, least, postings.shown_as("float64", 0.0), postings.SPARE, False)
        assert blocks.scored <= before and {d for s, d in want if s < -least - 1e-8} <= set(doc.tolist())


def test_blocks_are_left_out_before_the_shuffle(spark):
    """Thresholds that another wave found leave out blocks of the terms that add little."""
    units = spark.createDataFrame([(f"u{i:05d}", t) for i, t in enumerate(zipf_texts(12, 12_000, 60))], "unit_id string, text string").repartition(3)
    r = retrieve.build("bm25", stopwords=None)
    r.index(units)
    ix = r.share()
    bound = scoring.bm25_tf("lucene", 1.5, 0.75, F.col("most_tf").cast("double"), F.col("least_dl").cast("double"), F.lit(ix.mean_length(False)))
    blocks = ix.postings.filter("term in ('w000', 'w150')").withColumn("_bound", bound)
    known = spark.createDataFrame([("q", "w000", 0.5, 0.0), ("q", "w150", 4.0, 0.0), ("r", "w000", 0.5, 0.0)], "query_id string, term string, w double, offset double")
    bounds = {x.term: x.most for x in blocks.groupBy("term").agg(F.max("_bound").alias("most")).collect()}
    least = spark.createDataFrame([("q", 4.0 * bounds["w150"] + 0.4 * bounds["w000"]), ("r", 0.45 * bounds["w000"])], "query_id string, least double")
    kept = postings.worthwhile(blocks, known, least, F.broadcast)
    want = blocks.filter("(term = 'w000' and _bound >= %.17g) or (term = 'w150' and 4 * _bound >= %.17g)" % (0.8 * bounds["w000"] - 1e-5, 4 * bounds["w150"] - 0.1 * bounds["w000"] - 1e-4))
    assert 0 < kept.count() == want.count() < blocks.count()
    assert postings.worthwhile(blocks, known, least.filter("query_id = 'r'"), F.broadcast).count() == blocks.count()


def test_a_search_opens_only_files_of_its_terms(spark):
    """Files follow the terms that are asked for; the most frequent term is spread over several."""
    rows = [(f"u{i:05d}", f"common x{i:05d} y{i % 50:02d}") for i in range(4000)]
    r = retrieve.build("bm25", stopwords=None)
    r.index(spark.createDataFrame(rows, "unit_id string, text string").repartition(40))
    ix = r.share()
    files = {x.term: list(range(x.first, x.last + 1)) for x in ix.terms.collect()}
    assert len(ix.files) == 8 and max(map(len, files.values())) >= 1
    assert len(files["x00007"]) == 1
    opened = lambda *terms: len(ix.of(sorted({f for t in terms for f in files[t]})).inputFiles())
    assert opened("x00007") == 1 and opened("x00007", "x03999") == 2 and opened("x00007", "x00008") == 1
    assert {x.term for x in ix.of(files["x00007"]).select("term").collect()} >= {"x00007"}
    firsts = [ix.of([i]).selectExpr("min(term)", "max(term)").first() for i in range(8)]
    assert all(a[1] <= b[0] for a, b in zip(firsts, firsts[1:], strict=False))  # ranges of terms


def test_grams_are_all_substrings():
    wide = ["".join(chr(0x4E00 + i) for i in range(5000)), "".join(chr(0x4E00 + i) for i in range(0, 5000, 7))]
    for texts, low in ((["abcab", "", "ab", "É日本a", "x" * 7], 3), (wide, 1), ([], 3)):
        order = np.arange(len(texts))[::-1]
        gram, doc, tf, words = postings.grams_of(texts, order, low, 5)
        assert (np.diff(gram) >= 0).all() and len(set(words.to_pylist())) == len(words)
        got = {(int(order[d]), words[g].as_py()): n for g, d, n in zip(gram.tolist(), doc.tolist(), tf.tolist(), strict=True)}
        assert got == Counter((d, t[i : i + n]) for d, t in enumerate(texts) for n in range(low, 6) for i in range(len(t) - n + 1))


def test_a_shared_index_serves_any_scoring(spark):
    units = spark.createDataFrame([(f"u{i}", f"the cat {'and ' * (i % 3)}sat on w{i % 4}") for i in range(30)], "unit_id string, text string")
    queries = spark.createDataFrame([("q", "the cat w1"), ("r", "and on")], "query_id string, text string")
    first = retrieve.build("bm25", stopwords=None)
    first.index(units)
    for options in ({"stopwords": "en"}, {"method": "bm25+", "k1": 0.9, "b": 0.2}, {"stopwords": None, "method": "atire"}):
        one, two = retrieve.build("bm25", **options), retrieve.build("bm25", **options)
        one.index(units)
        two.share(first.share())
        assert one.search(queries, 4).orderBy("query_id", "rank").collect() == two.search(queries, 4).orderBy("query_id", "rank").collect()
    assert retrieve.build("bm25", stemmer="snowball-en").index_options != first.index_options
    assert text.STOPWORDS["en"]


def test_empty_tables(spark):
    units = spark.createDataFrame([], "unit_id string, text string")
    queries = spark.createDataFrame([("q", "qq zz")], "query_id string, text string")
    for kind in ("bm25", "tfidf"):
        r = retrieve.build(kind)
        r.index(units)
        assert r.search(queries, 3).collect() == []
        full = retrieve.build(kind)
        full.index(spark.createDataFrame([("u", None), ("v", ""), ("w", "alpha beta")], "unit_id string, text string"))
        assert [x.unit_id for x in full.search(queries, 3).orderBy("rank").collect()] == ["u", "v", "w"]
        assert full.search(queries.limit(0), 3).collect() == []


def test_many_queries_are_compared_with_tiles_at_once(monkeypatch):
    """What tiles find for all queries together is what blocks find for each, ties included; no step is done once for each query and segment."""
    monkeypatch.setattr(postings, "TILE", 64)
    texts = zipf_texts(21, 1500, 40)
    texts += [texts[3]] * 200
    avgdl = sum(len(t.split()) for t in texts) / len(texts)
    blocks, _ = blocks_of(texts, lambda of, units: scoring.bm25_tf("lucene", 1.5, 0.75, of["tf"].astype(float), units["dl"].astype(float), avgdl))
    rng = random.Random(5)
    asked = [{w: rng.uniform(0.1, 4.0) for w in rng.sample(WORDS, rng.randint(1, 7))} for _ in range(200)] + [dict.fromkeys(texts[3].split(), 1.0), {"w000": 2.0}]
    tiles = postings.Tiles.of(blocks)
    number = {t: i for i, t in enumerate(tiles.terms.to_pylist())}
    pairs = [(q, number[t], w) for q, terms in enumerate(asked) for t, w in terms.items() if t in number]
    query, term, weight = (np.array(x) for x in zip(*pairs, strict=True))
    spare, shown = np.full(len(asked), postings.SPARE), postings.shown_as("float64", 0.0)
    single = [blocks.best(list(terms.items()), 10, 0.0, shown, postings.SPARE, False) for terms in asked]
    for least in (np.zeros(len(asked)), np.array([np.sort(x[2])[-5] for x in single])):
        calls = []
        monkeypatch.setattr(postings.Tiles, "_near", staticmethod(lambda *a, of=postings.Tiles.__dict__["_near"].__func__: calls.append(1) or of(*a)))
        of, _, doc, value, _ = tiles.best(query, term, weight, 10, least, lambda v, _: shown(v), spare)
        assert len(calls) <= len(tiles.segments)
        for q, (_, docs, sums, _) in enumerate(single):
            some = sums >= least[q] - postings.SPARE
            want = dict(zip(docs[some].tolist(), sums[some].tolist(), strict=True))
            got = dict(zip(doc[of == q].tolist(), value[of == q].tolist(), strict=True))
            assert got == pytest.approx(want, abs=1e-12), q
        monkeypatch.undo()
        monkeypatch.setattr(postings, "TILE", 64)
    assert tiles.skipped > 0


@pytest.mark.parametrize(("kind", "options"), [("bm25", {"stopwords": None}), ("bm25", {"stopwords": None, "method": "bm25l", "dtype": "float32"}), ("tfidf", {})])
def test_searches_with_few_and_many_queries_agree(spark, monkeypatch, kind, options):
    monkeypatch.setattr(postings, "LEAST_POSTINGS", 200)
    monkeypatch.setattr(postings, "TWO_WAVES", 2)
    texts = zipf_texts(31, 300, 30)
    texts += [texts[5]] * 25 + ["", None]
    units = spark.createDataFrame([(f"u{i:04d}", t) for i, t in enumerate(texts)], "unit_id string, text string").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", " ".join(t.split()[:6])) for i, t in enumerate(zipf_texts(32, 60)) if t] + [("same", texts[5]), ("none", "zz")], "query_id string, text string")
    r = retrieve.build(kind, **options)
    r.index(units)
    found = lambda: [tuple(x) for x in r.search(queries, 10).orderBy("query_id", "rank").collect()]
    together = found()
    monkeypatch.setattr(postings, "FEW", 1 << 30)
    assert together == found() and len(together) == 10 * queries.count()


@pytest.mark.parametrize("frequent", [12, 1])
def test_a_segment_finds_for_all_queries_what_blocks_find(tmp_path, monkeypatch, frequent):
    """Needed terms alone are added up; the others are looked up for what may reach the threshold, ties included."""
    monkeypatch.setattr(postings, "DENSE", frequent)
    texts = zipf_texts(41, 1500, 40)
    texts += [texts[3]] * 200
    avgdl = sum(len(t.split()) for t in texts) / len(texts)
    impact = lambda of, units: scoring.bm25_tf("lucene", 1.5, 0.75, of["tf"].astype(float), units["dl"].astype(float), avgdl)
    blocks, _ = blocks_of(texts, impact)
    rows = pa.table({"unit_id": [f"u{i:06d}" for i in range(len(texts))], "terms": pa.array([t.split() for t in texts], pa.list_(pa.string())), "stop": pa.array([0] * len(texts), pa.int32())})
    pa.parquet.write_table(pa.Table.from_batches(postings.whole(iter(postings._of_terms(5, rows)))), tmp_path / "s.parquet")
    part = postings.Segment.load(f"file://{tmp_path}/s.parquet", None, impact)
    rng, number = random.Random(5), {t: i for i, t in enumerate(part.terms.to_pylist())}
    asked = [{w: rng.uniform(0.1, 4.0) for w in rng.sample(WORDS, rng.randint(1, 7))} for _ in range(200)] + [dict.fromkeys(texts[3].split(), 1.0), {"w000": 2.0}]
    query, term, weight = (np.array(x) for x in zip(*[(q, number[t], w) for q, terms in enumerate(asked) for t, w in terms.items() if t in number], strict=True))
    shown = postings.shown_as("float64", 0.0)
    single = [blocks.best(list(terms.items()), 10, 0.0, shown, postings.SPARE, False) for terms in asked]
    added = []
    for least in (np.zeros(len(asked)), np.array([np.sort(x[2])[-5] for x in single])):
        part.added = 0
        of, _, doc, value, _ = part.best(query, term, weight, 10, least, lambda v, _: shown(v), np.full(len(asked), postings.SPARE))
        added.append(part.added)
        for q, (_, docs, sums, _) in enumerate(single):
            some = sums >= least[q] - postings.SPARE
            got = dict(zip(doc[of == q].tolist(), value[of == q].tolist(), strict=True))
            assert got == pytest.approx(dict(zip(docs[some].tolist(), sums[some].tolist(), strict=True)), abs=1e-12), q
    assert added[1] < added[0]


def test_an_index_of_grams_takes_few_bytes_a_posting(spark):
    texts = zipf_texts(51, 800, 200)
    r = retrieve.build("tfidf")
    r.index(spark.createDataFrame([(f"u{i:04d}", t) for i, t in enumerate(texts)], "unit_id string, text string").repartition(2))
    segments = r._index.segments
    many = sum(len({t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)}) for t in texts)
    assert segments.select(F.sum(F.length("blocks"))).first()[0] < 2 * many


def test_a_segment_reads_only_impacts_that_can_reach_a_threshold(tmp_path):
    """Of terms that all units have, the few postings with high impacts; and as a first threshold needs no more, nothing is summed for all units."""
    rng = random.Random(61)
    texts = [" ".join(["often", "common"] * rng.choice([1, 1, 1, 1, 1, 1, 1, 1, 1, 9]) + ["w"] * rng.randint(5, 60)) for _ in range(3000)]
    impact = lambda of, units: scoring.bm25_tf("lucene", 1.5, 0.75, of["tf"].astype(float), units["dl"].astype(float), 35.0)
    rows = pa.table({"unit_id": [f"u{i:06d}" for i in range(len(texts))], "terms": pa.array([t.split() for t in texts], pa.list_(pa.string())), "stop": pa.array([0] * len(texts), pa.int32())})
    pa.parquet.write_table(pa.Table.from_batches(postings.whole(iter(postings._of_terms(5, rows)))), tmp_path / "s.parquet")
    part = postings.Segment.load(f"file://{tmp_path}/s.parquet", None, impact)
    number = {t: i for i, t in enumerate(part.terms.to_pylist())}
    term, weight, shown = np.array([number["often"], number["common"]]), np.ones(2), postings.shown_as("float64", 0.0)
    sums = np.zeros(len(part.dl))
    for t in term:
        mine = slice(part.starts[t], part.starts[t] + part.counts[t])
        sums[part.doc[mine]] += part.impact[mine]
    for least in (0.0, float(np.sort(sums)[-10])):
        part.added = part.whole = 0
        _, _, _, value, _ = part.best(np.zeros(2, np.int64), term, weight, 10, np.array([least]), lambda v, _: shown(v), np.full(1, postings.SPARE))
        assert np.sort(value)[::-1][:10] == pytest.approx(np.sort(sums)[::-1][:10], abs=1e-12)
        assert part.whole == 0 and 0 < part.added < len(texts) // 4


def test_waves_in_turn_find_what_one_wave_finds(spark, monkeypatch):
    texts = zipf_texts(71, 400, 30)
    units = spark.createDataFrame([(f"u{i:04d}", t) for i, t in enumerate(texts)], "unit_id string, text string").repartition(16)
    queries = spark.createDataFrame([(f"q{i}", " ".join(t.split()[:6])) for i, t in enumerate(zipf_texts(72, 40)) if t], "query_id string, text string")
    r = retrieve.build("bm25", stopwords=None)
    r.index(units)
    found = lambda: [tuple(x) for x in r.search(queries, 10).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(postings, "TWO_WAVES", 1 << 30)
    once = found()
    monkeypatch.setattr(postings, "TWO_WAVES", 2)
    two = found()
    monkeypatch.setattr(postings, "THREE_WAVES", 2)
    assert once == two == found()


def test_vectors_of_several_segments_find_what_plain_sums_find(tmp_path, monkeypatch):
    """Segments are searched together, like units side by side: ranges of other words are left out, ties and queries of rare terms alone are not."""
    monkeypatch.setattr(postings, "WIDE", 16)
    rng, kinds = random.Random(71), [[f"{c}{i:02d}" for i in range(40)] for c in "abcd"]
    texts = [" ".join(rng.choices(rng.choice(kinds), k=rng.randint(1, 60))) for _ in range(1200)]
    texts += [texts[3]] * 60 + ["rare word"]
    norm, held = {}, []
    for s, lo in enumerate(range(0, len(texts), 421)):
        some = texts[lo : lo + 421]
        rows = pa.table({"unit_id": [f"u{lo + i:06d}" for i in range(len(some))], "terms": pa.array([t.split() for t in some], pa.list_(pa.string())), "stop": pa.array([0] * len(some), pa.int32())})
        made = pa.Table.from_batches(postings.whole(iter(postings._of_terms(s, rows))))
        ids = made["units"][0].as_py()
        norm |= {(s, i): (u, math.sqrt(sum(n * n for n in Counter(texts[int(u[1:])].split()).values()))) for i, u in enumerate(ids)}
        pa.parquet.write_table(made, tmp_path / f"s{s}.parquet")
        pa.parquet.write_table(pa.table({"norm": [np.array([norm[s, i][1] for i in range(len(ids))]).tobytes()]}), tmp_path / f"n{s}.parquet")
        held.append((f"file://{tmp_path}/s{s}.parquet", f"file://{tmp_path}/n{s}.parquet"))
    terms = pa.array(sorted({w for t in texts for w in t.split()}))
    number = {t: i for i, t in enumerate(terms.to_pylist())}
    parts = list(postings.vectors_of(held, terms, lambda of, norm: of["tf"] / norm))
    assert len(held) > 1 and len(parts) == 1
    asked = [{w: rng.uniform(0.1, 1.0) for w in rng.sample(rng.choice(kinds), 6)} for _ in range(150)] + [dict.fromkeys(texts[3].split(), 0.3), {"rare": 1.0}]
    query, term, weight = (np.array(x) for x in zip(*[(q, number[t], w) for q, own in enumerate(asked) for t, w in own.items()], strict=True))
    plain = []
    for own in asked:
        counts = ((u, Counter(texts[int(u[1:])].split()), n) for u, n in norm.values())
        plain.append({u: sum(w * c[t] for t, w in own.items()) / n for u, c, n in counts})
    for least in (np.zeros(len(asked)), np.array([sorted(x.values())[-5] for x in plain])):
        of, segment, doc, value, _ = parts[0].best(query, term, weight, 10, least, lambda v, _: np.round(v, 9), np.full(len(asked), postings.SPARE))
        for q, scores in enumerate(plain):
            got = {norm[s, d][0]: v for s, d, v in zip(segment[of == q].tolist(), doc[of == q].tolist(), value[of == q].tolist(), strict=True)}
            want = sorted((-round(x, 9), u) for u, x in scores.items() if x > 0 and x >= least[q] - postings.SPARE)[:10]
            assert [u for _, u in sorted((-round(x, 9), u) for u, x in got.items())][: len(want)] == [u for _, u in want], q
            assert all(x == pytest.approx(scores[u], abs=1e-12) for u, x in got.items()), q
    assert parts[0].skipped > parts[0].compared


def test_a_task_counts_and_weighs_many_segments_of_grams(spark):
    """The idf of all grams is read once for many segments, not once for each."""
    texts = zipf_texts(81, 300, 30)
    r = retrieve.build("tfidf")
    r.index(spark.createDataFrame([(f"u{i:04d}", t) for i, t in enumerate(texts)], "unit_id string, text string").repartition(20))
    ix = r._index
    parts = ix.places.count()
    tasks = ix.each(lambda batches: batches, "at int, path string, norms string", most=postings.VOCABULARIES).rdd.getNumPartitions()
    assert tasks == max(-(-parts // postings.VOCABULARIES), min(parts, 2 * spark.sparkContext.defaultParallelism)) < parts
    found = {x.term: x.df for x in r._df.collect()}
    assert found == Counter(g for t in texts for g in {t.lower()[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)})


def test_queries_that_read_the_same_rows_follow_one_another(monkeypatch):
    rng, kinds = np.random.default_rng(5), 2
    monkeypatch.setattr(postings, "CELLS", 1280 * 50)
    term, unit = (np.concatenate(x) for x in zip(*[(rng.choice(20, 8, replace=False) + 20 * (u % kinds), np.full(8, u)) for u in range(1280)], strict=True))
    part = postings.Vectors([(0, np.full(1280, 8), np.ones(1280), term, unit, np.ones(len(term), np.int32))], 40, lambda of, norm: of["tf"] / norm)
    query, asked = np.repeat(np.arange(100), 5), np.concatenate([rng.choice(20, 5, replace=False) + 20 * (q % kinds) for q in range(100)])
    seen, near = [], part._near
    monkeypatch.setattr(part, "_near", lambda queries, *more: seen.append(queries) or near(queries, *more))
    found = part.best(query, asked, np.ones(len(query)), 10, np.zeros(100), lambda v, _: v, np.full(100, postings.SPARE))
    assert sorted(np.concatenate(seen).tolist()) == list(range(100)) and len(np.unique(found[0])) == 100
    assert sum(len(set((x % kinds).tolist())) == 1 for x in seen) >= len(seen) - 1
