"""Operators on small, hand-built inputs."""

import json
import math
import os
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbrank import cli
from plumbrank.functions import scoring, text
from plumbrank.functions.stemmer import stem
from plumbrank.operators import chunk, diagnose, diff, evaluate, index, labelling, ranking, rerank, retrieve, significance
from plumbrank.plans import compare, config, manifest, pipeline, tasks, trust
from plumbrank.sources import dataset, files, fingerprint, run_io, store, workspace

CORPUS = [("gold", "rotate the production token every week"), ("near", "rotate logs every night and every week"), ("far", "the kitchen has a new oven")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "doc_id string, text string")


def run_of(spark, rows):
    return spark.createDataFrame([(q, d, i + 1, float(s)) for q, hits in rows.items() for i, (d, s) in enumerate(hits)], "query_id string, doc_id string, rank int, score double")


def qrels_of(spark, rows):
    return spark.createDataFrame([(q, d, g) for q, x in rows.items() for d, g in x.items()], "query_id string, doc_id string, relevance int")


def queries_of(spark, rows):
    return spark.createDataFrame(list(rows.items()), "query_id string, text string")


def test_tokens_are_unicode_words(spark):
    df = spark.createDataFrame([("Été l'été,  naïve_x 中文 ² a1 b",)], "t string")
    assert df.select(text.word_set(F.col("t"))).first()[0] == ["été", "l", "naïve_x", "中文", "²", "a1", "b"]
    assert df.select(text.terms(F.col("t"), None)).first()[0] == ["été", "été", "naïve_x", "中文", "a1"]
    assert spark.createDataFrame([("a b c",)], "t string").select(text.words(F.col("t"))).first()[0] == ["a", "b", "c"]
    assert df.select(text.terms(F.lit("The cat and THE dog the cat"))).first()[0] == ["cat", "dog", "cat"]
    with pytest.raises(ValueError, match="stop words"):
        text.terms(F.lit("x"), "klingon")


def test_stemmer(spark):
    pairs = {"running": "run", "ponies": "poni", "relational": "relat", "happily": "happili", "generously": "generous", "hopping": "hop", "hoping": "hope", "skies": "sky", "caresses": "caress", "cries": "cri", "ties": "tie", "consistently": "consist", "knightly": "knight", "national": "nation", "replacement": "replac", "adoption": "adopt"}
    assert {w: stem(w) for w in pairs} == pairs
    df = spark.createDataFrame([(["running", "ran"],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(text.stem_column(F.col("t"), "snowball-en")).collect()] == [["run", "ran"], None]
    with pytest.raises(ValueError, match="stemmer"):
        text.stem_column(F.col("t"), "other")


def test_ngrams_are_all_substrings(spark):
    t = "Äbc de" * 40
    got = text.char_ngrams(spark.createDataFrame([("d", t), ("e", "ab")], "doc_id string, text string"), "doc_id", 3, 5).groupBy("gram").count().collect()
    low = t.lower()
    want = {}
    for n in (3, 4, 5):
        for i in range(len(low) - n + 1):
            want[low[i : i + n]] = want.get(low[i : i + n], 0) + 1
    assert {r.gram: r["count"] for r in got} == want


def test_ranks_break_ties_by_id(spark):
    rows = spark.createDataFrame([("q", "10", 1.0), ("q", "2", 1.0), ("q", "3", 2.0), ("r", "z", 0.1 + 0.2), ("r", "a", 0.3)], "query_id string, doc_id string, score double")
    assert [(r.query_id, r.doc_id, r.rank) for r in ranking.stored_order(ranking.rank(rows, 3)).collect()] == [("q", "3", 1), ("q", "10", 2), ("q", "2", 3), ("r", "a", 1), ("r", "z", 2)]


@pytest.mark.parametrize("method", scoring.METHODS)
def test_bm25_formula(spark, corpus, method):
    q = queries_of(spark, {"q": "rotate the token token"})
    got = {r.doc_id: r.score for r in retrieve.retrieve(retrieve.build("bm25", method=method), corpus, q, 3).collect()}
    docs = {d: [w for w in t.split() if w not in text.ENGLISH_STOPWORDS and len(w) > 1] for d, t in CORPUS}
    n, avg, k1, b = len(docs), sum(map(len, docs.values())) / len(docs), 1.5, 0.75
    want = {}
    for d, ws in docs.items():
        s = 0.0
        for t in ("rotate", "token", "token"):
            df, tf = sum(t in x for x in docs.values()), ws.count(t)
            norm = 1 - b + b * len(ws) / avg
            odds = (n - df + 0.5) / (df + 0.5)
            if method in ("lucene", "robertson"):
                s += (math.log(1 + odds) if method == "lucene" else math.log(max(1, odds))) * tf / (tf + k1 * norm)
            elif method == "atire":
                s += math.log(n / df) * tf * (k1 + 1) / (tf + k1 * norm)
            elif method == "bm25+":
                s += math.log((n + 1) / df) * (tf * (k1 + 1) / (tf + k1 * norm) + 0.5)
            else:
                c = tf / norm
                s += math.log((n + 1) / (df + 0.5)) * (k1 + 1) * (c + 0.5) / (k1 + c + 0.5)
        want[d] = s
    assert got == pytest.approx(want, abs=1e-8)


def test_every_query_gets_k_rows(spark, corpus):
    q = queries_of(spark, {"known": "rotate", "stop": "the", "unknown": "xyzzy", "empty": ""})
    for r in (retrieve.build("bm25"), retrieve.build("tfidf")):
        rows = retrieve.retrieve(r, corpus, q, 2).collect()
        assert sorted({(x.query_id, x.rank) for x in rows}) == [(a, i) for a in ("empty", "known", "stop", "unknown") for i in (1, 2)]
        assert [x.doc_id for x in rows if x.query_id == "unknown"] == ["far", "gold"]
    assert retrieve.retrieve(retrieve.build("bm25"), corpus, q, 10).count() == 12
    with pytest.raises(ValueError):
        retrieve.build("bm26")
    with pytest.raises(ValueError):
        retrieve.build("bm25", method="x")
    with pytest.raises(ValueError):
        retrieve.retrieve(retrieve.build("bm25"), corpus, q, 0)


def test_tfidf_is_a_cosine(spark, corpus):
    rows = retrieve.retrieve(retrieve.build("tfidf"), corpus, queries_of(spark, {"q": CORPUS[0][1]}), 3).collect()
    assert rows[0].doc_id == "gold" and rows[0].score == pytest.approx(1.0, abs=1e-8) and 0 < rows[1].score < 1


def test_dense(spark):
    rng = np.random.default_rng(1)
    d, q = rng.normal(size=(40, 8)), rng.normal(size=(5, 8))
    docs = spark.createDataFrame([(f"d{i}", x.tolist()) for i, x in enumerate(d)] + [("none", None)], "doc_id string, vector array<double>")
    asked = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(q)], "query_id string, vector array<double>")
    for normal in (True, False):
        s = q @ d.T
        s = s / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(d, axis=1) if normal else s
        got = {(r.query_id, r.rank): r.doc_id for r in retrieve.retrieve(retrieve.build("dense", normalize=normal), docs, asked, 4).collect()}
        assert got == {(f"q{i}", j + 1): f"d{x}" for i in range(5) for j, x in enumerate(np.argsort(-s[i])[:4])}
    encoder = lambda ts: np.array([[len(t), t.count("e")] for t in ts])
    rows = retrieve.retrieve(retrieve.build("dense", encoder=encoder, batch_size=2), spark.createDataFrame(CORPUS, "doc_id string, text string"), queries_of(spark, {"q": "eee"}), 2)
    assert rows.count() == 2
    with pytest.raises(ValueError, match="encoder"):
        retrieve.retrieve(retrieve.build("dense"), spark.createDataFrame(CORPUS, "doc_id string, text string"), queries_of(spark, {"q": "x"}), 2)


def test_descriptors_hold_every_knob():
    for kind, changes in {"bm25": {"k1": 1.0, "b": 0.1, "method": "atire", "stopwords": None, "stemmer": "snowball-en", "token_pattern": "x", "lower": False, "dtype": "float32"}, "tfidf": {"ngram_range": (2, 3), "lower": False, "sublinear_tf": False, "smooth_idf": False, "dtype": "float32"}, "dense": {"model_id": "m", "revision": "r", "device": "d", "dtype": "float32", "normalize": False, "query_prompt": "q", "document_prompt": "d", "max_seq_length": 3, "batch_size": 4}}.items():
        base = fingerprint.fingerprint(retrieve.build(kind).descriptor)
        assert len({base, *(fingerprint.fingerprint(retrieve.build(kind, **{k: v}).descriptor) for k, v in changes.items())}) == len(changes) + 1


def test_chunks_overlap_and_fold(spark):
    words = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([("short", "a b  c"), ("long", words), ("empty", "  \n")], "doc_id string, text string")
    cut = {r.chunk_id: r.text for r in chunk.FixedWords(10, 3).cut(docs).collect()}
    assert sorted(cut) == ["long#0", "long#1", "long#2", "long#3", "short#0"] and cut["short#0"] == "a b c"
    assert cut["long#1"].split() == [f"w{i}" for i in range(7, 17)] and cut["long#3"].split() == [f"w{i}" for i in range(21, 25)]
    assert chunk.Whole().cut(docs).count() == 3 and chunk.mean_chunks(chunk.FixedWords(10, 3).cut(docs)).first().mean_chunks == 2.5
    with pytest.raises(ValueError):
        chunk.FixedWords(5, 5).cut(docs)
    pieces = spark.createDataFrame([("a#0", "a"), ("a#1", "a"), ("b#0", "b"), ("c#0", "c")], "chunk_id string, doc_id string")
    hits = spark.createDataFrame([("q", "a#0", 1.0), ("q", "a#1", 3.0), ("q", "b#0", 3.0), ("q", "c#0", 0.5), ("q", "gone#0", 9.0)], "query_id string, chunk_id string, score double")
    assert [(r.doc_id, r.score) for r in chunk.fold(hits, pieces, 2).orderBy("rank").collect()] == [("a", 3.0), ("b", 3.0)]


def test_rerankers(spark, corpus):
    q = queries_of(spark, {"q": "rotate production token"})
    run = run_of(spark, {"q": [("far", 3), ("near", 2), ("gold", 1)]})
    both = rerank.rerank(run, rerank.build_reranker("coverage"), q, corpus, 2)
    assert [(r.doc_id, r.score) for r in both.after.orderBy("rank").collect()] == [("gold", 1.0), ("near", pytest.approx(1 / 3))]
    qrels = qrels_of(spark, {"q": {"gold": 2}})
    assert tuple(ranking.movement(both.before, both.after, qrels).first()) == ("q", 3, 1)
    longer = rerank.rerank(run, rerank.build_reranker("cross_encoder", load=lambda: lambda a, b: [len(x) for x in b]), q, corpus, 3).after
    assert longer.orderBy("rank").first().doc_id == "gold"
    with pytest.raises(ValueError):
        rerank.build_reranker("x")


def test_measures(spark):
    run = run_of(spark, {"q": [("a", 5), ("b", 4), ("c", 3), ("d", 2)], "r": [("a", 1)], "unjudged": [("a", 1)]})
    qrels = qrels_of(spark, {"q": {"b": 2, "d": 1, "x": 3, "c": 0}, "r": {"z": 1}, "absent": {"a": 1}, "unjudged": {"a": 0}})
    names = ("nDCG@3", "RR", "R@4", "P@2", "AP", "Success@1", "RR@1")
    got = {(r.query_id, r.measure): r.value for r in evaluate.evaluate(run, qrels, names).collect()}
    ideal = 3 + 2 / math.log2(3) + 1 / 2
    want = {"nDCG@3": 2 / math.log2(3) / ideal, "RR": 0.5, "R@4": 2 / 3, "P@2": 0.5, "AP": (1 / 2 + 2 / 4) / 3, "Success@1": 0.0, "RR@1": 0.0}
    assert {k[1]: v for k, v in got.items() if k[0] == "q"} == pytest.approx(want)
    assert {v for k, v in got.items() if k[0] in ("r", "absent")} == {0.0} and not any(k[0] == "unjudged" for k in got)
    assert {r.measure: r.value for r in evaluate.aggregate(evaluate.evaluate(run, qrels, ("RR",))).collect()} == pytest.approx({"RR": 0.5 / 3})
    for bad in ("nDCG@0", "Foo@3", "P", "R"):
        with pytest.raises(ValueError, match="unknown measure"):
            evaluate.evaluate(run, qrels, (bad,))


def diagnosed(spark, corpus, hits, grades=None, before=None, query="rotate token"):
    qrels = qrels_of(spark, {"q": grades or {"gold": 2}})
    moved = None if before is None else spark.createDataFrame([("q", before)], "query_id string, before_rank int")
    return diagnose.diagnose(run_of(spark, {"q": hits}), qrels, corpus, queries_of(spark, {"q": query}), moved)


def test_evidence(spark, corpus):
    ok = diagnosed(spark, corpus, [("gold", 2), ("near", 1)])
    assert ok.evidence.first().symptom == "ok" and ok.hypotheses.count() == 0
    e = diagnosed(spark, corpus, [("near", 2), ("gold", 2)]).evidence.first()
    assert (e.symptom, e.gold_rank, e.score_margin, e.tied_with_top1) == ("rank", 2, 0.0, True)
    assert 0 < e.query_gold_overlap < 1 and 0 < e.competitor_gold_overlap < 1 and e.query_token_count == 2
    e = diagnosed(spark, corpus, [("near", 2), ("far", 0)]).evidence.first()
    assert (e.symptom, e.gold_rank, e.best_relevant, e.score_margin, e.tied_with_top1, e.retrieved_with_zero_score) == ("miss", None, None, None, False, 1)
    e = diagnosed(spark, corpus, [("near", 2), ("gold", 0)]).evidence.first()
    assert (e.symptom, e.gold_rank, e.gold_score_is_zero) == ("miss", 2, True)
    e = diagnosed(spark, corpus, [("near", 1)], {"far": 2, "gold": 2}).evidence.first()
    assert e.symptom == "miss" and ranking.reference_gold(qrels_of(spark, {"q": {"far": 2, "gold": 2, "near": 1}})).first().reference_gold == "gold"
    assert diagnosed(spark, corpus, [("near", 1)], {"gold": 0}).evidence.count() == 0


def test_rules_below_the_floor(spark, corpus):
    d = diagnosed(spark, corpus, [("near", 2), ("gold", 2)], before=1)
    assert [(h.kind, h.confidence) for h in d.hypotheses.orderBy("place").collect()] == [("rerank_regression", 1.0), ("score_tie", 0.9), ("unexplained", 0.0)]
    assert not d.calibration.first().sufficient


def evidence_rows(spark, n):
    rows = [(f"q{i:03d}", "rank" if i % 2 else "ok", 2 if i % 2 else 1, "g", "t", not i % 2, 1.0, i / n, i / n, 3, False, False, 0, None) for i in range(n)]
    from plumbrank.schemas import EVIDENCE

    return spark.createDataFrame(rows, EVIDENCE)


def test_calibration_is_nearest_rank(spark):
    e = evidence_rows(spark, 40)
    c = diagnose.calibrate(e).first()
    assert (c.n, c.sufficient, c.low_query_gold_overlap) == (40, True, 10 / 40)
    competitors = sorted(i / 40 for i in range(40) if i % 2)
    assert c.high_competitor_gold_overlap == competitors[round(0.75 * 19)]
    kinds = {}
    for h in diagnose.interpret(e, diagnose.calibrate(e)).collect():
        kinds.setdefault(h.kind, set()).add(h.query_id)
    assert kinds["lexical_mismatch"] == {f"q{i:03d}" for i in range(1, 11, 2)} and "q029" in kinds["hard_negative"] and kinds["unexplained"]
    assert not kinds["unexplained"] & (kinds["lexical_mismatch"] | kinds["hard_negative"])
    empty = diagnose.calibrate(e.limit(0)).first()
    assert (empty.n, empty.low_query_gold_overlap) == (0, 0.0)


def test_diff(spark):
    left = run_of(spark, {"a": [("x", 2), ("g", 1)], "b": [("g", 1)], "c": [("x", 1)], "d": [("g", 1)]})
    right = run_of(spark, {"a": [("g", 2)], "b": [("x", 1)], "c": [("x", 1)]})
    qrels = qrels_of(spark, {k: {"g": 1} for k in "abcd"})
    rows = {r.query_id: tuple(r)[1:] for r in diff.compare_runs(left, right, qrels).collect()}
    assert rows == {"a": (2, 1, "improved", False), "b": (1, None, "regressed", False), "c": (None, None, "unchanged", False)}
    tied = spark.createDataFrame([("a", True), ("c", True)], "query_id string, tied_with_top1 boolean")
    marked = diff.compare_runs(left, right, qrels, tied, None)
    assert {r.query_id for r in marked.filter("arbitrary").collect()} == {"a"}
    assert diff.headline(diff.diff_counts(marked).first().asDict()) == "+1 -1 =1 (1 arbitrary)"
    became = {r.query_id: (r.became_failure, r.became_success) for r in diff.became(marked).collect()}
    assert became == {"a": (False, True), "b": (True, False), "c": (False, False)}
    assert [r.query_id for r in ranking.by_movement(marked).collect()] == ["a", "c", "b"]
    assert diff.demo_opener(marked).first().query_id == "a"


def metric(spark, values, name="RR"):
    return spark.createDataFrame([(f"q{i:03d}", name, float(v)) for i, v in enumerate(values)], "query_id string, measure string, value double")


def test_significance(spark):
    rng = np.random.default_rng(2)
    a = rng.random(80)
    r = significance.compare_measures(metric(spark, a), metric(spark, a + 0.1 + rng.normal(0, 0.02, 80)), resamples=2000).first()
    assert r.is_real and not r.underpowered and r.ci_low > 0 and r.p_value == pytest.approx(1 / 2001)
    one = np.zeros(60)
    one[3] = 1
    r = significance.compare_measures(metric(spark, np.zeros(60)), metric(spark, one)).first()
    assert r.p_value == 1.0 and not r.is_real
    draw = np.random.default_rng(significance.SEED)
    d = one
    means = d[draw.integers(0, 60, size=(10_000, 60))].mean(axis=1)
    assert (r.ci_low, r.ci_high) == tuple(np.quantile(means, [0.025, 0.975]))
    assert "indistinguishable" in significance.describe(r)
    few = significance.compare_measures(metric(spark, np.zeros(9)), metric(spark, np.ones(9)), resamples=500).first()
    assert few.underpowered and not few.is_real and "too few" in significance.describe(few)
    with pytest.raises(significance.NotPairedError, match="different"):
        significance.check_paired(metric(spark, a), metric(spark, a[:50]))
    with pytest.raises(significance.NotPairedError, match="in common"):
        significance.check_paired(metric(spark, a), metric(spark, []))


def test_labelling(spark, corpus, tmp_path):
    assert labelling.sample_places(5, 9) == list(range(5)) and len(set(labelling.sample_places(500, 50))) == 50
    d = diagnosed(spark, corpus, [("near", 2), ("gold", 1)])
    run, qrels, queries = run_of(spark, {"q": [("near", 2), ("gold", 1)]}), qrels_of(spark, {"q": {"gold": 2}}), queries_of(spark, {"q": "rotate token"})
    sheet = labelling.render_sheet(labelling.cases(labelling.sample_failures(d.evidence), d.evidence, run, queries, corpus, qrels), "run-1")
    assert labelling.parse_sheet(sheet) == {} and "**(gold)**" in sheet
    assert labelling.parse_sheet(sheet.replace("cause:\n", "cause: `Lexical-Mismatch`\n", 1)) == {"q": "lexical_mismatch"}
    with pytest.raises(ValueError, match="line 1"):
        labelling.parse_sheet("cause: outlier")
    with pytest.raises(ValueError, match="line 2: unknown cause"):
        labelling.parse_sheet("## q\ncause: bad luck")
    labels = spark.createDataFrame([("a", "hard_negative"), ("b", "outlier"), ("c", "outlier"), ("gone", "outlier")], "query_id string, cause string")
    evidence = spark.createDataFrame([("a", "rank"), ("b", "miss"), ("c", "ok")], "query_id string, symptom string")
    hyp = spark.createDataFrame([("a", "hard_negative"), ("a", "score_tie"), ("b", "unexplained")], "query_id string, kind string")
    assert tuple(labelling.agreement(labels, evidence, hyp).first()) == (4, 2, 1, 0.5)
    by = {r.cause: tuple(r)[1:] for r in labelling.agreement_by_cause(labels, evidence, hyp).collect()}
    assert by == {"hard_negative": (1, 1, 0, 1.0), "score_tie": (1, 0, 0, 0.0), "unexplained": (1, 0, 0, 0.0), "outlier": (0, 0, 1, None)}


def write_dataset(at, corpus, queries, qrels):
    os.makedirs(at, exist_ok=True)
    for name, rows in (("corpus", corpus), ("queries", queries), ("qrels", qrels)):
        with open(os.path.join(at, f"{name}.jsonl"), "w", encoding="utf-8") as f:
            f.write("".join((x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)) + "\n" for x in rows))
    return str(at)


GOOD = ([{"doc_id": d, "text": t} for d, t in CORPUS], [{"query_id": "q", "text": "rotate token"}, {"query_id": "r", "text": "new oven"}], [{"query_id": "q", "doc_id": "gold", "relevance": 2}, {"query_id": "r", "doc_id": "far"}, {"query_id": "q", "doc_id": "near", "relevance": 1}, {"query_id": "q", "doc_id": "near", "relevance": 0}])


def test_dataset(spark, tmp_path):
    d = dataset.load_dataset(spark, write_dataset(tmp_path / "ok", *GOOD))
    assert d.summary() == (3, 2) and {tuple(r) for r in d.qrels.collect()} == {("q", "gold", 2), ("r", "far", 1), ("q", "near", 0)}
    again = dataset.load_dataset(spark, write_dataset(tmp_path / "again", GOOD[0][::-1], GOOD[1], GOOD[2][:2]))
    assert d.corpus_fingerprint() == again.corpus_fingerprint() and d.labels_fingerprint() != again.labels_fingerprint()
    bad = {
        r"corpus.jsonl:2: is not": (["{}".replace("{}", json.dumps(GOOD[0][0])), "not json"], GOOD[1], []),
        r"corpus.jsonl:3: needs a non-empty string `text`": ([GOOD[0][0], "", {"doc_id": "x", "text": ""}], GOOD[1], []),
        r"corpus.jsonl:1: needs a non-empty string `doc_id`": ([{"doc_id": 3, "text": "x"}], GOOD[1], []),
        r"corpus.jsonl:2: duplicate doc_id 'gold'": ([GOOD[0][0], GOOD[0][0]], GOOD[1], []),
        r"qrels.jsonl:1: unknown doc_id 'zz'": (GOOD[0], GOOD[1], [{"query_id": "q", "doc_id": "zz"}]),
        r"qrels.jsonl:2: unknown query_id 'zz'": (GOOD[0], GOOD[1], [GOOD[2][0], {"query_id": "zz", "doc_id": "gold"}]),
        r"qrels.jsonl:1: `relevance` must be": (GOOD[0], GOOD[1], [{"query_id": "q", "doc_id": "gold", "relevance": True}]),
        r"corpus is empty": ([], GOOD[1], []),
    }
    for i, (message, files) in enumerate(bad.items()):
        with pytest.raises(dataset.DatasetError, match=message):
            dataset.load_dataset(spark, write_dataset(tmp_path / f"bad{i}", *files))


def test_fingerprints(tmp_path):
    f = fingerprint.fingerprint
    values = [1, 1.0, True, "1", b"1", None, [1], (1,), {"a": 1}, {"a": [1]}, [[1], 2], [1, [2]], "", [], {}, -0.0, 0.0]
    assert len({f(v) for v in values}) == len(values)
    assert f({"a": 1, "b": 2}) == f({"b": 2, "a": 1}) and f("x").startswith("fp_")
    for bad in (float("nan"), float("inf"), {1: 2}, object(), {1}):
        with pytest.raises(TypeError):
            f(bad)
    (tmp_path / "x").write_bytes(b"abc")
    assert fingerprint.fingerprint_file(str(tmp_path / "x")) == fingerprint.fingerprint_bytes(b"abc")


def test_frame_fingerprint(spark):
    f = lambda rows, s="a string, b int": fingerprint.frame_fingerprint(spark.createDataFrame(rows, s))
    base = f([("x", 1), ("y", None)])
    assert base == f([("y", None), ("x", 1)])
    assert len({base, f([("x", 1)]), f([("x", 1), ("x", 1), ("y", None)]), f([("x", 1), ("y", 0)]), f([(None, 1), ("y", None)]), f([("x", 1), ("y", None)], "a string, c int")}) == 6


def test_store(spark, tmp_path):
    s = store.Store(str(tmp_path))
    with pytest.raises(RuntimeError), s.reserve("retrieve", "k") as at:
        open(os.path.join(at, "x"), "w").close()
        raise RuntimeError
    assert not s.has("retrieve", "k") and s.keys("retrieve") == [] and os.listdir(tmp_path / "retrieve" / "k") == []
    with s.reserve("retrieve", "k") as outer, s.reserve("retrieve", "k") as inner:
        open(os.path.join(outer, "outer"), "w").close()
        open(os.path.join(inner, "inner"), "w").close()
    assert os.listdir(s.lookup("retrieve", "k")) == ["inner"]
    s.forget("retrieve", "k")
    assert s.lookup("retrieve", "k") is None
    for bad in ("", "a/b", ".x"):
        with pytest.raises(ValueError):
            s.path("retrieve", bad)


@pytest.mark.parametrize("scheme", ["", "file://", "viewfs://plumb/at"])
def test_publication(spark, tmp_path, scheme):
    """Also through a file system that only Spark's readers open."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.plumb.link./at", f"file://{tmp_path}")
    root = scheme if scheme.startswith("viewfs") else f"{scheme}{tmp_path}"
    s = store.Store(f"{root}/store")
    df = spark.range(5)

    def publish(n, replace=False):
        with s.reserve("run", "r", replace) as at:
            spark.range(n).write.parquet(f"{at}/t.parquet")

    count = lambda: spark.read.parquet(f"{s.path('run', 'r')}/t.parquet").count()
    publish(3)
    publish(4)  # the first wins
    assert count() == 3 and s.keys("run") == ["r"]
    before = s.path("run", "r")
    with pytest.raises(RuntimeError), s.reserve("run", "r", True) as at:
        df.write.parquet(f"{at}/t.parquet")
        assert s.path("run", "r") == before  # what was there stays until the new one is whole
        raise RuntimeError
    assert count() == 3
    for n in (5, 6, 7):
        publish(n, True)
        assert count() == n
    versions = [x for x in files.names(s.folder("run", "r")) if x.startswith("version")]
    assert len(versions) == 2 and len(files.names(s.folder("run", "r"))) == 4
    # A writer that died in the middle: an attempt without a version, and a version's file without its end.
    files.make_dir(f"{s.folder('run', 'r')}/attempt-dead")
    files.write(f"{s.folder('run', 'r')}/version-000000099", b"attempt-de")
    assert count() == 7
    publish(8, True)
    assert count() == 8 and not files.create(f"{s.folder('run', 'r')}/version-000000099", b"x") and files.create(f"{s.folder('run', 'r')}/other", b"x")
    calls = []
    load = lambda at: files.read(f"{at}/note").decode()
    make = lambda at: (calls.append(at), files.write(f"{at}/note", f"made {len(calls)}".encode()))
    assert [s.cached("note", "n", load, make) for _ in range(2)] == [("made 1", False), ("made 1", True)]
    files.remove(f"{s.path('note', 'n')}/note")
    assert s.cached("note", "n", load, make) == ("made 2", False) and s.cached("note", "n", load, make) == ("made 2", True)


def test_two_publishers_at_once(spark, tmp_path):
    s = store.Store(str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: files.create(str(tmp_path / "one" / "version-000000001"), b"%d\n" % i), range(24)))
    assert sum(won) == 1 and files.read(str(tmp_path / "one" / "version-000000001")) == b"%d\n" % won.index(True)
    assert s.path("one", "nobody").endswith("nothing")


def test_runs_round_trip(spark, tmp_path):
    scores = [math.pi, 1.0, 1 - 2**-52, 0.8709996938705444, 1e-300, 0.0]
    run_io.write_run(str(tmp_path), run_of(spark, {"ü": [(f"d{i}", s) for i, s in enumerate(scores)]}))
    assert [r.score for r in run_io.stored_rows(spark, str(tmp_path))] == scores
    assert "Exchange" not in run_io.read_run(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def provenance(stage, **change):
    base = {"key": "fp_x", "version": 1, "params": {}, "inputs": [], "uses": ["pyspark"], "commit": "a" * 40, "dirty": False, "python": "3.13", "platform": "linux", "packages": {"pyspark": "4.1"}, "made_at": "t"}
    return manifest.Record({manifest.STEP + stage: base | change})


def test_more_measures(spark):
    """By hand from the rankings, as their definitions have them."""
    grades = {"a": {"d1": 3, "d2": 0, "d3": 1, "d4": -1, "d9": 2}, "b": {"d1": 1}, "c": {"d1": 0}, "e": {"d5": 5, "d1": 0, "d2": 0}}
    runs = {"a": ["d2", "d1", "d7", "d4", "d3", "d8"], "b": ["d3", "d1"], "c": ["d1"], "e": ["d1", "d5"]}
    qrels = spark.createDataFrame([(q, d, g) for q, x in grades.items() for d, g in x.items()], "query_id string, doc_id string, relevance int")
    run = spark.createDataFrame([(q, d, i + 1, float(9 - i)) for q, x in runs.items() for i, d in enumerate(x)], "query_id string, doc_id string, rank int, score double")
    names = ("ERR", "ERR@3", "RBP", "RBP@2", "Judged@4", "Bpref", "Rprec", "SetP", "SetR", "SetF")
    got = {(r.query_id, r.measure): r.value for r in evaluate.evaluate(run, qrels, names).collect()}
    want = {}
    for q in ("a", "b", "e"):
        g, order = grades[q], runs[q]
        r, n = sum(x > 0 for x in g.values()), sum(x <= 0 for x in g.values())
        hit = [g.get(d, 0) > 0 for d in order]
        for name, k in (("ERR", 99), ("ERR@3", 3)):
            going, total = 1.0, 0.0
            for i, d in enumerate(order[:k]):
                stop = (2 ** min(max(g.get(d, 0), 0), 4) - 1) / 16
                total += going * stop / (i + 1)
                going *= 1 - stop
            want[q, name] = total
        for name, k in (("RBP", 99), ("RBP@2", 2)):
            want[q, name] = 0.2 * sum(0.8**i for i, h in enumerate(hit[:k]) if h)
        want[q, "Judged@4"] = sum(d in g for d in order[:4]) / 4
        bad = [sum(d in g and g[d] <= 0 for d in order[:i]) for i in range(len(order))]
        want[q, "Bpref"] = sum(1 - (min(b, r) / min(r, n) if b else 0) for b, h in zip(bad, hit) if h) / r
        want[q, "Rprec"] = sum(hit[:r]) / r
        p, c = sum(hit) / len(order), sum(hit) / r
        want[q, "SetP"], want[q, "SetR"], want[q, "SetF"] = p, c, 2 * p * c / (p + c)
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    for bad in ("Bpref@3", "Judged", "SetP@2"):
        with pytest.raises(ValueError):
            evaluate.parse_measure(bad)


def test_equal_single_scores_are_in_order_of_ids(spark):
    hits = spark.createDataFrame([("q", "b", 10.00000002), ("q", "a", 10.00000001)], "query_id string, unit_id string, score double")
    q, units = spark.createDataFrame([("q",), ("none",)], "query_id string"), spark.createDataFrame([("a",), ("b",), ("c",)], "unit_id string")
    for dtype, first in (("float32", ["a", "b", "c"]), ("float64", ["b", "a", "c"])):
        got = retrieve.padded(hits, q, units, 3, None, dtype).orderBy("query_id", "rank").collect()
        assert [r.unit_id for r in got if r.query_id == "q"] == first and [r.unit_id for r in got if r.query_id == "none"] == ["a", "b", "c"]


def test_revisions_are_pinned_or_unknown():
    asked = []
    resolve = lambda x: asked.append(x) or "abc"
    assert retrieve.build("dense", model_id="m", resolve=resolve).descriptor["revision"] == "abc" and asked == ["m"]
    assert retrieve.build("dense", model_id="m", revision="r", resolve=resolve).descriptor["revision"] == "r" and asked == ["m"]
    assert retrieve.build("dense", model_id="m", resolve=lambda x: 1 / 0).descriptor["revision"] is None
    assert retrieve.build("dense").descriptor["revision"] is None


def test_unpaired_runs_are_refused_by_the_operator(spark):
    a = [1.0, 0.5, 0.25]
    for f in (significance.compare_measures, significance.hashed_significance):
        with pytest.raises(significance.NotPairedError):
            f(metric(spark, a), metric(spark, a[:2]))


def record_of(stages=("retrieve", "evaluate"), corpus="c", labels="l", schema=2, **change):
    found = manifest.Record({"run": {"schema": schema, "id": "r", "name": "r", "config": "fp_c", "made_at": "t"}, "data": {"corpus": corpus, "labels": labels}})
    for s in stages:
        found |= provenance(s, **change)
    return found


@pytest.mark.parametrize(
    ("change", "changed", "level"),
    [
        ({}, None, trust.Trust.IDENTICAL),
        ({"corpus": "d"}, None, trust.Trust.INCOMPARABLE),
        ({"labels": "m"}, None, trust.Trust.INCOMPARABLE),
        ({"schema": 1}, None, trust.Trust.INCOMPARABLE),
        ({"stages": ("retrieve",)}, None, trust.Trust.INCOMPARABLE),
        ({"python": "3.12"}, None, trust.Trust.SUSPECT),
        ({"platform": "mac"}, None, trust.Trust.SUSPECT),
        ({"packages": {"pyspark": "3.5"}}, None, trust.Trust.SUSPECT),
        ({"packages": {"pyspark": "4.1", "pandas": "1"}}, None, trust.Trust.IDENTICAL),
        ({"version": 2}, None, trust.Trust.SUSPECT),
        ({"dirty": True}, None, trust.Trust.SUSPECT),
        ({"commit": None}, None, trust.Trust.SUSPECT),
        ({"commit": "b" * 40}, None, trust.Trust.SUSPECT),
        ({"commit": "b" * 40}, True, trust.Trust.SUSPECT),
        ({"commit": "b" * 40}, False, trust.Trust.COMPARABLE),
    ],
)
def test_trust(change, changed, level):
    verdict = trust.assess(record_of(), record_of(**change), ("retrieve", "evaluate"), {s: changed for s in ("retrieve", "evaluate")})
    assert verdict.level == level and bool(verdict.reasons) == (level != trust.Trust.IDENTICAL)


def test_manifests_are_strict():
    whole = record_of()
    assert manifest.Record.parse(json.loads(json.dumps(whole.parts))) == whole and whole.steps() == ["retrieve", "evaluate"] and whole.step("rerank") is None
    for bad in ({**whole["data"], "extra": 1}, {"corpus": "c"}, {"corpus": "c", "labels": None}, []):
        with pytest.raises(ValueError):
            manifest.Record({"data": bad})
    for bad in ({"other": {}}, [whole.parts], None):
        with pytest.raises(ValueError):
            manifest.Record.parse(bad)
    assert manifest.source_changed(None, "a" * 40, "retrieve") is None and manifest.source_changed("a" * 40, "a" * 40, "retrieve") is False
    place = {"commit": None, "dirty": False, "python": "3", "platform": "linux", "packages": {}}
    said = lambda by: manifest.step_record("retrieve", "k", {}, (), by, place)["step:retrieve"]
    assert said(retrieve.build("dense"))["uses"] == ["numpy", "pyarrow", "pyspark"] and said(None)["uses"] == ["pyspark"]
    assert said(retrieve.build("bm25"))["version"] == retrieve.build("bm25").descriptor["impl_version"] and all(p.exists() for s in manifest.STAGE_SOURCES for p in manifest.stage_source_paths(s))


def test_experiment_files(tmp_path):
    good = {"name": "x", "dataset": "d", "systems": [{"kind": "bm25", "name": "a"}, {"kind": "tfidf", "name": "b", "chunking": {"kind": "fixed_words"}, "reranker": {"kind": "coverage"}}]}
    e = config.parse_experiment(good)
    assert e.k == 10 and e.baseline_system().name == "a" and [s.name for s in e.others()] == ["b"] and e.systems[1].chunking.build().size == 180
    assert e.systems[0].build().descriptor["dtype"] == "float32"
    for bad in ({**good, "kk": 1}, {**good, "systems": []}, {**good, "baseline": "z"}, {**good, "systems": [good["systems"][0]] * 2}, {**good, "systems": [{"kind": "bm26", "name": "a"}]}, {**good, "systems": [{"kind": "bm25", "name": "a", "k2": 1}]}, {**good, "measures": ["X"]}, [1]):
        with pytest.raises(config.ConfigError):
            config.parse_experiment(bad)
    with pytest.raises(config.ConfigError):
        config.load_experiment(str(tmp_path / "none.yaml"))


def test_pipeline_cache_and_comparison(spark, tmp_path):
    d = dataset.load_dataset(spark, write_dataset(tmp_path / "ds", *GOOD))
    space = workspace.Workspace(str(tmp_path / "runs"))
    first = pipeline.execute(d, retrieve.build("bm25"), k=2, store=space.cache)
    second = pipeline.execute(d, retrieve.build("bm25"), k=2, store=space.cache)
    assert (first.cached, second.cached) == (False, True) and first.run.collect() == second.run.collect() and first.run_id == second.run_id
    relabelled = dataset.load_dataset(spark, write_dataset(tmp_path / "ds2", GOOD[0], GOOD[1], GOOD[2][:2]))
    assert pipeline.execute(relabelled, retrieve.build("bm25"), k=2, store=space.cache).cached
    other = pipeline.execute(d, retrieve.build("bm25"), k=2, chunking=chunk.FixedWords(3, 1), reranker=rerank.build_reranker("coverage"), store=space.cache, name="other")
    assert not other.cached and other.moved.count() == 2 and set(other.manifest.steps()) == {"retrieve", "rerank", "evaluate", "diagnose"}
    found = compare.compare(first, other, d, resamples=100)
    for o in (first, other):
        space.write_run(o)
    space.write_comparison(found)
    assert space.runs() == sorted([first.run_id, other.run_id]) and space.comparisons() == [found.comparison_id]
    assert space.table(spark, first.run_id, "metrics").count() == 6 and space.deltas(spark, found.comparison_id).count() == 2 and space.catalog(spark).count() == 3
    with pytest.raises(significance.NotPairedError):
        compare.compare(first, pipeline.execute(dataset.load_dataset(spark, write_dataset(tmp_path / "ds3", GOOD[0], GOOD[1], GOOD[2][:1])), retrieve.build("bm25"), k=2), d)
    with pytest.raises(ValueError, match="cannot be compared"):
        compare.compare(first, pipeline.execute(relabelled, retrieve.build("bm25"), k=2), d, resamples=50)


def test_cli(spark, tmp_path, capsys):
    write_dataset(tmp_path / "ds", *GOOD)
    (tmp_path / "e.yaml").write_text("name: e\ndataset: ds\nk: 2\nsystems:\n  - {kind: bm25, name: a}\n  - {kind: bm25, name: b, method: atire}\n")
    root = ["--root", str(tmp_path / "runs")]
    assert cli.main([*root, "run", str(tmp_path / "e.yaml")], spark) == 0
    run_id = workspace.Workspace(root[1]).runs()[0]
    for verb in (["list"], ["show", run_id], ["label", run_id, "--out", str(tmp_path / "s.md")], ["score", run_id, str(tmp_path / "s.md")], ["demo", str(tmp_path / "ds")]):
        assert cli.main([*root, *verb], spark) == 0
    assert "a-vs-b" in capsys.readouterr().out
    assert cli.main([*root, "show", "nothing"], spark) == 1 and "error:" in capsys.readouterr().err


def test_index_statistics(spark, corpus):
    ix = index.TermIndex.build(corpus, "doc_id", None, None, True, text.TERM)
    assert {r.term: r.df for r in ix.frequency.collect()}["rotate"] == 2
    assert index.smoothed_idf(corpus).filter("term = 'oven'").first().idf == pytest.approx(math.log(4 / 2) + 1)


def test_passage_labels_of_short_items(spark, tmp_path):
    texts = {1: "a foo bar here", 2: "foo ba", 3: "xfoo ba-r", 4: "one two threefold", 5: "one twofold three", 6: "nothing"}
    items = {1: "foo ba", 2: "one two three", 3: "foo", 4: "ba"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.query_id, r.doc_id) for r in tasks.passage(spark, str(tmp_path)).qrels.collect()}
    assert got == {(f"b-{i}", str(d)) for i, item in items.items() for d, t in texts.items() if item in t}


def test_nearest_ranks_by_digits(spark):
    """Against a sorted list: ties, many equal values, one value, halves to even, and names without any."""
    rng = random.Random(9)
    cases = {"few": [0.5], "two": [0.25, 0.75], "ties": [0.1] * 300 + [0.2], "any": [round(rng.random(), 12) for _ in range(401)], "ends": [0.0, 1.0] * 50, "close": [round(0.3 + i * 1e-12, 12) for i in range(77)]}
    for fraction in (0.0, 0.25, 0.5, 0.75, 1.0):
        rows = spark.createDataFrame([(n, v, fraction) for n, vs in cases.items() for v in vs], "name string, value double, fraction double").repartition(5)
        got = {r.name: r.value for r in diagnose.nearest_ranks(rows).collect()}
        assert got == {n: sorted(vs)[round(fraction * (len(vs) - 1))] for n, vs in cases.items()}
    assert "collect_list" not in diagnose.nearest_ranks(rows)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("n", "size"), [(200, 50), (30, 7), (30, 30), (5, 50), (0, 3)])
def test_draw_is_that_of_pythons_generator(spark, n, size):
    ids = [f"q{i * 7919 % 1000:03d}" for i in range(n)]
    rows = spark.createDataFrame([(q, "miss") for q in ids] + [("q0000", "ok")] + [(q, "rank") for q in ids[:3]], "query_id string, symptom string").repartition(6)
    want = sorted(random.Random(4).sample(sorted(ids), size)) if size < n else sorted(ids)
    assert sorted(r.query_id for r in labelling.sample_failures(rows, size, 4).collect()) == want


def test_a_long_run_is_stored_in_order(spark, tmp_path):
    rows = [(f"q{q:03d}", f"d{r}", r, float(-r)) for q in range(300) for r in range(1, 6)]
    run = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "query_id string, doc_id string, rank int, score double").repartition(7)
    run_io.write_run(str(tmp_path), run)
    assert len(run_io.read_run(spark, str(tmp_path)).inputFiles()) > 1
    assert [tuple(r) for r in run_io.stored_rows(spark, str(tmp_path))] == rows


def test_causes_as_people_write_them():
    for written in ("Lexical Mismatch", " lexical-mismatch ", "LEXICAL_MISMATCH"):
        assert labelling.validate_label(written) == "lexical_mismatch"
    for bad in ("lexical", "lexical__mismatch", "", "lexical mismatch!"):
        with pytest.raises(ValueError):
            labelling.validate_label(bad)


@pytest.mark.parametrize("n", [1, 2, 3, 50, 977, 70_001])
def test_draws_from_anywhere_are_those_of_the_generator(n):
    rows = 40 if n < 10_000 else 3
    draw = np.random.default_rng(7)
    want, signs = draw.integers(0, n, size=(rows, n)), draw.choice(np.array([-1.0, 1.0]), size=(rows, n))
    every = significance.words(7, 0, rows * n + 2000)
    bad = np.flatnonzero(significance.passed_over(every, n)) if n > 1 else np.zeros(0, np.int64)
    of = significance.Draws(7, n, rows, bad[bad - np.arange(len(bad)) < rows * n])
    for first, last in ((0, rows), (1, 2), (rows - 1, rows), (rows // 3, rows // 2 + 1)):
        assert (of.indices(first, last) == want[first:last]).all() and (of.signs(first, last) == signs[first:last]).all()


def test_unused_words_shift_the_draws(spark, monkeypatch):
    """With so many queries that words are left unused, and shares so small that many tasks look for them."""
    monkeypatch.setattr(significance, "DRAWS", 50_000)
    n, rows = 70_001, 4
    of = significance.draws(spark, n, 7, rows)
    draw = np.random.default_rng(7)
    assert len(of.skipped) and (of.indices(0, rows) == draw.integers(0, n, size=(rows, n))).all()
    assert (of.signs(1, rows) == draw.choice(np.array([-1.0, 1.0]), size=(rows, n))[1:]).all()


@pytest.mark.parametrize("tasks", [1, 3, 8])
def test_shares_of_resamples_give_what_one_generator_gives(spark, tasks):
    rng = np.random.default_rng(2)
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        frames = []
        for shift in (0.0, 0.03):
            rows = [(f"q{i:03d}", m, float(v)) for m, n in (("RR", 83), ("P@5", 1), ("nDCG@10", 83)) for i, v in enumerate(rng.random(n) + shift)]
            frames.append(spark.createDataFrame(rows, "query_id string, measure string, value double"))
        got = {r.measure: r for r in significance.compare_measures(*frames, resamples=501).collect()}
        for m, r in got.items():
            a, b = (f.filter(F.col("measure") == m).orderBy("query_id").toPandas()["value"].to_numpy() for f in frames)
            assert (r.ci_low, r.ci_high, r.p_value) == significance.resampled(b - a, significance.SEED, 501, significance.CONFIDENCE) and r.n == len(a) and r.delta == (b - a).mean()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_export_in_parts(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i:04d}", "" if i % 50 == 0 else f"text é \"{i}\"\n{i}") for i in range(900)], "doc_id string, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    queries = spark.createDataFrame([(f"q{i}", f"ask {i}") for i in range(20)], "query_id string, text string")
    qrels = spark.createDataFrame([(f"q{i}", f"d{i * 7:04d}", i % 3) for i in range(20)], "query_id string, doc_id string, relevance int")
    about = dataset.export_dataset(docs, queries, qrels, str(tmp_path), "made up", with_title=False)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert about["counts"] == {"corpus": 882, "queries": 20, "qrels": 19} and len(about["parts"]["corpus"]) > 1
    whole = b"".join((tmp_path / "corpus.jsonl" / p["name"]).read_bytes() for p in about["parts"]["corpus"])
    for p in about["parts"]["corpus"]:
        assert whole[p["at"] :].startswith((tmp_path / "corpus.jsonl" / p["name"]).read_bytes())
    ids = [json.loads(x)["doc_id"] for x in whole.decode().splitlines()]
    assert ids == sorted(ids)
    found = dataset.load_dataset(spark, str(tmp_path))
    assert sorted(map(tuple, found.corpus.collect())) == sorted((r.doc_id, r.text) for r in docs.collect() if r.text)
    lines = {r.doc_id: r._line for r in dataset.read_jsonl(spark, str(tmp_path / "corpus.jsonl"), {"doc_id": "string", "text": "string"}).collect()}
    assert [lines[x] for x in ids] == list(range(1, 883))
    name = about["parts"]["corpus"][1]["name"]
    part = (tmp_path / "corpus.jsonl" / name).read_text().splitlines()
    (tmp_path / "corpus.jsonl" / name).write_text("\n".join([part[0], "oops", *part[1:]]) + "\n")
    (tmp_path / "corpus.jsonl" / f".{name}.crc").unlink(missing_ok=True)
    with pytest.raises(dataset.DatasetError, match=f"corpus.jsonl:{about['parts']['corpus'][0]['lines'] + 2}: is not"):
        dataset.load_dataset(spark, str(tmp_path))


def test_measures_need_no_list_of_labels(spark, monkeypatch):
    """A query whose labels are very many: they are numbers of grades, and gains of an ideal ranking are summed in pieces."""
    monkeypatch.setattr(evaluate, "PLACES", 7)
    grades = spark.createDataFrame([("q", 3, 5), ("q", 1, 40), ("q", 0, 9), ("r", 1, 200_000), ("s", 0, 4)], "query_id string, relevance int, n long")
    run = spark.createDataFrame([("q", "a", 1, 2.0), ("q", "b", 2, 1.0), ("r", "c", 1, 1.0), ("s", "a", 1, 1.0)], "query_id string, doc_id string, rank int, score double")
    qrels = spark.createDataFrame([("q", "b", 3), ("q", "a", 0), ("r", "c", 1)], "query_id string, doc_id string, relevance int")
    got = {(x.query_id, x.measure): x.value for x in evaluate.evaluate(run, qrels, ("nDCG", "nDCG@10", "R@5", "AP"), grades).collect()}
    gain = lambda gs: sum(g / math.log2(i + 2) for i, g in enumerate(gs))
    of_q, of_r = [3] * 5 + [1] * 40, [1] * 200_000
    want = {("q", "nDCG"): gain([0, 3]) / gain(of_q), ("q", "nDCG@10"): gain([0, 3]) / gain(of_q[:10]), ("q", "R@5"): 1 / 45, ("q", "AP"): 0.5 / 45, ("r", "nDCG"): 1 / gain(of_r), ("r", "nDCG@10"): 1 / gain(of_r[:10]), ("r", "R@5"): 1 / 200_000, ("r", "AP"): 1 / 200_000}
    assert got == pytest.approx(want)


def test_words_are_counted_before_they_meet_the_wanted_ones(spark):
    """A join ahead of the count shuffles every word of every document."""
    corpus = spark.createDataFrame([("a", "oven heat oven"), ("b", "oven cold"), ("c", "")], "doc_id string, text string")
    only = spark.createDataFrame([("oven",), ("none",)], "term string")
    found = index.smoothed_idf(corpus, only)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.index("LeftSemi") < plan.index("Explode" if "Explode" in plan else "explode")
    between = plan[plan.index("LeftSemi") : plan.index("xplode")]
    assert "Aggregate [term" in between
    assert [tuple(x)[:2] for x in found.collect()] == [("oven", 2.0)]
