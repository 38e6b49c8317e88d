"""Operators 1, 2, 4, 6, 8 and 10 against brute force, and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbrank.llm import binary, fingerprint, fmindex, langid, queries, text, tokens, toxicity
from plumbrank.session import fresh_path

DATA = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType()), T.StructField("n_words", T.StringType())])
AWKWARD = [
    (3, None, "en", "x", "y"),
    (1, "", None, "x", None),
    (7, "A b c", "fr", None, "y"),
    (7, "A b c", "fr", None, "y"),
    (None, "word  two\t\n three  \n end", "en", "x", "y"),
    (5, "été 中文 don't <|endoftext|> stop " * 50, "fr", "x", "y"),
    (9, "lone " * 60_000, "en", "x", "y"),
    (-4, "x" * 30_000 + " <|startoftext|>tail", "en", "x", "y"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer(name))


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def key(rows, *names):
    return sorted(tuple(r[x] for x in names) for r in rows)


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_token_counts_are_the_librarys(which, request):
    docs = request.getfixturevalue(which)
    t = library("word_bpe_49k.json")
    got = tokens.count_query(docs, queries.tokenizer("word_bpe_49k.json")).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 2048) for r in docs.collect())
    assert Counter(tuple(r) for r in got) == want


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_token_files_round_trip(spark, which, request):
    docs = request.getfixturevalue(which)
    t, start, want = library("byte_bpe_50k.json"), 0, []
    for r in ordered((r.doc_id, r.text) for r in docs.collect()):
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    out = fresh_path(spark, "test")
    binary.write_token_files(docs, queries.tokenizer("byte_bpe_50k.json"), out)
    assert sorted((tuple(r) for r in binary.read_token_files(spark, out).collect()), key=lambda r: r[1]) == want
    one = docs.filter("doc_id = 7").first()
    found = binary.lookup(spark, out, 7)
    assert found[0].tolist() == t.encode(one.text, add_special_tokens=False).ids + [2] and len(found) == docs.filter("doc_id = 7").count()
    assert binary.lookup(spark, out, 10**12) == []
    empty = [r for r in docs.collect() if r.doc_id is None]
    assert len(binary.lookup(spark, out, None)) == len(empty)


def test_a_lookup_opens_one_shard_and_reads_little(spark, monkeypatch):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("text"))
    out = fresh_path(spark, "test")
    monkeypatch.setattr(binary, "LEAST_BYTES", 4000)
    binary.write_token_files(docs, queries.tokenizer("byte_bpe_50k.json"), out)
    manifest = spark.read.parquet(f"{out}/manifest")
    assert manifest.count() > 4
    opened, read = [], []
    kept, bytes_ = binary.ShardReader.__init__, binary.ShardReader._bytes
    monkeypatch.setattr(binary.ShardReader, "__init__", lambda self, path: (opened.append(path), kept(self, path))[1])
    monkeypatch.setattr(binary.ShardReader, "_bytes", lambda self, at, size: (read.append(size), bytes_(self, at, size))[1])
    for key in (0, 1234, 3999):
        opened.clear(), read.clear()
        assert library("byte_bpe_50k.json").decode(binary.lookup(spark, out, key)[0].tolist()[:-1]) == f"text of {key}"
        assert len(opened) == 1 and sum(read) < 2000 and len(read) < 40
    opened.clear()
    assert binary.lookup(spark, out, 5000) == [] and binary.lookup(spark, out, -1) == [] and not opened


def test_perfect_hash_is_minimal_and_knows_strangers():
    keys = text.mix64(np.arange(20_000))
    mph = binary.PerfectHash.build(keys)
    assert np.array_equal(np.sort(mph.slots(keys)), np.arange(len(keys)))
    strangers = text.mix64(np.arange(50_000, 60_000))
    slot, mark = mph.slots(strangers), np.zeros(len(keys), "<u4")
    mark[mph.slots(keys)] = binary.fingerprints(keys)
    assert ((slot < 0) | (mark[slot] != binary.fingerprints(strangers))).all()
    assert len(binary.PerfectHash.build(np.zeros(0, np.uint64)).slots(keys[:3])) == 3


def brute_contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda x: word.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), x or ""))
    windows = defaultdict(set)
    for name, x in items:
        w = cut(x)
        for i in range(max(len(w) - 12, 1) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(name))
    sizes, out = {len(w) for w in windows}, []
    for name, x in docs:
        w, hit, who = cut(x), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    who |= found
                    hit |= set(range(i, i + n))
        out.append((name, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("short", [False, True])
def test_decontamination_is_brute_force(spark, documents, awkward, short):
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    items += [(900, "A B c"), (901, "the of"), (902, None), (903, "..."), (904, "lone"), (905, items[0][1])] if short else []
    docs = documents.select("doc_id", "text").union(awkward.select("doc_id", "text"))
    got = fmindex.decontamination_query(docs, spark.createDataFrame(items, "item_id long, text string")).drop("spans").collect()
    assert Counter(map(tuple, got)) == Counter(brute_contamination([tuple(r) for r in docs.collect()], items))


def test_decontamination_in_blocks_gives_the_same(spark, documents):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert len(fmindex.benchmark_blocks(bench)) == 1 < len(fmindex.benchmark_blocks(bench, limit=2000))
    found = [sorted(map(str, fmindex.find_contamination(documents, bench, keep=["doc_id"], limit=limit).collect())) for limit in (fmindex.BENCHMARK_BYTES, 2000)]
    assert found[0] == found[1] and fmindex.find_contamination(documents, bench).filter("n_hit > 0").count()


def test_windows_of_equal_codes_stay_apart(monkeypatch):
    """Windows are told apart word by word, whatever their hash codes; equal ones may then stand twice."""
    monkeypatch.setattr(text, "constants", lambda n, seed: np.zeros(n, np.uint64))
    got = fmindex.Phrases.of(["a", "b", "c", "a"], ["x y z", "x y w", "x y z", "q r s t"], 3)
    rows = defaultdict(set)
    for p, a, b in zip(got.patterns.tolist(), got.item_first[:-1], got.item_first[1:], strict=True):
        rows[tuple(p)] |= {got.names[i].decode() for i in got.items[a:b]}
    assert sorted(map(sorted, rows.values())) == [["a"], ["a"], ["a", "c"], ["b"]]


def test_removal_spans_cover_the_words(spark):
    bench = spark.createDataFrame([(1, "Eins zwei drei")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "äö EINS, zwei drei! x eins zwei drei")], "doc_id long, text string")
    r = fmindex.find_contamination(docs, bench).first()
    assert [r.text[s.start : s.end] for s in r.spans] == ["EINS, zwei drei", "eins zwei drei"]
    assert fmindex.decontaminated(docs, bench).count() == 0


def test_empty_tables(spark, documents):
    none, docs = documents.limit(0), documents.limit(3)
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").limit(0)
    labels = spark.read.parquet(f"{DATA}/labels.parquet").limit(0)
    assert fingerprint.fingerprint_query(none).count() == 0
    assert tokens.count_query(none, queries.tokenizer("word_bpe_49k.json")).count() == 0
    assert binary.binary_query(none, queries.tokenizer("byte_bpe_50k.json")).count() == 0
    assert fmindex.decontamination_query(none, bench).count() == 0
    assert [r.n_hit for r in fmindex.decontamination_query(docs, bench).collect()] == [0, 0, 0]
    assert langid.language_query(none).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}
    assert {r.score for r in toxicity.toxicity_query(docs, labels).collect()} == {0.5}


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_fingerprints_follow_the_next_document(which, request):
    docs = request.getfixturevalue(which)
    rows = ordered((r.doc_id, r.text) for r in docs.collect())
    shingles = lambda x: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), x))] for i in range(max(1, len(w) - 4) if w else 0)}
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = {}
    for (name, x), (_, y) in zip(rows, rows[1:] + rows[:1], strict=True):
        x, y = x or "", y or ""
        half = len(x) // 2
        edited = x[: len(x) - half] + y[:half]
        inside = len(shingles(x) & shingles(edited)) / len(shingles(x)) if shingles(x) else 1.0
        want[name, hashlib.sha256(edited.encode()).hexdigest()] = (len(x), likeness(shingles(x), shingles(edited)), likeness(shingles(x), shingles(y)), inside, len(shingles(x)))
    got = fingerprint.fingerprint_query(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        n, near_edited, near_next, inside, distinct = want[r.doc_id, r.edited_sha256]
        assert abs(r.kept_by_edit - inside) < 0.3 and abs(r.n_distinct - distinct) <= 0.3 * distinct
        assert r.n_chars == n and abs(r.near_edited - near_edited) < 0.17 and abs(r.near_next - near_next) < 0.17


def test_sketches_merge_and_estimate(spark):
    words = [f"w{i}" for i in range(6000)]
    a, b, whole = (fingerprint.sketches(text.Texts.of([" ".join(x)]))[0] for x in (words[:4004], words[4000:], words))
    assert np.array_equal(fingerprint.merged(a, b), whole)
    assert abs(fingerprint.distinct(whole) / 5996 - 1) < 0.3
    assert fingerprint.containment(a, whole) > 0.8 and abs(fingerprint.containment(whole, a) - 0.67) < 0.15
    assert np.array_equal(fingerprint.decoded(fingerprint.encoded(a)), a)
    parts = fingerprint.fingerprint(spark.createDataFrame([("k", " ".join(words[:4004])), ("k", " ".join(words[4000:])), ("e", None)], "k string, text string"))
    merged = {r.k: r.fingerprint for r in fingerprint.merge_fingerprints(parts, ["k"]).collect()}
    assert np.array_equal(np.array(merged["k"], np.int64).view(np.uint64), whole) and merged["e"] == []


def test_language_held_out_accuracy(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_query(docs).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.filter("held_out").select(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.97
    odd = langid.identify(awkward, {"en": b"the of and to in word two three end", "fr": b"le la de et"}).collect()
    assert len(odd) == len(AWKWARD) and {r.lang_pred for r in odd if not r.text} == {"und"}


def test_language_is_plain_zstandard(spark, documents, awkward):
    """Each prediction again, by the library alone: the whole text in parts at spaces under each dictionary, fewest bytes win."""
    dictionaries = langid.fit_dictionaries(documents)
    assert set(dictionaries) == {r.lang for r in documents.filter(~langid.held_out()).select("lang").distinct().collect()} and all(len(x) <= langid.DICTIONARY_BYTES for x in dictionaries.values())
    docs = documents.select("doc_id", "text").union(awkward.select("doc_id", "text"))
    letters = re.compile(r"[^\W\d_]")
    for r in langid.identify(docs, dictionaries).collect():
        if not r.text or not letters.search(r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        data, sizes = langid.normal(r.text), {}
        for name, content in dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            one = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            at, total = 0, 0
            while at < len(data):
                to = len(data) if len(data) - at <= langid.PART_BYTES else (data.rfind(b" ", at, at + langid.PART_BYTES) + 1 or at + langid.PART_BYTES)
                total += len(one.compress(data[at:to]))
                at = to
            sizes[name] = total
        assert sizes[r.lang_pred] == min(sizes.values()) and 0 < r.score <= 1


def test_dictionaries_take_turns(spark):
    """A text of any length gives a piece in each turn until the dictionary is full; its head of figures counts for nothing."""
    rows = [(i, "0123 " * 4000 + " ".join(f"{w}{c}" for c in "abcdefgh" for w in ("alpha", "beta"))) for i in range(40)] + [(100, "zulu " * 50_000)]
    docs = spark.createDataFrame([(i, x, "xx") for i, x in rows], "doc_id long, text string, lang string")
    got = langid.fit_dictionaries(docs, size=20_000)["xx"]
    seen = sum(b"betah" in x for x in got.split(b"alphaa")[1:])
    assert len(got) <= 20_000 and seen == docs.filter(~langid.held_out()).filter("doc_id < 100").count() and (b"zulu" in got) == (docs.filter(langid.held_out()).filter("doc_id = 100").count() == 0)
    assert b"".join(langid.parts("äöü".encode() * 900, 512)) == "äöü".encode() * 900 and all(x.decode() for x in langid.parts("äöü".encode() * 900, 512))


def test_ftrl_is_the_plain_recurrence():
    """The weights of the vectorised fit against the published update, a coordinate at a time."""
    rng = np.random.default_rng(9)
    rows = [(np.unique(rng.integers(0, 60, 12)), int(y)) for y in rng.random(80) < 0.4]
    p = toxicity.Ftrl(l1=0.5, epochs=2)
    z, n, bz, bn = Counter(), Counter(), 0.0, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= p.l1 else -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + n[i] ** 0.5) / p.alpha + p.l2)
    for _ in range(p.epochs):
        for at, y in rows:
            w = {i: weight(i) for i in at.tolist()}
            bias = -bz / ((p.beta + bn**0.5) / p.alpha)
            g = (1 / (1 + math.exp(-(sum(w.values()) + bias))) - y) * (p.positive if y else 1.0)
            for i in w:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / p.alpha * w[i]
                n[i] += g * g
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / p.alpha * bias
            bn += g * g
    places, values, bias = toxicity.fit_rows(rows, p, bits=8)
    want = {i: weight(i) for i in z if weight(i)}
    assert dict(zip(places.tolist(), values.tolist())) == pytest.approx(want) and bias == pytest.approx(-bz / ((p.beta + bn**0.5) / p.alpha))


def test_toxicity_scores_are_sums_of_weights():
    """Scores by hand: each distinct feature of a text, for each of its first occurrences, through a dictionary."""
    texts = ["Bad bad word, bad WORDS indeed", "", None, "nothing here at all " * 30, "bad " * 5]
    rng = np.random.default_rng(2)
    at, _ = toxicity.features(text.Texts.of(texts))
    places = np.unique(np.concatenate([at | level << toxicity.BITS for level in range(toxicity.LEVELS)]))[::2]
    model = toxicity.Model(places, rng.normal(size=len(places)), 0.25)
    table = dict(zip(places.tolist(), model.weights.tolist()))
    for x, got in zip(texts, model.scores(text.Texts.of(texts)).tolist(), strict=True):
        count = Counter(toxicity.features(text.Texts.of([x]))[0].tolist())
        total = 0.25 + sum(table.get(i | level << toxicity.BITS, 0.0) for i, n in count.items() for level in range(min(n, toxicity.LEVELS)))
        assert got == pytest.approx(1 / (1 + math.exp(-total)))


def test_filters_keep_clashing_columns(spark):
    rows = [(i, x, 7.5, "mine", i) for i, x in enumerate((None, "", "a calm text of no harm", "Eins zwei drei"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, items string, own int")
    bench = spark.createDataFrame([(1, "Eins zwei drei")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    clean = fmindex.decontaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect())) == sorted(rows[:3])
    mild = toxicity.without_toxic(docs, labels, threshold=0.6)
    assert mild.columns == docs.columns and sorted(map(tuple, mild.collect())) == sorted(rows)


def test_long_words_hash_in_pieces():
    long = "q" * (300 << 10)
    texts = text.Texts.of([long, f"a {long} b", long[:-1] + "z", long + "q"])
    at = text.spans(texts, text.NOT_SPACE)
    h = text.span_hashes(texts.data, at.starts, at.ends)
    assert h[0] == h[2] and len(set(h.tolist())) == 5 and len(text._place) <= text.LONG_SPAN
    assert text.Texts.of([long, "ä", "", None]).code_points().tolist() == [300 << 10, 1, 0, 0]


def test_toxicity_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    rows = toxicity.toxicity_query(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    pos, neg = [[r.score for r in rows if r.toxic == y] for y in (1, 0)]
    auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
    assert auc > 0.97
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.97


def test_weights_are_sparse():
    rng = np.random.default_rng(5)
    rows = [(np.unique(np.append(rng.integers(100, 5000, 40), 7 if y else 8)), int(y)) for y in rng.random(600) < 0.3]
    places, values, _ = toxicity.fit_rows(rows, toxicity.Ftrl(), bits=13)
    assert len(places) < 2500 and values[places == 7][0] > 1
