"""Registered queries over the tasks, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import chunk, diagnose, diff, evaluate, index, labelling, ranking, retrieve, significance
from ..session import materialise, spread
from . import tasks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
MORE_MEASURES = ("ERR", "RBP", "Judged@10", "Bpref", "Rprec", "SetP", "SetR", "SetF")
MEASURES = ("nDCG@10", "RR", "R@10", "P@10", "AP", "Success@5", "RR@5", "AP@5", "nDCG")
DRAWN = 20


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles as both engines print them, after sums in whatever order."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Tokens, index, statistics


@query
def tokenize_terms(spark, sf):
    words = text.word_set(F.col("text"))
    return spread(tasks.corpus(spark, sf)).select("doc_id", F.size(words).alias("n_terms"), F.md5(F.array_join(F.array_sort(words), " ")).alias("terms_md5"))


@query
def bm25_tokens_stopped(spark, sf):
    found = text.terms(F.col("text"))
    return spread(tasks.corpus(spark, sf)).select("doc_id", F.size(found).alias("n_terms"), F.md5(F.array_join(found, " ")).alias("terms_md5"))


@query
def word_split(spark, sf):
    found = text.words(F.col("text"))
    return spread(tasks.corpus(spark, sf)).select("doc_id", F.size(found).alias("n_words"), F.md5(F.array_join(found, " ")).alias("words_md5"))


def _term_index(spark, sf) -> index.TermIndex:
    return index.TermIndex.build(tasks.corpus(spark, sf), "doc_id", "en", None, True, text.TERM)


@query
def term_frequency(spark, sf):
    return _term_index(spark, sf).postings.select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


@query
def doc_frequency_idf(spark, sf):
    return rounded(index.smoothed_idf(tasks.corpus(spark, sf)).withColumn("df", F.col("df").cast("long")), 9)


@query
def doc_length_stats(spark, sf):
    return rounded(_term_index(spark, sf).stats)


@query
def char_ngrams_df(spark, sf):
    """Occurrences and documents of each gram of three characters."""
    grams = text.char_ngrams(spread(tasks.corpus(spark, sf)), "doc_id", 3, 3)
    tf = grams.groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("tf"))
    return tf.groupBy("gram").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("df"))


# Retrieval


def _bm25(method: str) -> Query:
    return lambda spark, sf: tasks.bm25_run(spark, sf, method=method)


for _name, _method in (("lucene", "lucene"), ("robertson", "robertson"), ("atire", "atire"), ("plus", "bm25+"), ("l", "bm25l")):
    QUERIES[f"bm25_{_name}_topk"] = _bm25(_method)


@query
def tfidf_char_topk(spark, sf):
    task = tasks.known_item(spark, sf)
    return retrieve.retrieve(retrieve.build("tfidf"), task.corpus, task.queries, tasks.K)


@query
def tfidf_raw_tf_topk(spark, sf):
    task = tasks.known_item(spark, sf)
    return retrieve.retrieve(retrieve.build("tfidf", ngram_range=(3, 3), sublinear_tf=False, smooth_idf=False), task.corpus, task.queries, tasks.K)


@query
def dense_cosine_topk(spark, sf):
    task = tasks.vectors(spark, sf, scaled=True)
    return rounded(retrieve.retrieve(retrieve.build("dense"), task.corpus, task.queries, tasks.K))


@query
def dense_dot_topk(spark, sf):
    task = tasks.vectors(spark, sf, scaled=True)
    return rounded(retrieve.retrieve(retrieve.build("dense", normalize=False), task.corpus, task.queries, tasks.K))


@query
def passage_bm25_topk(spark, sf):
    task = tasks.passage(spark, sf)
    return retrieve.retrieve(retrieve.build("bm25"), task.corpus, task.queries, tasks.K)


# Chunks and reranking


@query
def chunk_fixed_words(spark, sf):
    cut = chunk.FixedWords(120, 30).cut(tasks.corpus(spark, sf))
    return cut.select("chunk_id", "doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query
def chunks_of_document(spark, sf):
    """The chunks of document 50."""
    return chunk.chunks_of(chunk_fixed_words(spark, sf), "50")


@query
def hits_of_query(spark, sf):
    """What the first formulation of document 50 finds."""
    return tasks.bm25_run(spark, sf, query_id="q-50-a")


@query
def causes_of_query(spark, sf):
    """What may have caused the failure of the first formulation of document 0."""
    return ranking.of_query(QUERIES["hypotheses"](spark, sf), "q-0-a")


@query
def chunk_whole(spark, sf):
    return chunk.Whole().cut(tasks.corpus(spark, sf)).select("chunk_id", "doc_id", F.length("text").alias("n_chars"))


@query
def chunks_per_document(spark, sf):
    return chunk.chunks_per_document(chunk.FixedWords().cut(tasks.corpus(spark, sf)))


@query
def chunk_mean(spark, sf):
    return rounded(chunk.mean_chunks(chunk.FixedWords().cut(tasks.corpus(spark, sf))))


@query
def bm25_chunked_folded(spark, sf):
    return tasks.chunked_run(spark, sf)


@query
def rerank_coverage(spark, sf):
    return tasks.reranked(spark, sf).after


@query
def rerank_coverage_penalty(spark, sf):
    return tasks.reranked(spark, sf, 0.05).after


@query
def rerank_movement(spark, sf):
    both = tasks.reranked(spark, sf)
    return ranking.movement(both.before, both.after, tasks.known_item(spark, sf).qrels)


# Labels and measures


@query
def judged_queries(spark, sf):
    return ranking.judged(tasks.passage(spark, sf).qrels)


@query
def best_relevant(spark, sf):
    return ranking.best_relevant(tasks.left_run(spark, sf), tasks.known_item(spark, sf).qrels)


@query
def reference_gold(spark, sf):
    return ranking.reference_gold(tasks.passage(spark, sf).qrels)


@query
def rank_scores(spark, sf):
    return ranking.rank_scores(tasks.left_run(spark, sf)).select("query_id", "doc_id", "rank_score")


@query
def metrics_long(spark, sf):
    return rounded(tasks.metrics(spark, sf, "left", MEASURES))


@query
def metrics_more(spark, sf):
    """Measures of readers who stop, of what is judged, and of the run as a set."""
    return rounded(tasks.metrics(spark, sf, "left", MORE_MEASURES))


@query
def metrics_aggregate(spark, sf):
    return rounded(evaluate.aggregate(tasks.metrics(spark, sf, "left", MEASURES)))


@query
def metrics_passage(spark, sf):
    return rounded(evaluate.evaluate(passage_bm25_topk(spark, sf), tasks.passage(spark, sf).qrels, MEASURES))


@query
def metrics_dense(spark, sf):
    run = materialise(dense_cosine_topk(spark, sf), "dense")
    qrels, grades = tasks.vector_labels(spark, sf, run)
    return rounded(evaluate.evaluate(run, qrels, MEASURES, grades))


# Diagnosis


def _evidence(side: str) -> Query:
    return lambda spark, sf: rounded(tasks.diagnosis(spark, sf, side).evidence)


QUERIES |= {"evidence": _evidence("left"), "evidence_reranked": _evidence("reranked")}


@query
def weighted_overlap(spark, sf):
    return rounded(tasks.diagnosis(spark, sf, "left").evidence.select("query_id", "query_gold_overlap", "competitor_gold_overlap"))


@query
def calibration(spark, sf):
    return rounded(tasks.diagnosis(spark, sf, "left").calibration)


def _hypotheses(side: str) -> Query:
    return lambda spark, sf: tasks.diagnosis(spark, sf, side).hypotheses.drop("because")


QUERIES |= {"hypotheses": _hypotheses("left"), "hypotheses_reranked": _hypotheses("reranked")}


@query
def failure_sets(spark, sf):
    found = diagnose.failure_sets(tasks.diagnosis(spark, sf, "left"))
    return found.select("kind", F.size("queries").alias("n"), F.array_join("queries", ",").alias("queries"))


@query
def symptom_counts(spark, sf):
    return diagnose.symptom_counts(tasks.diagnosis(spark, sf, "left").evidence)


@query
def cause_counts(spark, sf):
    return diagnose.cause_counts(tasks.diagnosis(spark, sf, "left").hypotheses)


# Comparison


def _deltas(spark, sf) -> DataFrame:
    left, right = (tasks.diagnosis(spark, sf, x).evidence for x in ("left", "right"))
    return diff.compare_runs(tasks.left_run(spark, sf), tasks.right_run(spark, sf), tasks.known_item(spark, sf).qrels, left, right)


@query
def diff_deltas(spark, sf):
    return _deltas(spark, sf)


@query
def diff_counts(spark, sf):
    return diff.diff_counts(_deltas(spark, sf))


@query
def diff_became(spark, sf):
    return diff.became(_deltas(spark, sf)).select("query_id", "became_failure", "became_success")


@query
def fails_both(spark, sf):
    return diff.fails_both(*(tasks.diagnosis(spark, sf, x) for x in ("left", "right")))


@query
def movement_order(spark, sf):
    moved: Column = scoring.weight_rank(F.col("right_rank")) - scoring.weight_rank(F.col("left_rank"))
    return ranking.by_movement(_deltas(spark, sf)).select("query_id", moved.alias("moved"))


def _viewer(spark, sf, right: str = "right") -> DataFrame:
    left, other = (tasks.diagnosis(spark, sf, x).evidence for x in ("left", right))
    run = tasks.right_run(spark, sf) if right == "right" else tasks.reranked(spark, sf).after
    deltas = diff.compare_runs(tasks.left_run(spark, sf), run, tasks.known_item(spark, sf).qrels, left, other)
    return diff.viewer_rows(deltas, left, other)


@query
def viewer_rows(spark, sf):
    return _viewer(spark, sf).select("query_id", "left_rank", "right_rank", "direction", "arbitrary", "left_symptom", "right_symptom")


@query
def viewer_fails_both(spark, sf):
    return diff.viewer_filter(_viewer(spark, sf), "fails_both").select("query_id", "direction", "left_symptom", "right_symptom")


@query
def viewer_opener(spark, sf):
    return diff.opener(_viewer(spark, sf)).select("query_id", "direction", "right_symptom")


@query
def rerank_explains(spark, sf):
    return diff.reranker_explains(_viewer(spark, sf, "reranked")).select("query_id", "left_rank", "right_rank", "right_before", "explained")


@query
def set_sizes(spark, sf):
    return diff.set_sizes(*(tasks.diagnosis(spark, sf, x).hypotheses for x in ("left", "right")))


@query
def paired_delta(spark, sf):
    return rounded(significance.paired_delta(*(tasks.metrics(spark, sf, x, MEASURES) for x in ("left", "right"))))


@query
def paired_coverage_check(spark, sf):
    return significance.pairing(*(tasks.metrics(spark, sf, x, MEASURES) for x in ("left", "right")))


@query
def significance_bootstrap(spark, sf):
    return significance.compare_measures(*(tasks.metrics(spark, sf, x, evaluate.DEFAULT_MEASURES) for x in ("left", "right")))


@query
def significance_verdicts(spark, sf):
    """Differences of all measures, judged as the operator does by itself: 10,000 resamples, its own seed and level."""
    return significance.compare_measures(*(tasks.metrics(spark, sf, x, MEASURES) for x in ("left", "right"))).select("measure", "n", "delta", "ci_low", "ci_high", "p_value", "underpowered", "is_real")


@query
def significance_hashed(spark, sf):
    return significance.hashed_significance(*(tasks.metrics(spark, sf, x, ("nDCG@10", "RR")) for x in ("left", "right")))


@query
def real_differences(spark, sf):
    return significance.real_differences(significance_hashed(spark, sf)).select("measure", "delta")


@query
def verdict_counts(spark, sf):
    return significance.verdict_counts(significance_hashed(spark, sf))


@query
def demo_opener(spark, sf):
    return diff.demo_opener(_deltas(spark, sf)).select("query_id", "direction", "became_success")


@query
def dataset_summary(spark, sf):
    """Documents and judged queries of the known-item task."""
    task = tasks.known_item(spark, sf)
    return task.corpus.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(ranking.judged(task.qrels).agg(F.count(F.lit(1)).alias("n_judged")))


@query
def run_health(spark, sf):
    """What `show` prints of a run: mean measures beside failing and all judged queries."""
    evidence = tasks.diagnosis(spark, sf, "left").evidence
    health = evidence.agg(F.count_if(F.col("symptom") != "ok").alias("n_failing"), F.count(F.lit(1)).alias("n_judged"))
    return metrics_aggregate(spark, sf).crossJoin(health)


# Labelling


def _drawn(spark, sf) -> DataFrame:
    return labelling.sample_failures_hashed(tasks.diagnosis(spark, sf, "left").evidence, DRAWN)


@query
def label_sample_hashed(spark, sf):
    return _drawn(spark, sf)


@query
def label_cases(spark, sf):
    task = tasks.known_item(spark, sf)
    found = labelling.cases(_drawn(spark, sf), tasks.diagnosis(spark, sf, "left").evidence, tasks.left_run(spark, sf), task.queries, task.corpus, task.qrels)
    return rounded(found.select("query_id", "query", "symptom", "gold_rank", "gold_id", F.md5("gold_text").alias("gold_md5"), F.array_join(F.transform("retrieved", lambda h: F.concat_ws(":", h["rank"], h["doc_id"], h["relevant"])), ",").alias("retrieved"), "query_gold_overlap"))


def _labels(spark, sf) -> DataFrame:
    """Stand-in for a filled sheet: every failing query, its cause by formulation."""
    failing = tasks.diagnosis(spark, sf, "left").failing().select("query_id", "symptom")
    return failing.withColumn("cause", F.when(F.endswith("query_id", F.lit("b")), "lexical_mismatch").otherwise("hard_negative"))


@query
def label_agreement(spark, sf):
    d = tasks.diagnosis(spark, sf, "left")
    return rounded(labelling.agreement(_labels(spark, sf).select("query_id", "cause"), d.evidence, d.hypotheses))


@query
def label_agreement_by_cause(spark, sf):
    d = tasks.diagnosis(spark, sf, "left")
    return rounded(labelling.agreement_by_cause(_labels(spark, sf).select("query_id", "cause"), d.evidence, d.hypotheses))


@query
def label_unlabelled(spark, sf):
    """Drawn failures that a sheet lacks whose writer left the misses open."""
    return labelling.unlabelled(_drawn(spark, sf), _labels(spark, sf).filter("symptom <> 'miss'"))


@query
def referential_violations(spark, sf):
    """Ids that are referred to and not there: `documents` against the ids that `labels` knows."""
    from ..session import read_table
    from ..sources.dataset import dangling

    rows, known = (read_table(spark, sf, x).select(F.col("doc_id").cast("string").alias("doc_id")) for x in ("documents", "labels"))
    return dangling(rows, known, "doc_id")


@query
def duplicate_ids(spark, sf):
    from ..session import read_table
    from ..sources.dataset import duplicates

    return duplicates(read_table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("query_id")), "query_id")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each judged query: BM25's rank of its document, the symptom, reciprocal rank."""
    task = tasks.known_item(spark, sf)
    run = tasks.bm25_run(spark, sf)
    gold = ranking.best_relevant(run, task.qrels)
    symptom = F.when(F.col("gold_rank").isNull(), "miss").when(F.col("gold_rank") == 1, "ok").otherwise("rank")
    return gold.select("query_id", "gold_rank", symptom.alias("symptom"), F.coalesce(F.round(1.0 / F.col("gold_rank"), 6), F.lit(0.0)).alias("rr"))


QUERIES["flagship_known_item"] = flagship
