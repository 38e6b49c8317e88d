"""Runs and labels: ranking, judged queries, the best relevant document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import PLACES, weight_rank


def rank(scored: DataFrame, k: int | None = None, unit: str = "doc_id") -> DataFrame:
    """(query_id, unit, rank, score): best score first, equal scores by unit id; the first k of each query.

    Scores are rounded once, here. Spark limits each query's rows ahead of the
    shuffle, so a query's candidates are never gathered.
    """
    rounded = scored.select("query_id", unit, (F.round("score", PLACES) + F.lit(0.0)).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(unit).asc()))
    out = rounded.withColumn("rank", place)
    return (out if k is None else out.filter(F.col("rank") <= k)).select("query_id", unit, "rank", "score")


def top(run: DataFrame, n: int = 5) -> DataFrame:
    return run.filter(F.col("rank") <= n)


def of_query(rows: DataFrame, query_id: str) -> DataFrame:
    """What a run, or a table of evidence or hypotheses, says of one query."""
    return rows.filter(F.col("query_id") == query_id)


def stored_order(run: DataFrame) -> DataFrame:
    return run.orderBy("query_id", "rank")


def rank_scores(run: DataFrame) -> DataFrame:
    """A score that falls by one with each rank: the order and nothing else."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return run.withColumn("rank_score", (n - F.col("rank") + 1).cast("double"))


def relevant(grade: str = "relevance") -> Column:
    """Unjudged counts as not relevant."""
    return F.coalesce(grade, F.lit(0)) > 0


def judged(qrels: DataFrame) -> DataFrame:
    """Queries with a positive label."""
    return qrels.filter("relevance > 0").select("query_id").distinct()


def labelled(run: DataFrame, qrels: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The run of judged queries with `relevance` (null where unjudged). known: labels, or numbers of them, that say which queries are judged; else qrels do."""
    return run.join(judged(qrels if known is None else known), "query_id", "left_semi").join(qrels, ["query_id", "doc_id"], "left")


def best_relevant(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, gold_rank, best_relevant) of each judged query that has a ranking; null where no relevant document is in it."""
    gold = F.when(relevant(), F.col("rank"))
    return labelled(run, qrels).groupBy("query_id").agg(F.min(gold).alias("gold_rank"), F.min_by("doc_id", gold).alias("best_relevant"))


def reference_gold(qrels: DataFrame) -> DataFrame:
    """(query_id, reference_gold): the highest grade, and of equal ones the largest id."""
    return qrels.filter("relevance > 0").groupBy("query_id").agg(F.max(F.struct("relevance", "doc_id")).alias("_g")).select("query_id", F.col("_g.doc_id").alias("reference_gold"))


def movement(before: DataFrame, after: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, before_rank, after_rank) of the best relevant document, for judged queries in both runs."""
    side = lambda run, name: best_relevant(run, qrels).select("query_id", F.col("gold_rank").alias(name))
    return side(before, "before_rank").join(side(after, "after_rank"), "query_id")


def by_movement(rows: DataFrame) -> DataFrame:
    """Largest gains first: right rank less left rank, then query id."""
    return rows.orderBy(weight_rank(F.col("right_rank")) - weight_rank(F.col("left_rank")), "query_id")
