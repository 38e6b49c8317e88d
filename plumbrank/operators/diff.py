"""Comparing two runs query by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import direction
from .diagnose import Diagnosis
from .ranking import best_relevant, by_movement


def compare_runs(left: DataFrame, right: DataFrame, qrels: DataFrame, left_evidence: DataFrame | None = None, right_evidence: DataFrame | None = None) -> DataFrame:
    """(query_id, left_rank, right_rank, direction, arbitrary) for judged queries that both runs have.

    A movement is arbitrary where on either side the gold document ties with the first
    one: the tie-break made it. Without evidence nothing is.
    """
    side = lambda run, name: best_relevant(run, qrels).select("query_id", F.col("gold_rank").alias(name))
    rows = side(left, "left_rank").join(side(right, "right_rank"), "query_id").withColumn("direction", direction(F.col("left_rank"), F.col("right_rank")))
    tied = F.lit(False)
    for name, evidence in (("_left", left_evidence), ("_right", right_evidence)):
        if evidence is not None:
            rows = rows.join(evidence.select("query_id", F.col("tied_with_top1").alias(name)), "query_id", "left")
            tied = tied | F.coalesce(F.col(name), F.lit(False))
    return rows.select("query_id", "left_rank", "right_rank", "direction", ((F.col("direction") != "unchanged") & tied).alias("arbitrary"))


def diff_counts(deltas: DataFrame) -> DataFrame:
    """One row: improved, regressed, unchanged, arbitrary."""
    count = lambda c, name: F.count_if(c).alias(name)
    return deltas.agg(*[count(F.col("direction") == x, x) for x in ("improved", "regressed", "unchanged")], count(F.col("arbitrary"), "arbitrary"))


def headline(counts: dict[str, int]) -> str:
    note = f" ({counts['arbitrary']} arbitrary)" if counts["arbitrary"] else ""
    return f"+{counts['improved']} -{counts['regressed']} ={counts['unchanged']}{note}"


def is_first(rank: Column) -> Column:
    return rank.eqNullSafe(F.lit(1))


def became(deltas: DataFrame) -> DataFrame:
    """With became_failure and became_success; a missing rank is not the first."""
    left, right = is_first(F.col("left_rank")), is_first(F.col("right_rank"))
    return deltas.withColumns({"became_failure": left & ~right, "became_success": ~left & right})


def fails_both(left: Diagnosis | DataFrame, right: Diagnosis | DataFrame) -> DataFrame:
    failing = [x.failing() if isinstance(x, Diagnosis) else x.filter("symptom <> 'ok'") for x in (left, right)]
    return failing[0].select("query_id").join(failing[1].select("query_id"), "query_id")


def viewer_rows(deltas: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Deltas with both sides' symptoms and reranker ranks; queries that a side lacks drop out."""
    pick = lambda e, s: e.select("query_id", F.col("symptom").alias(f"{s}_symptom"), F.col("rank_before_rerank").alias(f"{s}_before"), F.col("gold_rank").alias(f"{s}_gold_rank"))
    return deltas.join(pick(left, "left"), "query_id").join(pick(right, "right"), "query_id")


def viewer_filter(rows: DataFrame, which: str) -> DataFrame:
    conditions = {"all": "true", "improved": "direction = 'improved'", "regressed": "direction = 'regressed'", "fails_both": "left_symptom <> 'ok' and right_symptom <> 'ok'"}
    if which not in conditions:
        raise ValueError(f"unknown filter {which!r}; known: {', '.join(conditions)}")
    return by_movement(rows.filter(conditions[which]))


def reranker_explains(rows: DataFrame) -> DataFrame:
    """Viewer rows with `explained`: right was reranked, left was not, and before reranking right stood where left stands."""
    explained = F.col("right_before").isNotNull() & F.col("left_before").isNull() & F.col("right_before").eqNullSafe(F.col("left_rank")) & F.col("right_gold_rank").eqNullSafe(F.col("right_rank"))
    return rows.withColumn("explained", explained)


def set_sizes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(kind, left_n, right_n) over the causes of either side; the right side's largest first."""
    count = lambda h, name: h.groupBy("kind").agg(F.countDistinct("query_id").alias(name))
    both = count(left, "left_n").join(count(right, "right_n"), "kind", "full_outer").na.fill(0, ["left_n", "right_n"])
    return both.orderBy(F.desc("right_n"), "kind")


def opener(rows: DataFrame) -> DataFrame:
    """The query that a viewer opens first: the first regression that fails on the right, else the first that moved."""
    place = F.when((F.col("direction") == "regressed") & (F.col("right_symptom") != "ok"), 0).when(F.col("direction") != "unchanged", 1)
    moved = rows.withColumn("_place", place).filter("_place is not null")
    gain = F.coalesce("right_rank", F.lit(1 << 30)) - F.coalesce("left_rank", F.lit(1 << 30))
    return moved.orderBy("_place", gain, "query_id").limit(1).drop("_place")


def demo_opener(deltas: DataFrame) -> DataFrame:
    """For the report: the first improvement that became a success, else the first improvement, else the first regression."""
    rows = became(deltas)
    place = F.when((F.col("direction") == "improved") & F.col("became_success"), 0).when(F.col("direction") == "improved", 1).when(F.col("direction") == "regressed", 2)
    return rows.withColumn("_place", place).filter("_place is not null").orderBy("_place", "query_id").limit(1).drop("_place")
