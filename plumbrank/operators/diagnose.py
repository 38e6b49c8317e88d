"""Evidence about each judged query, what is normal in a dataset, and rules that name causes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import broadcast_if_small, materialise
from .index import smoothed_idf
from .ranking import labelled, reference_gold, relevant

MIN_QUERIES = 30
LOW_QUANTILE, HIGH_QUANTILE = 0.25, 0.75
#: Decimal places of overlaps, which are compared with quantiles of their own column.
OVERLAP_PLACES = 12
#: Overlaps as whole numbers have at most so many bits; bits that a round of a selection decides.
DIGITS, DIGIT = 50, 10


def overlaps(sides: DataFrame, corpus: DataFrame, idf: DataFrame | None = None) -> DataFrame:
    """(query_id, query_gold_overlap, competitor_gold_overlap, query_token_count) from sides (query_id, side, text).

    Weighted Jaccard similarity of word sets: idf of the shared words over that of all;
    a word that the corpus lacks weighs 1; an empty side gives 0. Only words of the
    given sides are looked up. idf: (term, idf) of the corpus, where it is known already.
    """
    found = sides.select("query_id", "side", F.explode(text.word_set(F.col("text"))).alias("term"))
    flags = found.groupBy("query_id", "term").agg(*[F.max((F.col("side") == x).cast("int")).alias(x) for x in ("query", "gold", "top")])
    weighed = flags.join(smoothed_idf(corpus, flags) if idf is None else idf, "term", "left").withColumn("w", F.coalesce("idf", F.lit(1.0)))

    def overlap(a: str, b: str) -> Column:
        both = F.sum(F.when((F.col(a) == 1) & (F.col(b) == 1), F.col("w")).otherwise(0.0))
        either = F.sum(F.when((F.col(a) == 1) | (F.col(b) == 1), F.col("w")).otherwise(0.0))
        return F.round(F.when((F.max(a) == 0) | (F.max(b) == 0), F.lit(0.0)).otherwise(both / either), OVERLAP_PLACES)

    return weighed.groupBy("query_id").agg(overlap("query", "gold").alias("query_gold_overlap"), overlap("top", "gold").alias("competitor_gold_overlap"), F.sum("query").cast("int").alias("query_token_count"))


def collect_evidence(run: DataFrame, qrels: DataFrame, corpus: DataFrame, queries: DataFrame, before: DataFrame | None = None, idf: DataFrame | None = None) -> DataFrame:
    """One row for each judged query that has a ranking. before: (query_id, before_rank), where a reranker was; idf: as `overlaps` takes it.

    A gold document that scored 0 was padding: the symptom is a miss, though its rank
    stays. Where no gold was retrieved, texts are compared with the highest-graded one.
    """
    gold = relevant()
    rows = labelled(run, qrels).withColumn("hit", gold)
    first = lambda c: F.min_by(c, F.when(F.col("hit"), F.col("rank")))
    facts = rows.groupBy("query_id").agg(
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("gold_rank"),
        first("doc_id").alias("best_relevant"),
        first("score").alias("gold_score"),
        F.min_by("doc_id", "rank").alias("top1"),
        F.min_by("hit", "rank").alias("top1_is_relevant"),
        F.min_by("score", "rank").alias("top_score"),
        F.count_if(F.col("score") == 0).cast("int").alias("retrieved_with_zero_score"),
    )
    facts = materialise(facts.join(reference_gold(qrels), "query_id").withColumn("gold_doc", F.coalesce("best_relevant", "reference_gold")), "facts")
    zero = F.coalesce(F.col("gold_score") == 0, F.lit(False))
    margin = F.col("top_score") - F.col("gold_score")
    # Texts stay where they lie; the few ids of documents that are asked for go to them.
    both = F.array(*[F.struct(F.lit(name).alias("side"), F.col(key).alias("doc_id")) for name, key in (("gold", "gold_doc"), ("top", "top1"))])
    named = broadcast_if_small(materialise(facts.select("query_id", F.inline(both)).filter("doc_id is not null"), "sides"))
    texts = corpus.join(named, "doc_id").select("query_id", "side", "text")
    asked = facts.select("query_id").join(queries, "query_id").select("query_id", F.lit("query").alias("side"), "text")
    words = overlaps(asked.unionByName(texts), corpus, idf)
    earlier = facts.select("query_id", F.lit(None).cast("int").alias("rank_before_rerank")) if before is None else before.select("query_id", F.col("before_rank").cast("int").alias("rank_before_rerank"))
    return (
        facts.join(words, "query_id", "left")
        .join(earlier, "query_id", "left")
        .select(
            "query_id",
            F.when(F.col("gold_rank").isNull() | zero, "miss").when(F.col("gold_rank") == 1, "ok").otherwise("rank").alias("symptom"),
            "gold_rank",
            "best_relevant",
            "top1",
            "top1_is_relevant",
            margin.alias("score_margin"),
            F.coalesce("query_gold_overlap", F.lit(0.0)).alias("query_gold_overlap"),
            F.when(F.col("top1_is_relevant"), F.lit(0.0)).otherwise(F.coalesce("competitor_gold_overlap", F.lit(0.0))).alias("competitor_gold_overlap"),
            F.coalesce("query_token_count", F.lit(0)).alias("query_token_count"),
            (~F.col("top1_is_relevant") & F.coalesce(margin == 0, F.lit(False))).alias("tied_with_top1"),
            zero.alias("gold_score_is_zero"),
            "retrieved_with_zero_score",
            "rank_before_rerank",
        )
    )


def nearest_ranks(values: DataFrame) -> DataFrame:
    """(name, value): of each name's values (name, value, fraction) the one at the nearest rank (half to even) of its fraction.

    A selection by digits: of the values as whole numbers, rounded to `OVERLAP_PLACES`, each round counts
    those that share the digits found so far by their next `DIGIT` bits, and goes on with the one
    digit that holds the rank. No round sorts or gathers more than 2 ** `DIGIT` counts of a name.
    """
    rows = values.select("name", "value", F.round(F.col("value") * 10**OVERLAP_PLACES).cast("long").alias("_v"))
    place = F.bround(F.first("fraction") * (F.count(F.lit(1)) - 1)).cast("long")
    found = values.groupBy("name").agg(place.alias("_place")).withColumn("_digits", F.lit(0).cast("long"))
    for low in range(DIGITS - DIGIT, -1, -DIGIT):
        digits = F.shiftright("_v", low)
        here = rows.withColumn("_digits", F.shiftright("_v", low + DIGIT)).join(F.broadcast(found), ["name", "_digits"])
        counts = here.groupBy("name", "_place", digits.alias("_digits")).agg(F.count(F.lit(1)).alias("_n"), F.max("value").alias("value"))
        before = F.sum("_n").over(Window.partitionBy("name").orderBy("_digits")) - F.col("_n")
        counts = counts.withColumn("_before", before).filter((F.col("_before") <= F.col("_place")) & (F.col("_place") < F.col("_before") + F.col("_n")))
        found = counts.select("name", "_digits", (F.col("_place") - F.col("_before")).alias("_place"), *(["value"] if low == 0 else []))
    return found.select("name", "value")


def calibrate(evidence: DataFrame) -> DataFrame:
    """One row: n, sufficient, and the overlaps that are low and high for this dataset; 0 where nothing says so."""
    side = lambda name, value, fraction: F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(fraction).alias("fraction"))
    both = F.array(side("low", F.col("query_gold_overlap"), LOW_QUANTILE), side("high", F.when(F.col("symptom") == "rank", F.col("competitor_gold_overlap")), HIGH_QUANTILE))
    ranks = nearest_ranks(evidence.select(F.explode(both).alias("x")).select("x.*").filter("value is not null"))
    of = lambda name: F.coalesce(F.max(F.when(F.col("name") == name, F.col("value"))), F.lit(0.0))
    enough = evidence.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) >= MIN_QUERIES).alias("sufficient"))
    return enough.crossJoin(F.broadcast(ranks.agg(of("low").alias("low_query_gold_overlap"), of("high").alias("high_competitor_gold_overlap"))))


def interpret(evidence: DataFrame, calibration: DataFrame) -> DataFrame:
    """(query_id, kind, confidence, producer, because, place) of each failing query; place is the order of its causes."""
    rows = evidence.filter("symptom <> 'ok'").crossJoin(F.broadcast(calibration))
    percent = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    demoted = F.col("rank_before_rerank").isNotNull() & (F.col("gold_rank").isNull() | (F.col("gold_rank") > F.col("rank_before_rerank")))
    enough, tied = F.col("sufficient"), F.col("tied_with_top1")
    hard = enough & (F.col("symptom") == "rank") & (F.col("competitor_gold_overlap") >= F.col("high_competitor_gold_overlap"))
    lexical = enough & (F.col("query_gold_overlap") <= F.col("low_query_gold_overlap"))
    unexplained = ~enough | ~(demoted | tied | hard | lexical)
    landed = F.when(F.col("gold_rank").isNull(), "out of the results").otherwise(F.format_string("to rank %d", F.col("gold_rank")))
    rules = [
        (demoted, "rerank_regression", 1.0, F.concat(F.format_string("the reranker moved the gold document from rank %d ", F.col("rank_before_rerank")), landed)),
        (tied, "score_tie", 0.9, F.lit("the gold document scored the same as the first one; the tie-break alone orders them")),
        (hard, "hard_negative", 0.5, F.concat(F.lit("the first document '"), "top1", F.lit("' shares "), percent("competitor_gold_overlap"), F.lit(" of its weighted words with the gold document; rank failures here reach "), percent("high_competitor_gold_overlap"), F.lit(" in their top quarter"))),
        (lexical, "lexical_mismatch", 0.4, F.concat(F.lit("query and gold document share "), percent("query_gold_overlap"), F.lit(" of their weighted words; the bottom quarter here ends at "), percent("low_query_gold_overlap"))),
        (unexplained, "unexplained", 0.0, F.when(~enough, F.format_string("%d judged queries are too few to say what is normal here", F.col("n"))).otherwise(F.concat(F.lit("symptom "), "symptom", F.lit(" and no rule holds")))),
    ]
    fired = F.array(*[F.when(rule, F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit("rule").alias("producer"), because.alias("because"), F.lit(i).alias("place"))) for i, (rule, kind, confidence, because) in enumerate(rules)])
    return rows.select("query_id", F.explode(F.filter(fired, lambda x: x.isNotNull())).alias("h")).select("query_id", "h.*")


@dataclass(frozen=True)
class Diagnosis:
    evidence: DataFrame
    hypotheses: DataFrame
    calibration: DataFrame

    def failing(self) -> DataFrame:
        return self.evidence.filter("symptom <> 'ok'")


def diagnose(run: DataFrame, qrels: DataFrame, corpus: DataFrame, queries: DataFrame, before: DataFrame | None = None) -> Diagnosis:
    """Evidence is written once: thresholds are compared with the very numbers that they were drawn from."""
    evidence = materialise(collect_evidence(run, qrels, corpus, queries, before), "evidence")
    calibration = materialise(calibrate(evidence), "calibration")
    return Diagnosis(evidence, interpret(evidence, calibration), calibration)


def failure_sets(diagnosis: Diagnosis) -> DataFrame:
    """(kind, queries): failing queries of each cause, in order of their ids."""
    return diagnosis.hypotheses.groupBy("kind").agg(F.sort_array(F.collect_set("query_id")).alias("queries"))


def symptom_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("symptom").agg(F.count(F.lit(1)).alias("n"))


def cause_counts(hypotheses: DataFrame) -> DataFrame:
    return hypotheses.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")
