"""Ranking measures per judged query. The stored order is the order that is measured."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import judged, labelled, relevant

DEFAULT_MEASURES = ("nDCG@10", "RR", "R@10")
#: Names, and whether a cut-off is needed, possible or neither.
KNOWN = {"nDCG": False, "R": True, "RR": False, "P": True, "AP": False, "Success": True, "ERR": False, "RBP": False, "Judged": True, "Bpref": None, "Rprec": None, "SetP": None, "SetR": None, "SetF": None}
# The persistence of RBP, and the highest grade that ERR knows.
PERSISTENCE, HIGHEST = 0.8, 4
#: Places of an ideal ranking that are summed at once: a bound on memory.
PLACES = 4096
_NAME = re.compile(r"([A-Za-z]+)(?:@([1-9][0-9]*))?")


def parse_measure(name: str) -> tuple[str, int | None]:
    m = _NAME.fullmatch(name)
    if not m or m[1] not in KNOWN or (KNOWN[m[1]] and m[2] is None) or (KNOWN[m[1]] is None and m[2]):
        raise ValueError(f"unknown measure {name!r}; known: {', '.join(x + {True: '@k', False: '[@k]', None: ''}[cut] for x, cut in KNOWN.items())}")
    return m[1], int(m[2]) if m[2] else None


def _value(kind: str, k: int | None) -> Column:
    """Over one query's rows: rank, gain (grade or 0), hit and known (0 or 1), seen and bad (hits and judged misses so far), left (log of the chance that ERR's reader comes here), and the query's n_relevant, n_bad, grades (grade, n) from the highest on, and `whole`, the gain of all of them."""
    within = F.lit(True) if k is None else F.coalesce(F.col("rank") <= k, F.lit(False))
    hits = F.sum(F.when(within, F.col("hit")).otherwise(0)).cast("double")
    n_relevant = F.first("n_relevant").cast("double")
    if kind == "nDCG":
        gain = F.sum(F.when(within, F.col("gain") / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0))
        return gain / (F.first("whole") if k is None else best_gain(F.first("grades"), k))
    if kind == "RR":
        return F.coalesce(1.0 / F.min(F.when(within & (F.col("hit") == 1), F.col("rank"))), F.lit(0.0))
    if kind == "P":
        return hits / k
    if kind == "R":
        return hits / n_relevant
    if kind == "AP":
        return F.sum(F.when(within & (F.col("hit") == 1), F.col("seen") / F.col("rank")).otherwise(0.0)) / n_relevant
    if kind == "ERR":
        return F.sum(F.when(within, _stops() * F.exp("left") / F.col("rank")).otherwise(0.0))
    if kind == "RBP":
        return F.sum(F.when(within, F.col("hit") * F.pow(F.lit(PERSISTENCE), F.col("rank") - 1)).otherwise(0.0)) * (1 - PERSISTENCE)
    if kind == "Judged":
        return F.sum(F.when(within, F.col("known")).otherwise(0)).cast("double") / k
    if kind == "Bpref":
        of = F.least(F.col("n_relevant"), F.col("n_bad"))
        return F.sum(F.when(F.col("hit") == 1, F.when(F.col("bad") > 0, 1 - F.least("bad", "n_relevant") / of).otherwise(1.0)).otherwise(0.0)) / n_relevant
    if kind == "Rprec":
        return F.sum(F.when(F.col("rank") <= F.col("n_relevant"), F.col("hit")).otherwise(0)).cast("double") / n_relevant
    retrieved = F.count("rank").cast("double")
    if kind == "SetP":
        return F.coalesce(F.try_divide(hits, retrieved), F.lit(0.0))
    if kind == "SetR":
        return hits / n_relevant
    if kind == "SetF":
        return 2 * hits / (retrieved + n_relevant)
    return (hits > 0).cast("double")


def best_gain(grades: Column, k: int | None = None) -> Column:
    """Gain of the ideal ranking, cut at k, from structs (grade, n) in falling order: its places are summed one by one and never held, however many a grade has."""

    def add(found: Column, g: Column) -> Column:
        end = found["at"] + g["n"] if k is None else F.least(found["at"] + g["n"], F.lit(k).cast("long"))
        span = lambda low, high, step: F.when(high >= low, F.sequence(low, high, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        part = lambda s, low: F.aggregate(span(low, F.least(low + (PLACES - 1), end), 1), s, lambda x, i: x + g["grade"] / F.log2(i + F.lit(1.0)))
        return F.struct((found["at"] + g["n"]).alias("at"), F.aggregate(span(found["at"] + 1, end, PLACES), found["sum"], part).alias("sum"))

    return F.aggregate(grades, F.struct(F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("sum")), add, lambda x: x["sum"])


def grades_of(qrels: DataFrame) -> DataFrame:
    """(query_id, relevance, n)"""
    return qrels.groupBy("query_id", "relevance").agg(F.count(F.lit(1)).alias("n"))


def _stops() -> Column:
    return (F.pow(F.lit(2.0), F.least("gain", F.lit(float(HIGHEST)))) - 1) / 2.0**HIGHEST


def evaluate(run: DataFrame, qrels: DataFrame, measures: tuple[str, ...] = DEFAULT_MEASURES, grades: DataFrame | None = None) -> DataFrame:
    """(query_id, measure, value) for each judged query; one that the run lacks has 0 everywhere.

    nDCG takes grades as linear gains and its ideal from all positive labels; R
    divides by all relevant documents; RR looks at the whole run unless cut. Bpref knows only
    judged documents; Judged counts them; ERR and RBP are of a reader who stops. grades: `grades_of` all labels, where
    that is known without them; qrels then need those of the run's documents alone.
    """
    wanted = [(name, *parse_measure(name)) for name in dict.fromkeys(measures)]
    grades = grades_of(qrels) if grades is None else grades
    some = F.when(F.col("relevance") > 0, F.struct(F.col("relevance").cast("double").alias("grade"), "n"))
    number = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    ideal = grades.groupBy("query_id").agg(number(F.col("relevance") > 0).alias("n_relevant"), number(F.col("relevance") <= 0).alias("n_bad"), F.sort_array(F.collect_list(some), asc=False).alias("grades")).filter("n_relevant > 0")
    if ("nDCG", None) in (x[1:] for x in wanted):  # once for all queries whose labels have the same numbers of grades
        ideal = ideal.join(ideal.select("grades").distinct().withColumn("whole", best_gain(F.col("grades"))), "grades")
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = labelled(run, qrels, grades).select("query_id", "rank", F.greatest(F.coalesce("relevance", F.lit(0)), F.lit(0)).cast("double").alias("gain"), relevant().cast("int").alias("hit"), F.col("relevance").isNotNull().cast("int").alias("known"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"seen": F.sum("hit").over(order), "bad": F.sum(F.col("known") - F.col("hit")).over(order), "left": F.coalesce(F.sum(F.log(1 - _stops())).over(before), F.lit(0.0))})
    wide = ideal.join(rows, "query_id", "left").na.fill({"hit": 0, "gain": 0.0, "known": 0, "left": 0.0}).groupBy("query_id").agg(*[_value(kind, k).alias(f"_{i}") for i, (_, kind, k) in enumerate(wanted)])
    pairs = F.array(*[F.struct(F.lit(name).alias("measure"), F.col(f"_{i}").alias("value")) for i, (name, _, _) in enumerate(wanted)])
    return wide.select("query_id", F.explode(pairs).alias("m")).select("query_id", "m.measure", "m.value")


def aggregate(metrics: DataFrame) -> DataFrame:
    """(measure, value): the mean over judged queries."""
    return metrics.groupBy("measure").agg(F.avg("value").alias("value"))


def judged_run(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return run.join(judged(qrels), "query_id", "left_semi")
