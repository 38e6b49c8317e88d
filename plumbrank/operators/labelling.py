"""Asking people for causes: the sample, the sheet, and agreement with the rules."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..schemas import LABELLABLE
from ..session import materialise, shuffle_partitions
from .ranking import reference_gold, relevant, top

SIZE, SEED, TOP, SNIPPET = 50, 20261006, 5, 400


def sample_places(n: int, size: int = SIZE, seed: int = SEED) -> list[int]:
    """Places in a sorted list of n that Python's own generator draws."""
    return sorted(random.Random(seed).sample(range(n), size)) if size < n else list(range(n))


def sample_failures(evidence: DataFrame, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """(query_id) of a reproducible draw from the sorted ids of failing queries.

    The driver draws places and holds `size` numbers; an id's place is how many ids its range of them
    has ahead of it, and all ranges before.
    """
    spark = evidence.sparkSession
    ids = evidence.filter("symptom <> 'ok'").select("query_id").distinct().repartitionByRange(shuffle_partitions(spark), "query_id").sortWithinPartitions("query_id")
    own = F.monotonically_increasing_id()
    ranged = materialise(ids.select("query_id", F.shiftright(own, 33).alias("range"), own.bitwiseAND((1 << 33) - 1).alias("at")), "failing")
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    if size >= n:
        return ranged.select("query_id")
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(F.broadcast(sizes.select("range", before.alias("before"))), "range").select("query_id", (F.col("before") + F.col("at")).alias("place"))
    drawn = spark.createDataFrame([(x,) for x in sample_places(n, size, seed)], "place long")
    return placed.join(F.broadcast(drawn), "place").select("query_id")


def sample_failures_hashed(evidence: DataFrame, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """The same size by the least md5 of seed and id: nothing reaches the driver, and any SQL engine draws alike."""
    failing = evidence.filter("symptom <> 'ok'").select("query_id")
    return failing.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "query_id")), "query_id").limit(size)


def cases(drawn: DataFrame, evidence: DataFrame, run: DataFrame, queries: DataFrame, corpus: DataFrame, qrels: DataFrame, n: int = TOP, size: int = SNIPPET) -> DataFrame:
    """One row for each drawn query: its text, gold document, first `n` hits as structs, and overlaps."""
    rows = drawn.join(evidence, "query_id").join(reference_gold(qrels), "query_id").withColumn("gold_id", F.coalesce("best_relevant", "reference_gold"))
    rows = rows.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(corpus.select(F.col("doc_id").alias("gold_id"), snippet(F.col("text"), size).alias("gold_text")), "gold_id")
    hits = top(run, n).join(drawn, "query_id", "left_semi").join(corpus.select("doc_id", snippet(F.col("text"), size).alias("text")), "doc_id").join(qrels, ["query_id", "doc_id"], "left")
    hits = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text", relevant().alias("relevant")))).alias("retrieved"))
    return rows.join(hits, "query_id").select("query_id", "query", "symptom", "gold_rank", "gold_id", "gold_text", "retrieved", "query_gold_overlap", "competitor_gold_overlap")


def validate_label(cause: str) -> str:
    """The known cause that a person meant, whatever the case and whatever stands between its words."""
    for known in LABELLABLE:
        if re.fullmatch(r"\s*" + "[ _-]".join(known.split("_")) + r"\s*", cause, re.IGNORECASE):
            return known
    raise ValueError(f"unknown cause {cause!r}; known: {', '.join(LABELLABLE)}")


def render_sheet(rows: DataFrame, run_id: str, seed: int = SEED) -> str:
    """Markdown for a person to fill in; at most the sample's rows reach the driver. The rules' causes are left out, so as not to lead."""
    drawn = rows.orderBy("query_id").collect()
    out = [f"# {len(drawn)} failures to name", "", f"Run `{run_id}`, seed {seed}.", "", "After each `cause:` write one of " + ", ".join(f"`{x}`" for x in LABELLABLE) + "; blank skips the query.", ""]
    for r in drawn:
        where = "never retrieved" if r.gold_rank is None else f"ranked {r.gold_rank}"
        out += ["---", "", f"## {r.query_id}", "", "cause:", "", f"**Query** {r['query']}", "", f"**Gold document** ({where})", "", "> " + " ".join(r.gold_text.split()), "", "**Retrieved**", ""]
        out += [f"{h.rank}.{' **(gold)**' if h.relevant else ''} {' '.join(h.text.split())}" for h in r.retrieved] + [""]
    return "\n".join(out)


def parse_sheet(text: str) -> dict[str, str]:
    """Query id to cause. A cause ahead of any heading, or one that is unknown, is an error that names its line."""
    labels: dict[str, str] = {}
    query = None
    for number, line in enumerate((x.strip() for x in text.splitlines()), 1):
        if line.startswith("## "):
            query = line[3:].strip()
        elif line.startswith("cause:") and (answer := line[6:].strip().strip("`")):
            if query is None:
                raise ValueError(f"line {number}: a cause before any query")
            try:
                labels[query] = validate_label(answer)
            except ValueError as error:
                raise ValueError(f"line {number}: {error}") from None
    return labels


def compared(labels: DataFrame, evidence: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """(query_id, cause, proposed, hit): labels of failing queries beside the set of causes that the rules proposed."""
    proposed = hypotheses.groupBy("query_id").agg(F.collect_set("kind").alias("proposed"))
    rows = labels.join(evidence.filter("symptom <> 'ok'").select("query_id"), "query_id").join(proposed, "query_id", "left")
    rows = rows.withColumn("proposed", F.coalesce("proposed", F.array().cast("array<string>")))
    return rows.select("query_id", "cause", "proposed", F.array_contains("proposed", F.col("cause")).alias("hit"))


def agreement(labels: DataFrame, evidence: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """One row: labelled, compared, agreed, accuracy (null where nothing was compared)."""
    found = compared(labels, evidence, hypotheses).agg(F.count(F.lit(1)).alias("compared"), F.count_if("hit").alias("agreed"))
    return labels.agg(F.count(F.lit(1)).alias("labelled")).crossJoin(found).withColumn("accuracy", F.when(F.col("compared") > 0, F.col("agreed") / F.col("compared")))


def agreement_by_cause(labels: DataFrame, evidence: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """(cause, said, confirmed, missed, precision): how often rules said a cause, a person confirmed it, and a person named it unsaid."""
    rows = compared(labels, evidence, hypotheses)
    said = rows.select(F.explode("proposed").alias("kind"), "cause").groupBy("kind").agg(F.count(F.lit(1)).alias("said"), F.count_if(F.col("kind") == F.col("cause")).alias("confirmed"))
    missed = rows.filter("not hit").groupBy(F.col("cause").alias("kind")).agg(F.count(F.lit(1)).alias("missed"))
    both = said.join(missed, "kind", "full_outer").na.fill(0, ["said", "confirmed", "missed"])
    return both.select(F.col("kind").alias("cause"), "said", "confirmed", "missed", F.when(F.col("said") > 0, F.col("confirmed") / F.col("said")).alias("precision"))


def unlabelled(drawn: DataFrame, labels: DataFrame) -> DataFrame:
    return drawn.select("query_id").join(labels, "query_id", "left_anti")
