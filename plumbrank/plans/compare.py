"""Comparing two outcomes: may they be compared, what moved, and is it real."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff, significance
from ..session import materialise
from ..sources.dataset import Dataset
from ..sources.fingerprint import fingerprint
from .manifest import source_changed
from .pipeline import COMPARED_STAGES, RunOutcome
from .trust import Trust, Verdict, assess


@dataclass(frozen=True)
class Comparison:
    comparison_id: str
    left: RunOutcome
    right: RunOutcome
    verdict: Verdict
    significance: DataFrame
    deltas: DataFrame

    def headline(self) -> str:
        return diff.headline(diff.diff_counts(self.deltas).first().asDict())


def compare(left: RunOutcome, right: RunOutcome, dataset: Dataset, seed: int = significance.SEED, resamples: int = significance.RESAMPLES) -> Comparison:
    """Runs that do not cover the same queries, or that the trust gate calls incomparable, are refused."""
    commit = lambda o, s: (p := o.manifest.step(s)) and p["commit"]
    changed = {s: source_changed(commit(left, s), commit(right, s), s) for s in COMPARED_STAGES}
    verdict = assess(left.manifest, right.manifest, COMPARED_STAGES, changed)
    shared = [x for x in left.measures if x in right.measures]
    pick = lambda o: o.metrics.filter(F.col("measure").isin(*shared))
    rows = materialise(significance.compare_measures(pick(left), pick(right), seed, resamples), "significance")
    if verdict.level == Trust.INCOMPARABLE:
        raise ValueError("the runs cannot be compared: " + "; ".join(verdict.reasons))
    deltas = materialise(diff.compare_runs(left.run, right.run, dataset.qrels, left.diagnosis.evidence, right.diagnosis.evidence), "deltas")
    a, b, data = left.run_id, right.run_id, left.manifest["data"]
    what = fingerprint({"left": a, "right": b, "labels": data["labels"], "corpus": data["corpus"], "seed": seed, "resamples": resamples})
    return Comparison(f"{left.name}-vs-{right.name}-{what[3:11]}", left, right, verdict, rows, deltas)
