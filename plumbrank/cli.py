"""Command line: run, list, show, label, score, demo, export."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import chunk, diagnose, diff, labelling, ranking, retrieve, significance
from .plans import compare, pipeline, tasks
from .plans.config import load_experiment
from .session import build_session
from .sources.dataset import DatasetError, export_dataset, load_dataset
from .sources.workspace import Workspace

COMPLAINTS = (ValueError, DatasetError, OSError)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    experiment = load_experiment(args.experiment)
    at = experiment.dataset if os.path.isabs(experiment.dataset) or os.path.isdir(experiment.dataset) else str(Path(args.experiment).parent / experiment.dataset)
    dataset, space, outcomes = load_dataset(spark, at), Workspace(args.root), {}
    print("{}: {} documents, {} judged queries".format(dataset.name, *dataset.summary()))
    for system in experiment.systems:
        chunking = system.chunking.build() if system.chunking else None
        if chunking:
            n = chunk.mean_chunks(chunking.cut(dataset.corpus)).first()
            print(f"{system.name}: {n.n_chunks} chunks, {n.mean_chunks or 0:.1f} a document")
        found = pipeline.execute(dataset, system.build(), k=experiment.k, measures=experiment.measures, chunking=chunking, reranker=system.build_reranker(), candidates=system.candidates, store=space.cache, name=system.name)
        space.write_run(found)
        outcomes[system.name] = found
        values = ", ".join(f"{r.measure} {r.value:.4f}" for r in found.summary().orderBy("measure").collect())
        print(f"{found.run_id}{' (ranking from cache)' if found.cached else ''}: {values}")
    base = outcomes[experiment.baseline_system().name]
    for system in experiment.others():
        other = compare.compare(base, outcomes[system.name], dataset)
        space.write_comparison(other)
        print(f"{other.comparison_id}: {other.headline()}, {other.verdict.level.name.lower()}")
        for r in other.significance.orderBy("measure").collect():
            print("  " + significance.describe(r))


def list_(spark: SparkSession, args: argparse.Namespace) -> None:
    space = Workspace(args.root)
    for name in space.runs():
        print(f"run {name} over {space.read_run_manifest(name)['dataset']['name']}")
    for name in space.comparisons():
        about = space.read_comparison_manifest(name)
        print(f"comparison {name} {diff.headline(about['counts'])}, {about['trust']['level']}")


def show(spark: SparkSession, args: argparse.Namespace) -> None:
    space = Workspace(args.root)
    about = space.read_run_manifest(args.run_id)
    print(f"{args.run_id} over {about['dataset']['name']}")
    for r in space.table(spark, args.run_id, "metrics").groupBy("measure").agg(F.avg("value").alias("v")).orderBy("measure").collect():
        print(f"  {r.measure} {r.v:.4f}")
    evidence = space.table(spark, args.run_id, "evidence")
    print(f"  failing {evidence.filter(chr(39).join(['symptom <> ', 'ok', ''])).count()} of {evidence.count()}")
    for r in diagnose.cause_counts(space.table(spark, args.run_id, "hypotheses")).collect():
        print(f"  {r.kind} {r.n}")


def label(spark: SparkSession, args: argparse.Namespace) -> None:
    space = Workspace(args.root)
    about = space.read_run_manifest(args.run_id)
    path = about.get("dataset", {}).get("path")
    if not path:
        raise ValueError(f"{args.run_id} does not say where its dataset is")
    dataset, evidence = load_dataset(spark, path), space.table(spark, args.run_id, "evidence")
    drawn = labelling.sample_failures(evidence, args.sample, args.seed)
    rows = labelling.cases(drawn, evidence, space.table(spark, args.run_id, "run"), dataset.queries, dataset.corpus, dataset.qrels)
    Path(args.out).write_text(labelling.render_sheet(rows, args.run_id, args.seed), encoding="utf-8")
    print(f"{drawn.count()} failures in {args.out}")


def score(spark: SparkSession, args: argparse.Namespace) -> None:
    space = Workspace(args.root)
    answers = labelling.parse_sheet(Path(args.sheet).read_text(encoding="utf-8"))
    labels = spark.createDataFrame(list(answers.items()), "query_id string, cause string")
    evidence, hypotheses = (space.table(spark, args.run_id, x) for x in ("evidence", "hypotheses"))
    r = labelling.agreement(labels, evidence, hypotheses).first()
    print(f"{r.labelled} labelled, {r.compared} compared, {r.agreed} agreed" + (f" ({r.accuracy:.0%})" if r.accuracy is not None else ""))
    for c in labelling.agreement_by_cause(labels, evidence, hypotheses).orderBy("cause").collect():
        print(f"  {c.cause}: said {c.said}, confirmed {c.confirmed}, missed {c.missed}" + (f", precision {c.precision:.0%}" if c.precision is not None else ""))


def demo(spark: SparkSession, args: argparse.Namespace) -> None:
    """BM25 against character TF-IDF: the health of each run, what moved, one movement in detail, what fails in both."""
    dataset = load_dataset(spark, args.directory)
    print("{}: {} documents, {} judged queries".format(dataset.name, *dataset.summary()))
    left, right = (pipeline.execute(dataset, retrieve.build(x)) for x in ("bm25", "tfidf"))
    for o in (left, right):
        print(f"\n{o.name}: " + ", ".join(f"{r.measure} {r.value:.4f}" for r in o.summary().orderBy("measure").collect()))
        for r in diagnose.symptom_counts(o.diagnosis.evidence).orderBy("symptom").collect():
            print(f"  {r.symptom} {r.n}")
        for r in diagnose.failure_sets(o.diagnosis).orderBy(-F.size("queries"), "kind").collect():
            print(f"  {r.kind}: {', '.join(r.queries)}")
    found = compare.compare(left, right, dataset)
    print(f"\nleft to right: {found.headline()}")
    for r in ranking.by_movement(found.deltas.filter("direction <> 'unchanged'")).collect():
        print(f"  {r.query_id}: {r.left_rank} to {r.right_rank}{' (arbitrary)' if r.arbitrary else ''}")
    for r in found.significance.orderBy("measure").collect():
        print("  " + significance.describe(r))
    opened = diff.demo_opener(found.deltas).first()
    query_id = opened.query_id if opened else dataset.judged_queries().orderBy("query_id").first().query_id
    e = left.diagnosis.evidence.filter(F.col("query_id") == query_id).first()
    print(f"\n{query_id}: {dataset.queries.filter(F.col('query_id') == query_id).first().text}")
    if e:
        print(f"  {e.symptom}, gold at {e.gold_rank or 'no rank'}, margin {e.score_margin}, tied {e.tied_with_top1}")
        print(f"  words shared by query and gold {e.query_gold_overlap:.1%}, by first and gold {e.competitor_gold_overlap:.1%}, {e.retrieved_with_zero_score} hits of score 0")
    for r in ranking.top(left.run.filter(F.col("query_id") == query_id)).orderBy("rank").collect():
        print(f"  {r.rank}. {r.doc_id} {r.score:.3f}")
    for h in left.diagnosis.hypotheses.filter(F.col("query_id") == query_id).orderBy("place").collect():
        print(f"  {h.kind} ({h.confidence}): {h.because}")
    both = [r.query_id for r in diff.fails_both(left.diagnosis, right.diagnosis).orderBy("query_id").collect()]
    print(f"\nfails in both: {', '.join(both) or 'none'}")


def export(spark: SparkSession, args: argparse.Namespace) -> None:
    """The known-item task of a folder of tables as a dataset directory."""
    task = tasks.known_item(spark, args.tables)
    print(export_dataset(task.corpus, task.queries, task.qrels, args.directory, args.tables, with_title=not args.no_title)["counts"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbrank", description=__doc__)
    p.add_argument("--root", default="runs")
    sub = p.add_subparsers(dest="verb", required=True)
    for name, f, arguments in (
        ("run", run, [("experiment",)]),
        ("list", list_, []),
        ("show", show, [("run_id",)]),
        ("label", label, [("run_id",), ("--out", {"required": True}), ("--sample", {"type": int, "default": labelling.SIZE}), ("--seed", {"type": int, "default": labelling.SEED})]),
        ("score", score, [("run_id",), ("sheet",)]),
        ("demo", demo, [("directory",)]),
        ("export", export, [("tables",), ("directory",), ("--no-title", {"action": "store_true"})]),
    ):
        s = sub.add_parser(name)
        s.set_defaults(f=f)
        for a in arguments:
            s.add_argument(a[0], **(a[1] if len(a) > 1 else {}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.f(spark or build_session("plumbrank"), args)
    except COMPLAINTS as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
