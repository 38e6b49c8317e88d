"""The published tree: run and comparison bundles, and an index of them."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..operators.diff import diff_counts
from ..plans.manifest import LAYOUT_VERSION
from .run_io import read_json, write_json, write_table
from . import files
from .store import Store


class Workspace:
    def __init__(self, root: str):
        self.root = root
        self.cache = Store(os.path.join(root, "cache"))
        self.bundles = Store(root)

    def runs(self) -> list[str]:
        return self.bundles.keys("run")

    def comparisons(self) -> list[str]:
        return self.bundles.keys("comparison")

    def catalog(self, spark: SparkSession) -> DataFrame:
        rows = [("run", x) for x in self.runs()] + [("comparison", x) for x in self.comparisons()]
        return spark.createDataFrame(rows, "kind string, id string")

    def write_index(self) -> None:
        files.make_dir(self.root)
        write_json(os.path.join(self.root, "index.json"), {"layout_version": LAYOUT_VERSION, "runs": self.runs(), "comparisons": self.comparisons()})

    def write_run(self, outcome: Any) -> str:
        """manifest.json and four tables; published whole. One with the same id is there until the new one is."""
        calibration = outcome.diagnosis.calibration.first()
        about = {
            "layout_version": LAYOUT_VERSION,
            "manifest": outcome.manifest.parts,
            "dataset": {"name": outcome.dataset.name, "path": outcome.dataset.path},
            "measures": list(outcome.measures),
            "calibration": calibration.asDict(),
        }
        with self.bundles.reserve("run", outcome.run_id, replace=True) as at:
            tables = {
                "run": (outcome.run, schemas.RUN, ("query_id", "rank")),
                "metrics": (outcome.metrics, schemas.METRICS, ("query_id", "measure")),
                "evidence": (outcome.diagnosis.evidence, schemas.EVIDENCE, ("query_id",)),
                "hypotheses": (outcome.diagnosis.hypotheses, schemas.HYPOTHESES, ("query_id", "kind")),
            }
            for name, (df, schema, order) in tables.items():
                write_table(df, os.path.join(at, f"{name}.parquet"), schema, *order)
            write_json(os.path.join(at, "manifest.json"), about)
        self.write_index()
        return self.bundles.path("run", outcome.run_id)

    def write_comparison(self, comparison: Any) -> str:
        """manifest.json and deltas; the runs are named, never copied."""
        side = lambda o: {"run_id": o.run_id, "name": o.name}
        keep = ("delta", "ci_low", "ci_high", "p_value", "n", "resamples", "seed", "alpha", "confidence", "is_real", "underpowered")
        about = {
            "layout_version": LAYOUT_VERSION,
            "left": side(comparison.left),
            "right": side(comparison.right),
            "trust": {"level": comparison.verdict.level.name.lower(), "reasons": list(comparison.verdict.reasons)},
            "significance": {r.measure: {x: r[x] for x in keep} for r in comparison.significance.collect()},
            "counts": diff_counts(comparison.deltas).first().asDict(),
        }
        with self.bundles.reserve("comparison", comparison.comparison_id, replace=True) as at:
            write_table(comparison.deltas, os.path.join(at, "deltas.parquet"), schemas.DELTAS, "query_id")
            write_json(os.path.join(at, "manifest.json"), about)
        self.write_index()
        return self.bundles.path("comparison", comparison.comparison_id)

    def _manifest(self, kind: str, name: str) -> dict[str, Any]:
        if not self.bundles.has(kind, name):
            raise ValueError(f"no {kind} {name!r} in {self.root}")
        path = os.path.join(self.bundles.path(kind, name), "manifest.json")
        found = read_json(path)
        if found.get("layout_version") != LAYOUT_VERSION:
            raise ValueError(f"{path}: layout version {found.get('layout_version')}, not {LAYOUT_VERSION}")
        return found

    def read_run_manifest(self, run_id: str) -> dict[str, Any]:
        return self._manifest("run", run_id)

    def read_comparison_manifest(self, comparison_id: str) -> dict[str, Any]:
        return self._manifest("comparison", comparison_id)

    def table(self, spark: SparkSession, run_id: str, name: str) -> DataFrame:
        """A table of a run bundle: run, metrics, evidence or hypotheses."""
        self.read_run_manifest(run_id)
        return spark.read.schema(getattr(schemas, name.upper())).parquet(os.path.join(self.bundles.path("run", run_id), f"{name}.parquet"))

    def deltas(self, spark: SparkSession, comparison_id: str) -> DataFrame:
        self.read_comparison_manifest(comparison_id)
        return spark.read.schema(schemas.DELTAS).parquet(os.path.join(self.bundles.path("comparison", comparison_id), "deltas.parquet"))
