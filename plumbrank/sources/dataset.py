"""Datasets: three JSON-lines files, checked as DataFrames."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import titled
from ..operators.ranking import judged
from . import files
from .fingerprint import frame_fingerprint


class DatasetError(ValueError):
    pass


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dangling(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known, key, "left_anti")


@dataclass(frozen=True)
class Dataset:
    name: str
    path: str
    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame

    def corpus_fingerprint(self) -> str:
        """Hangs on documents alone: new labels leave it as it is."""
        return frame_fingerprint(self.corpus)

    def labels_fingerprint(self) -> str:
        return frame_fingerprint(self.queries, self.qrels)

    def judged_queries(self) -> DataFrame:
        return judged(self.qrels)

    def summary(self) -> tuple[int, int]:
        """Documents, judged queries."""
        return self.corpus.count(), self.judged_queries().count()


def read_jsonl(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Rows of a JSON-lines file with `_line`, the 1-based line number. fields: name to kind, `string` or `int?` (default 1).

    A folder of parts counts as the file that its parts make up in order of their names. Blank lines are
    skipped, and the first line that is no object or lacks a field is an error that names it.
    """
    if not (files.is_file(path) or files.is_dir(path)):
        raise DatasetError(f"{path}: no such file")
    # A task reads whole splits: a line's place is that in its split, and the lines of all splits before.
    split = (F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    lines = spark.read.text(path).select("value", *split, F.monotonically_increasing_id().alias("_id"))
    sizes = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.join(F.broadcast(sizes.withColumn("_before", before).drop("_n")), ["_file", "_block"])
    number = F.col("_before") + F.col("_id") - F.col("_first") + 1
    rows = lines.withColumn("_line", number.cast("long")).filter(F.trim("value") != "")
    rows = rows.withColumn("_v", F.try_parse_json("value"))
    bad = F.when(F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT"), F.lit("is not a JSON object"))
    columns = []
    for name, kind in fields.items():
        got = F.try_variant_get("_v", f"$.{name}", "string")
        kind_of = F.schema_of_variant(F.expr(f"try_variant_get(_v, '$.{name}', 'variant')"))
        if kind == "string":
            bad = F.coalesce(bad, F.when(got.isNull() | (got == "") | (F.coalesce(kind_of, F.lit("")) != "STRING"), F.lit(f"needs a non-empty string `{name}`")))
            columns.append(got.alias(name))
        else:
            given = F.expr(f"try_variant_get(_v, '$.{name}', 'variant')")
            bad = F.coalesce(bad, F.when(given.isNotNull() & (F.coalesce(kind_of, F.lit("")) != "BIGINT"), F.lit(f"`{name}` must be an integer")))
            columns.append(F.coalesce(F.try_variant_get("_v", f"$.{name}", "int"), F.lit(1)).alias(name))
    checked = rows.withColumn("_bad", bad)
    worst = checked.filter("_bad is not null").orderBy("_line").select("_line", "_bad").first()
    if worst:
        raise DatasetError(f"{path}:{worst._line}: {worst._bad}")
    return rows.select(*columns, "_line")


def load_dataset(spark: SparkSession, directory: str, name: str | None = None) -> Dataset:
    """corpus.jsonl, queries.jsonl and qrels.jsonl of a directory; the last of several labels for a pair wins."""
    at = lambda x: os.path.join(directory, x)
    corpus = read_jsonl(spark, at("corpus.jsonl"), {"doc_id": "string", "text": "string"})
    queries = read_jsonl(spark, at("queries.jsonl"), {"query_id": "string", "text": "string"})
    qrels = read_jsonl(spark, at("qrels.jsonl"), {"query_id": "string", "doc_id": "string", "relevance": "int?"})
    if corpus.isEmpty():
        raise DatasetError(f"{at('corpus.jsonl')}: the corpus is empty")
    for rows, key, file in ((corpus, "doc_id", "corpus.jsonl"), (queries, "query_id", "queries.jsonl")):
        twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("_line").alias("_line")).filter("n > 1").orderBy("_line").first()
        if twice:
            raise DatasetError(f"{at(file)}:{twice._line}: duplicate {key} {twice[key]!r}")
    for known, key in ((queries, "query_id"), (corpus, "doc_id")):
        lost = dangling(qrels, known.select(key), key).orderBy("_line").first()
        if lost:
            raise DatasetError(f"{at('qrels.jsonl')}:{lost._line}: unknown {key} {lost[key]!r}")
    last = qrels.groupBy("query_id", "doc_id").agg(F.max_by("relevance", "_line").alias("relevance"))
    return Dataset(name or os.path.basename(os.path.normpath(directory)), directory, corpus.drop("_line"), queries.drop("_line"), last)


def export_dataset(docs: DataFrame, queries: DataFrame, qrels: DataFrame, directory: str, source: str, with_title: bool = True) -> dict:
    """Write tables as a dataset directory, as `load_dataset` reads it; documents may have a `title`. Empty texts are left out, with their labels.

    Executors write parts, each with a range of the ids; `source.json` lists them with their lines and where each
    begins in the file that they make up, so joining them is a copy in order of their names.
    """
    body = titled(F.col("title"), F.col("text")) if with_title and "title" in docs.columns else F.trim("text")
    docs = docs.select("doc_id", body.alias("text")).filter("length(text) > 0")
    queries = queries.select("query_id", F.trim("text").alias("text")).filter("length(text) > 0")
    qrels = qrels.select("query_id", "doc_id", "relevance").join(docs, "doc_id", "left_semi").join(queries, "query_id", "left_semi").select("query_id", "doc_id", "relevance")
    counts, parts = {}, {}
    for file, rows in (("corpus", docs), ("queries", queries), ("qrels", qrels)):
        path = f"{directory}/{file}.jsonl"
        rows.orderBy(*rows.columns[:2]).select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)
        written = docs.sparkSession.read.text(path).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"))
        parts[file], at = [], 0
        for part in written.orderBy("name").collect():
            parts[file].append({"name": part["name"], "lines": part["lines"], "at": at})
            at += part["bytes"]
        counts[file] = sum(x["lines"] for x in parts[file])
    about = {"dataset": source, "title_concatenated": with_title, "counts": counts, "parts": parts}
    files.write(f"{directory}/source.json", json.dumps(about, indent=2).encode())
    return about
