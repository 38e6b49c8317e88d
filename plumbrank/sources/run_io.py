"""Runs and stage provenance on disk: Parquet tables and small JSON files."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import RUN
from ..session import shuffle_partitions
from . import files


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(x.name).cast(x.dataType) for x in schema])


def write_table(df: DataFrame, path: str, schema: T.StructType, *order: str) -> None:
    """Sorted Parquet files, each with a range of the order's first column, named in their order."""
    spread_out = conform(df, schema).repartitionByRange(shuffle_partitions(df.sparkSession), order[0])
    spread_out.sortWithinPartitions(*order).write.option("compression", "snappy").parquet(path)


def write_run(directory: str, run: DataFrame) -> None:
    """A query without hits leaves no trace. A query's hits are in one file, in order."""
    write_table(run, os.path.join(directory, "run.parquet"), RUN, "query_id", "rank")


def read_run(spark: SparkSession, directory: str) -> DataFrame:
    """The stored ranking, as it lies: `rank` is the order, and scores never decide it anew. Nothing is sorted again."""
    return spark.read.schema(RUN).parquet(os.path.join(directory, "run.parquet"))


def stored_rows(spark: SparkSession, directory: str) -> Iterator[Row]:
    """Hits in stored order, file by file: names of files are in order of their ranges."""
    for file in sorted(read_run(spark, directory).inputFiles(), key=lambda x: x.rsplit("/", 1)[-1]):
        yield from spark.read.schema(RUN).parquet(file).toLocalIterator()


def write_json(path: str, value: dict[str, Any]) -> None:
    files.write(path, (json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode())


def read_json(path: str) -> dict[str, Any]:
    value = json.loads(files.read(path).decode())
    if not isinstance(value, dict):
        raise ValueError(f"{path}: not a JSON object")
    return value


def write_stage_provenance(directory: str, provenance: Any) -> None:
    write_json(os.path.join(directory, "stage.json"), provenance.parts)


def read_stage_provenance(directory: str, expect_key: str | None = None) -> Any:
    """expect_key: the key under which the directory was found; another one inside, or more than one step, is refused."""
    from ..plans.manifest import STEP, Record

    found = Record.parse(read_json(os.path.join(directory, "stage.json")))
    if list(found.parts) != [STEP + x for x in found.steps()] or len(found.parts) != 1:
        raise ValueError(f"{directory}: not the record of one step")
    key = next(iter(found.parts.values()))["key"]
    if expect_key is not None and key != expect_key:
        raise ValueError(f"{directory}: holds {key}, not {expect_key}")
    return found
