"""Session helpers: one place for the settings that every plan relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "plumbrank", cores: int | str = "*", memory: str = "20g") -> SparkSession:
    """A local session for tests, the CLI and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only where a session names none (a local test) is a folder of our own set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        named = f"file://{tempfile.mkdtemp(prefix='plumbrank-shared-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/plumbrank-{name}-{os.getpid()}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back.

    The files outlive the executors that wrote them, so a lost executor costs
    no recomputation of what stands before. rows: of a file, at most, where not 0.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that `materialise` made and nothing will read again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/plumbrank-" in path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a scan that has fewer partitions than there are cores; a larger one stays as it is, unshuffled."""
    cores = max(df.sparkSession.sparkContext.defaultParallelism, 1)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A hint for a table that has been counted and has at most so many short rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
