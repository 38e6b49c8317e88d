"""Paired significance: bootstrap interval and sign-flip test of each measure."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, shuffle_partitions

RESAMPLES, SEED, CONFIDENCE, ALPHA = 10_000, 20261004, 0.95, 0.05
#: Fewer queries than this decide nothing.
ENOUGH = 50
#: Numbers drawn at once: a bound on memory that leaves the stream of draws as it is.
DRAWS = 4_000_000


class NotPairedError(ValueError):
    """Two runs were scored on different queries."""


def pairing(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: n_shared, n_left_only, n_right_only query and measure pairs."""
    both = left.select("query_id", "measure", F.lit(1).alias("l")).join(right.select("query_id", "measure", F.lit(1).alias("r")), ["query_id", "measure"], "full_outer")
    return both.agg(F.count_if(F.expr("l is not null and r is not null")).alias("n_shared"), F.count_if(F.expr("r is null")).alias("n_left_only"), F.count_if(F.expr("l is null")).alias("n_right_only"))


def check_paired(left: DataFrame, right: DataFrame) -> None:
    found = pairing(left, right).first()
    if not found.n_shared:
        raise NotPairedError("the runs have no query in common, so nothing can be paired")
    if found.n_left_only or found.n_right_only:
        raise NotPairedError(f"the runs cover different queries: {found.n_left_only} on the left alone, {found.n_right_only} on the right alone")


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """(query_id, measure, left_value, right_value)."""
    value = lambda m, name: m.select("query_id", "measure", F.col("value").alias(name))
    return value(left, "left_value").join(value(right, "right_value"), ["query_id", "measure"])


def paired_delta(left: DataFrame, right: DataFrame) -> DataFrame:
    return paired(left, right).groupBy("measure").agg(F.count(F.lit(1)).alias("n"), F.avg("left_value").alias("left_mean"), F.avg("right_value").alias("right_mean"), F.avg(F.col("right_value") - F.col("left_value")).alias("delta"))


def resampled(difference: np.ndarray, seed: int, resamples: int, confidence: float) -> tuple[float, float, float]:
    """Interval and p-value of a mean difference. Draws come in blocks of rows from one generator: indices first, signs after."""
    n, draw = len(difference), np.random.default_rng(seed)
    rows = max(1, DRAWS // n)
    sizes = [min(rows, resamples - at) for at in range(0, resamples, rows)]
    means = np.concatenate([difference[draw.integers(0, n, size=(m, n))].mean(axis=1) for m in sizes])
    low, high = np.quantile(means, [(1 - confidence) / 2, 1 - (1 - confidence) / 2])
    observed, extreme = abs(float(difference.mean())), 0
    for m in sizes:
        extreme += int((np.abs((difference * draw.choice(np.array([-1.0, 1.0]), size=(m, n))).mean(axis=1)) >= observed).sum())
    return float(low), float(high), (extreme + 1) / (resamples + 1)


def words(seed: int, first: int, count: int) -> np.ndarray:
    """`count` 32-bit words of the generator's stream, from the word `first` on: it jumps there."""
    bits = np.random.PCG64(seed)
    bits.advance(first // 2)
    odd = first & 1
    return bits.random_raw((count + odd + 1) // 2).astype("<u8").view("<u4")[odd : odd + count]


def passed_over(found: np.ndarray, n: int) -> np.ndarray:
    """Which words the generator leaves unused when it draws below n, so that all numbers are equally likely."""
    return ((found.astype(np.uint64) * np.uint64(n)) & np.uint64(0xFFFFFFFF)) < ((1 << 32) - n) % n


@dataclass(frozen=True)
class Draws:
    """`resamples` rows of n numbers below n, and then as many signs, as one generator draws them in turn: any rows at once.

    skipped: places of the words that were left unused, in order; one in 2 ** 32 / n words at most is.
    """

    seed: int
    n: int
    resamples: int
    skipped: np.ndarray

    def _word(self, draw: int) -> int:
        return draw + int(np.searchsorted(self.skipped - np.arange(len(self.skipped)), draw, side="right"))

    @property
    def words(self) -> int:
        """Words that all numbers take. A number below 1 takes none."""
        return 0 if self.n == 1 else self._word(self.n * self.resamples - 1) + 1

    def indices(self, first: int, last: int) -> np.ndarray:
        if self.n == 1:
            return np.zeros((last - first, 1), np.int64)
        begin, end = self._word(first * self.n), self._word(last * self.n - 1) + 1
        found = words(self.seed, begin, end - begin)
        found = found[~passed_over(found, self.n)].astype(np.uint64)
        return ((found * np.uint64(self.n)) >> np.uint64(32)).astype(np.int64).reshape(-1, self.n)

    def signs(self, first: int, last: int) -> np.ndarray:
        found = words(self.seed, self.words + first * self.n, (last - first) * self.n)
        return np.where(found >> np.uint32(31), 1.0, -1.0).reshape(-1, self.n)


def draws(spark: SparkSession, n: int, seed: int, resamples: int) -> Draws:
    """All tasks look for unused words in shares of the stream."""
    wanted = n * resamples
    total = wanted + 1000 + 4 * (wanted * n >> 32)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                for first in range(at, min(at + step, total), DRAWS):
                    found = words(seed, first, min(DRAWS, at + step - first, total - first))
                    yield pa.RecordBatch.from_pydict({"place": pa.array(np.flatnonzero(passed_over(found, n)) + first)})

    tasks = shuffle_partitions(spark)
    step = max(DRAWS, -(-total // tasks))
    skipped = np.zeros(0, np.int64)
    if n > 1 and total <= DRAWS:
        skipped = np.flatnonzero(passed_over(words(seed, 0, total), n))
    elif n > 1:
        shares = spark.range(0, total, step, numPartitions=min(tasks, -(-total // step)))
        skipped = np.sort(shares.mapInArrow(look, "place long").toPandas()["place"].to_numpy())
    return Draws(seed, n, resamples, skipped[skipped - np.arange(len(skipped)) < wanted])


_SCHEMA = "measure string, n long, left_mean double, right_mean double, delta double, ci_low double, ci_high double, p_value double, resamples int, seed long, alpha double, confidence double"


def _judged(rows: DataFrame) -> DataFrame:
    excludes = (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    few = F.col("n") < ENOUGH
    return rows.withColumns({"interval_excludes_zero": excludes, "underpowered": few, "is_real": (F.col("p_value") < F.col("alpha")) & excludes & ~few})


def compare_measures(left: DataFrame, right: DataFrame, seed: int = SEED, resamples: int = RESAMPLES, confidence: float = CONFIDENCE, alpha: float = ALPHA) -> DataFrame:
    """A row for each measure, without correction for their number. Values are paired in order of query ids, as the draws depend on it.

    Runs that don't cover the same queries are refused. A measure's values are one row: their number is
    that of human labels, not of documents. Resamples of a measure are dealt over all tasks, each of which
    jumps to its place in the one stream of draws, so results don't hang on their number: they are those of `resampled`.
    """
    check_paired(left, right)
    spark = left.sparkSession
    values = paired(left, right).groupBy("measure").agg(F.array_sort(F.collect_list(F.struct("query_id", "left_value", "right_value"))).alias("v"))
    values = materialise(values.select("measure", F.size("v").alias("n"), F.col("v.left_value").alias("a"), F.col("v.right_value").alias("b")), "values")
    drawn = {r.n: draws(spark, r.n, seed, resamples) for r in values.select("n").distinct().collect()}
    tasks = max(1, min(shuffle_partitions(spark), resamples))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                difference = np.array(row["b"], float) - np.array(row["a"], float)
                of, first, last = drawn[row["n"]], row["share"] * resamples // tasks, (row["share"] + 1) * resamples // tasks
                step, observed = max(1, DRAWS // row["n"]), abs(float(difference.mean()))
                for lo in range(first, last, step):
                    hi = min(lo + step, last)
                    means = difference[of.indices(lo, hi)].mean(axis=1)
                    extreme = np.abs((difference * of.signs(lo, hi)).mean(axis=1)) >= observed
                    yield pa.RecordBatch.from_pydict({"measure": pa.array([row["measure"]] * len(means)), "mean": pa.array(means), "extreme": pa.array(extreme.astype(np.int64))})

    shares = values.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    resampled_ = shares.repartition(tasks, "measure", "share").mapInArrow(test, "measure string, mean double, extreme long")
    found = resampled_.groupBy("measure").agg(F.collect_list("mean").alias("means"), F.sum("extreme").alias("extreme"))

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                a, b = np.array(r.a, float), np.array(r.b, float)
                low, high = np.quantile(np.array(r.means), [(1 - confidence) / 2, 1 - (1 - confidence) / 2])
                out.append((r.measure, len(a), a.mean(), b.mean(), (b - a).mean(), low, high, (r.extreme + 1) / (resamples + 1), resamples, seed, alpha, confidence))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _SCHEMA.split(", ")])

    return _judged(values.join(found, "measure").mapInPandas(summary, _SCHEMA))


def hashed_significance(left: DataFrame, right: DataFrame, resamples: int = 200, seed: int = SEED, confidence: float = CONFIDENCE, alpha: float = ALPHA) -> DataFrame:
    """The same test in SQL alone: draws come from md5 of (seed, resample, place), so every engine makes the same."""
    check_paired(left, right)
    ordered = paired(left, right).withColumn("d", F.round(F.col("right_value") - F.col("left_value"), 9)).groupBy("measure").agg(F.array_sort(F.collect_list(F.struct("query_id", "d"))).alias("q"))
    values = ordered.select("measure", F.transform("q", lambda x: x["d"]).alias("d"), F.size("q").alias("n"))
    draws = values.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    drawn = lambda kind, i: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{kind}:"), F.col("b").cast("string"), F.lit(":"), i.cast("string"))), 1, 8), 16, 10).cast("long")
    places = F.sequence(F.lit(0), F.col("n") - 1)
    mean = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.col("n"), 9)
    draws = draws.select(
        "measure",
        "n",
        mean(F.col("d")).alias("delta"),
        mean(F.transform(places, lambda i: F.get("d", F.pmod(drawn("b", i), F.col("n")).cast("int")))).alias("boot"),
        mean(F.transform(places, lambda i: F.when(drawn("s", i) % 2 == 0, F.get("d", i)).otherwise(-F.get("d", i)))).alias("flip"),
    )
    tail = (1 - confidence) / 2
    found = draws.groupBy("measure", "n", "delta").agg(
        F.percentile("boot", F.lit(tail)).alias("ci_low"),
        F.percentile("boot", F.lit(1 - tail)).alias("ci_high"),
        ((F.count_if(F.abs("flip") >= F.abs("delta")) + 1) / F.lit(resamples + 1)).alias("p_value"),
        F.lit(alpha).alias("alpha"),
    )
    rows = _judged(found)
    return rows.select("measure", F.col("n").cast("long").alias("n"), "delta", F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high"), F.round("p_value", 9).alias("p_value"), "interval_excludes_zero", "underpowered", "is_real")


def real_differences(rows: DataFrame) -> DataFrame:
    return rows.filter("is_real").orderBy("measure")


def verdict_counts(rows: DataFrame) -> DataFrame:
    """One row: measures whose difference is real, is not, goes up, goes down."""
    return rows.agg(F.count_if(F.expr("is_real")).alias("n_real"), F.count_if(F.expr("not is_real")).alias("n_not_real"), F.count_if(F.expr("delta > 0")).alias("n_up"), F.count_if(F.expr("delta < 0")).alias("n_down"))


def describe(row) -> str:
    if row.delta == 0:
        return f"{row.measure}: no change"
    core = f"{row.measure}: {row.delta:+.4f} ({'better' if row.delta > 0 else 'worse'}), {row.confidence:.0%} CI [{row.ci_low:+.4f}, {row.ci_high:+.4f}], p={row.p_value:.3f}, n={row.n}"
    tail = f"undecided, {row.n} queries is too few to tell" if row.underpowered else "real" if row.is_real else "indistinguishable from noise"
    return f"{core}; {tail}"
