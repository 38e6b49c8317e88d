"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise


#: Edges in a task and file, about: a table of few edges is not spread over many small files.
TASK_EDGES = 500_000


def _state(edges: DataFrame) -> tuple:
    """The number of edges and 128 bits of hash over all of them: what tells one round's table from the next."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node that has an edge, with the least node of its component.

    Rounds of large stars (a node's larger neighbours move to its least one) and
    small stars (its smaller ones do); the number of rounds grows with the logarithm
    of a component's breadth. Each step is two aggregations with a partial step ahead of the shuffle,
    so a hub is no hot key, and a round's result is a table in the shared folder, where it
    replaces that of the round before. No node or edge reaches the driver, only a hash of all.
    """
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    state = _state(now)
    while True:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        before, now = now, materialise(small.coalesce(1 + 2 * state[0] // TASK_EDGES), "edges")  # a round at most doubles them
        discard(before)
        state, old = _state(now), state
        if state == old:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
