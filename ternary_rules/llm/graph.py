"""Connected components in Spark: alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _near(edges: DataFrame) -> DataFrame:
    """Each (u, v) with m, the least of u and its neighbours. A node with very many neighbours is a
    skewed key of this join, which adaptive execution splits."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
    return edges.join(least, edges["u"] == least["of"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _near(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _near(down)
    return near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.col("v"), F.lit(1_000_003)))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable. edges:
    two long columns u and v, in any direction, with any repeats; loops are ignored. Every round
    ends in a stored table, so a plan never grows and a lost executor repeats one round at most."""
    now = stored(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct())
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        new = stored(_small_star(_large_star(now)))
        discard(now)
        now, before = new, state
        state = _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
