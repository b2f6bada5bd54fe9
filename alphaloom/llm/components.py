"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import forget, written


def _step(spark: SparkSession, edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """Link the neighbours of each node to the smallest of them (large: those above the node; small: those below); ``edges`` go."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # written, so that the join can split a hub's neighbours over several tasks
    low = written(spark, seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "low", rows)
    near = seen.join(low, "u")
    if large:
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    out = written(spark, out.where(F.col("u") != F.col("v")).distinct(), "edges", rows)
    forget(spark, low, edges)
    return out


def components(spark: SparkSession, edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Each node of ``edges`` with the smallest node that it can reach: columns node, component.

    Nodes may be of any ordered type. Loops and repeated edges are harmless, null ends are ignored,
    an empty edge list gives an empty result. No node's neighbours are gathered in one place: a step
    is a minimum per node and a join, so a hub is only a skewed join key. Every step is written to
    the shared folder, so a lost executor costs one step, and deletes what the step before wrote.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = written(spark, ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == mark or not state["n"]:
            break
        mark, n = state, state["n"]
        now = _step(spark, _step(spark, now, True, n), False, n)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
