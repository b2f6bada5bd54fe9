"""Ranks within groups that one task can't hold: a date with millions of tickers.

Rows are dealt by ranges of (group, value, ties) and sorted within them, so the whole table is in one order and a
row's place in it is its partition's number of earlier rows, a prefix sum over partitions, plus its place in the
partition. The place less that of the group's first row is its rank. Tied values share the mean of their first and last
rank: a table of the values that occur twice or more is joined, which a common value enters once. No group is
ever in one task, not even one value of one group; what is broadcast is a row per partition.

``must_spread`` tells when that is needed. It looks at Spark's estimate of the size of what is read first and counts
groups only where that is large; smaller groups are ranked by one window, which costs one shuffle and no table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.sources.scratch import stored

#: Groups of tables below this size, or of no more rows, are sorted by one task without harm.
TASK_BYTES, GROUP_ROWS = 256 << 20, 1_000_000
_WITHIN = (1 << 33) - 1


def must_spread(df: DataFrame, by: list[str]) -> bool:
    """Is there a group in ``df`` that a window should not sort in one task?"""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    if sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())) <= TASK_BYTES:
        return False
    most = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) > GROUP_ROWS


def dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` by groups of ``by``, in as many tasks as shuffles have: small shuffles would be merged by their compressed size, a fraction of what a window sorts."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def spread_ranks(df: DataFrame, by: list[str], value: str, descending: bool = False, ties: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """``df`` with its ranks in groups of ``by`` from 1: _position (ties by columns ``ties``), _average (tied values share their mean rank) and _count (values of the group).

    Null values have no rank and do not count. ``tasks``: ranges, as many as shuffles have if not given.
    """
    spark = df.sparkSession
    order = [*(F.col(c) for c in by), F.col(value).isNull(), F.col(value).desc() if descending else F.col(value).asc()]
    # the rest of the row spreads equal values over several ranges
    order += [F.col(c) for c in ties] if ties else [F.xxhash64(*(c for c in df.columns))]
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    rows = stored(rows.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN))}), "ranges")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = F.broadcast(sizes.select("_part", earlier.alias("_base")))  # a row per range
    placed = rows.join(bases, "_part").withColumn("_place", F.col("_base") + F.col("_place")).drop("_part", "_base")

    groups = placed.groupBy(*by).agg(F.min("_place").alias("_first"), F.count(value).alias("_count"))
    tied = placed.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min("_place").alias("_low"), F.max("_place").alias("_high")).where("_low < _high")
    out = placed.alias("r").join(groups.alias("g"), [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by]).select("r.*", "_first", "_count")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by] + [F.col(f"r.{value}") == F.col(f"t.{value}")]
    out = out.alias("r").join(tied.alias("t"), same, "left").select("r.*", "_low", "_high")
    there = F.col(value).isNotNull()
    position = F.when(there, F.col("_place") - F.col("_first") + 1)
    average = F.when(F.col("_low").isNotNull(), (F.col("_low") + F.col("_high")) / 2.0 - F.col("_first") + 1).otherwise(position.cast("double"))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), position.alias("_position"), average.alias("_average"), "_count")
