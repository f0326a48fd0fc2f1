"""Running sums over groups of any size without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.scratch import written


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str, per_task: int = 200_000, name: str = "prefix") -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the group.

    The rows are range-partitioned by group and order, the totals of each
    (partition, group) are summed into offsets, and each partition adds its
    own running sum. A group that holds a third of all rows is spread over as
    many partitions as its size asks for. ``order`` must be unique within the
    group for a defined result. Null values count as 0.
    """
    n = df.count()
    parts = max(1, -(-n // per_task))
    ranged = written(
        df.repartitionByRange(parts, *group, *order).withColumn("__pid", F.spark_partition_id()), name
    )
    totals = ranged.groupBy("__pid", *group).agg(F.sum(F.coalesce(value, F.lit(0))).alias("__t"))
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__pid", *group, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ["__pid", *group]]
    # With no group the offsets are one row per partition.
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    inner = Window.partitionBy("__pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("__l", F.coalesce(F.sum(F.coalesce(value, F.lit(0))).over(inner), F.lit(0)))
    joined = local.alias("a").join(offsets.alias("b"), cond, "left")
    keep = [F.col(f"a.{c}") for c in df.columns]
    return joined.select(*keep, (F.col("a.__l") + F.col("b.__o")).alias(out))
