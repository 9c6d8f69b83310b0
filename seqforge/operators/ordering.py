"""Ordered positions and running sums without putting a whole group (or the whole table) in one task.

A window ``partitionBy(g).orderBy(o)`` sorts every row of a group in one task; with a group that
holds a third of the data, that task is the job. Both functions here work in two levels instead:
rows belong to buckets that follow the order, a small table holds the total of each bucket, and only
the rows of one bucket are sorted together. The bucket is a value of the row, never recomputed:

* ``bucket_prefix`` takes a bucket column that the caller derives from the row (a hash prefix, a
  block number, a key prefix);
* ``ordered_prefix`` derives it for any order by range-partitioning on (group, order) once and
  storing the range number with the row, so that both uses of the rows see the same ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqforge.session import stored


def bucket_prefix(df: DataFrame, bucket: str, order: Sequence[Column], value: Column, group: Sequence[str] = (),
                  out: str = "prefix") -> DataFrame:
    """Sum of ``value`` over the rows before this one (exclusive), within ``group``, in the order
    (``bucket``, then ``order``). The buckets of a group must be in that order; ``order`` must be total
    within a bucket, or its ties interchangeable. Null group values form a group of their own."""
    rows = df.withColumn("_v", value)
    totals = rows.groupBy(bucket, *group).agg(F.sum("_v").alias("_t"))
    # Rows per group here are its buckets: few even for a group with a third of the data.
    prior = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(bucket).alias("_b"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
                            F.coalesce(F.sum("_t").over(prior), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(bucket, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("_run", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    cond = F.col(bucket).eqNullSafe(F.col("_b"))
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (within.join(offsets, cond)
            .withColumn(out, F.col("_off") + F.col("_run"))
            .drop("_v", "_run", "_off", "_b", *[f"_g{i}" for i in range(len(group))]))


def ordered_prefix(df: DataFrame, order: Sequence[Column], value: Column, group: Sequence[str] = (),
                   out: str = "prefix") -> DataFrame:
    """Inclusive running sum of ``value`` within ``group`` in ``order`` (a total order within the
    group). With ``value`` = 1 this is the 1-based row number."""
    keyed = (df.withColumn("_w", value).repartitionByRange(*[F.col(g) for g in group], *order)
             .withColumn("_range", F.spark_partition_id()))
    r = bucket_prefix(stored(keyed, "ranges"), "_range", order, F.col("_w"), group, "_before")
    return r.withColumn(out, F.col("_before") + F.col("_w")).drop("_before", "_w", "_range")


def group_positions(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "pos") -> DataFrame:
    """1-based position of each row within its group, skew-safe."""
    r = ordered_prefix(df, order, F.lit(1), group, out)
    return r.withColumn(out, F.col(out).cast("int"))


def dense_index(df: DataFrame, order: Sequence[Column], start: int = 0, out: str = "id") -> DataFrame:
    """0-based (plus ``start``) index in a total order over the whole table."""
    r = ordered_prefix(df, order, F.lit(1), (), out)
    return r.withColumn(out, (F.col(out) - 1 + start).cast("int"))


def running_total(df: DataFrame, order_col: str, size: Column, out: str = "running") -> DataFrame:
    """Inclusive running sum over the whole table in ``order_col`` order."""
    return ordered_prefix(df, [F.col(order_col)], size, (), out)
