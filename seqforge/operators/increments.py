"""A1, A3, A4, A6, S11 kept up to date: a mergeable state for each input part, stored, and merged without a rescan.

A state row says, for one part (a file, a day, a batch) and one measured column: how many values and nulls, their sum, least and
greatest value, a histogram (bucket -> count) and a KLL quantile sketch. Adding a part writes its rows only. The profile
merges the rows of all parts: counts, sums, bounds and histograms exactly, quantiles from the merged sketch (normalised
rank error about 1 % at the default size).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_K = 400       # size of a quantile sketch: a few KB, rank error below 1 %
STATE = "part string, measure string, n bigint, nulls bigint, total double, least double, greatest double, histogram map<bigint,bigint>, sketch binary"


def part_state(df: DataFrame, part: Column | str, measures: dict[str, Column], width: float = 100, k: int = SKETCH_K) -> DataFrame:
    """(part, measure, ...) of ``df``: one pass, one shuffle of a row for each part, measure and bucket and task. Buckets are
    ``floor(value / width)``, named by their lower end."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), c.cast("double").alias("v")) for name, c in measures.items()])).alias("m")
    rows = df.select((F.lit(part) if isinstance(part, str) else part).cast("string").alias("part"), each).select("part", "m.*")
    bucket = (F.floor(F.col("v") / width) * width).cast("bigint")
    per = rows.groupBy("part", "measure", bucket.alias("b")).agg(
        F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), F.sum("v").alias("total"), F.min("v").alias("least"),
        F.max("v").alias("greatest"), F.kll_sketch_agg_double("v", F.lit(k)).alias("s"))
    return per.groupBy("part", "measure").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.map_from_entries(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("b", "n")))).alias("histogram"),
        F.kll_merge_agg_double("s", F.lit(k)).alias("sketch"))


def add_part(df: DataFrame, path: str, part: str, measures: dict[str, Column], width: float = 100) -> None:
    """Writes the state of one part beside those of the others; a part that is written again replaces itself."""
    part_state(df, part, measures, width).drop("part").coalesce(1).write.mode("overwrite").parquet(f"{path}/part={part}")


def read_states(spark, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).withColumn("part", F.col("part").cast("string"))


def merged_profile(states: DataFrame, quantiles: Sequence[float] = (0.5,), k: int = SKETCH_K) -> DataFrame:
    """(measure, n, nulls, mean, least, greatest, histogram, quantiles[]) over all parts. The histogram's buckets are summed by
    key, so a measure's row holds as many entries as it has buckets."""
    flat = states.groupBy("measure").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("total").alias("total"), F.min("least").alias("least"),
                                         F.max("greatest").alias("greatest"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("s"))
    buckets = (states.select("measure", F.explode("histogram").alias("b", "c")).groupBy("measure", "b").agg(F.sum("c").alias("c"))
               .groupBy("measure").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("b", "c")))).alias("histogram")))
    q = F.array(*[F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", F.lit(float(x)))) for x in quantiles])
    return flat.join(buckets, "measure", "left").select(
        "measure", "n", "nulls", F.try_divide("total", "n").alias("mean"), "least", "greatest",
        F.coalesce("histogram", F.create_map().cast("map<bigint,bigint>")).alias("histogram"), q.alias("quantiles"))
