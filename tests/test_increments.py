"""Merged states equal the batch profile: exactly, and within the sketch's error for quantiles."""
from pyspark.sql import functions as F

from seqforge.operators import increments


def frame(spark):
    x = (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 10).alias("x")
    return spark.range(30_000).select("id", x, F.when(F.col("id") % 7 > 0, (F.col("id") % 500)).alias("y"))


def test_parts_merge_to_the_batch_profile(spark, scratch):
    df = frame(spark)
    measures = {"x": F.col("x"), "y": F.col("y")}
    for part, rest in (("a", 0), ("b", 1), ("c", 2)):
        increments.add_part(df.where(F.col("id") % 3 == rest), scratch, part, measures)
    increments.add_part(df.where(F.col("id") % 3 == 1), scratch, "b", measures)      # written again: replaced
    states = increments.read_states(spark, scratch)
    assert states.count() == 6
    got = {r["measure"]: r for r in increments.merged_profile(states, (0.1, 0.5, 0.9)).collect()}
    whole = {r["measure"]: r for r in increments.merged_profile(increments.part_state(df, "all", measures)).collect()}
    for m in measures:
        want = df.agg(F.count(m), F.count_if(F.col(m).isNull()), F.avg(m), F.min(m), F.max(m)).first()
        r = got[m]
        assert (r["n"], r["nulls"], r["least"], r["greatest"]) == (want[0], want[1], want[3], want[4]) and abs(r["mean"] - want[2]) < 1e-6
        assert r["histogram"] == whole[m]["histogram"]
        assert r["histogram"] == {b["b"]: b["count"] for b in df.where(F.col(m).isNotNull()).groupBy((F.floor(F.col(m) / 100) * 100).alias("b")).count().collect()}
        for q, v in zip((0.1, 0.5, 0.9), r["quantiles"]):
            rank = df.where(F.col(m) <= v).count() / want[0]
            assert abs(rank - q) < 0.015


def test_nulls_only_and_empty(spark):
    df = spark.createDataFrame([(None,)] * 3, "v double")
    r = increments.merged_profile(increments.part_state(df, "p", {"v": F.col("v")})).first()
    assert (r["n"], r["nulls"], r["mean"], r["histogram"], r["quantiles"]) == (0, 3, None, {}, [None])
    assert increments.merged_profile(increments.part_state(df.limit(0), "p", {"v": F.col("v")})).isEmpty()
