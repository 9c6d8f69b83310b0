"""Positions and running sums at volume: many files, a payload column, coalescing on and off."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqforge.operators import ordering
from seqforge.sources import readers

N = 1_500_000


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    """1.5 M rows in 8 files: k unordered, a group with a third of the rows, a payload of varying length."""
    path = str(tmp_path_factory.mktemp("ordering") / "t")
    ids = spark.range(0, N, numPartitions=8)
    k = (F.col("id") * 7919) % N
    ids.select(k.alias("k"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).alias("g"),
               (F.col("id") % 50 + 1).alias("n"), F.repeat(F.lit("x"), (F.col("id") % 60).cast("int")).alias("payload")).write.parquet(path)
    return path


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_positions_and_sums_equal_windows(spark, big, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        t = spark.read.parquet(big)
        w = Window.partitionBy("g").orderBy("k")
        want = t.select("k", F.row_number().over(w).alias("want"))
        got = ordering.group_positions(t, ["g"], [F.col("k")])
        r = got.join(want, "k").agg(F.count("*").alias("n"), F.count_if(F.col("pos") != F.col("want")).alias("bad"), F.sum(F.length("payload")).alias("x")).first()
        assert (r["n"], r["bad"]) == (N, 0) and r["x"] == t.agg(F.sum(F.length("payload"))).first()[0]
        total = ordering.running_total(t, "k", F.col("n"))
        # k = 7919 * id mod N, so the n of the first rows are known without a window over one task
        check = total.where("k < 2000").orderBy("k").select("n", "running", "payload").collect()
        s = 0
        for row in check:
            s += row["n"]
            assert row["running"] == s
        assert total.agg(F.max("running"), F.count("*")).first()[:] == (t.agg(F.sum("n")).first()[0], N)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_byte_slice_keeps_the_line(spark, big):
    t = spark.read.parquet(big)
    got = readers.byte_slice(t, "k", F.length("payload") + 1, 10, 10)
    end = F.sum(F.length("payload") + 1).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) - 1
    want = t.select("k", end.alias("o")).where(f"o >= {10 * readers.MIB} AND o < {20 * readers.MIB}")
    r = got.join(want, "k", "full").agg(F.count("*").alias("n"), F.count_if(F.col("newline_offset").eqNullSafe(F.col("o"))).alias("same"), F.count("payload").alias("p")).first()
    assert r["n"] == r["same"] == r["p"] > 100_000


def test_bucket_prefix_with_null_groups(spark):
    rows = [(None, 1, 10, 5), (None, 0, 3, 2), ("a", 0, 1, 1), ("a", 0, 2, 4), ("a", 7, 0, 8)]
    t = spark.createDataFrame(rows, "g string, b int, k int, v bigint")
    got = {(r["g"], r["b"], r["k"]): r["p"] for r in ordering.bucket_prefix(t, "b", [F.col("k")], F.col("v"), ["g"], "p").collect()}
    assert got == {(None, 1, 10): 2, (None, 0, 3): 0, ("a", 0, 1): 0, ("a", 0, 2): 1, ("a", 7, 0): 5}
