"""Long-tail top-k equals the plain one, also with ties at the border and with too few counters."""
import random

import pytest
from pyspark.sql import functions as F

from seqforge.operators import frequent, profile


def rows(spark, seed, tail=3000):
    rng = random.Random(seed)
    words = [f"w{int(rng.random() ** 4 * 60)}" for _ in range(6000)] + [f"tail{i}" for i in range(tail)] + ["tie1"] * 50 + ["tie2"] * 50 + ["tie3"] * 50
    rng.shuffle(words)
    return spark.createDataFrame([(w,) for w in [*words, None, None]], "token string").repartition(5)


@pytest.mark.parametrize("counters", [5, 200, 20_000])
def test_equals_plain_top_k(spark, counters):
    df = rows(spark, 1)
    for k in (1, 7, 30, 200):
        want = [tuple(r) for r in profile.top_tokens(df.where("token IS NOT NULL"), k).collect()]
        assert [tuple(r) for r in frequent.top_tokens_long_tail(df, k, "token", counters).collect()] == want


def test_tasks_send_few_rows_and_the_tail_is_not_counted(spark):
    df = rows(spark, 2, 20_000)
    kept = frequent.kept_counts(df, "token", 300)
    assert kept.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 301
    some = frequent.candidates(df, 5, "token", 300)
    assert some is not None and some.count() < 400


def test_empty(spark):
    df = spark.createDataFrame([], "token string")
    assert frequent.top_tokens_long_tail(df, 5).isEmpty()
