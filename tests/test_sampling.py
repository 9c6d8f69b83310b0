"""F1-F3 properties: exact size, stable under repartitioning, splits disjoint."""
from pyspark.sql import functions as F

from seqforge.operators import sampling


def test_sample_is_exact_and_stable(spark):
    import hashlib
    df = spark.range(3000).select(F.col("id").alias("k"))
    order = sorted(range(3000), key=lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest())
    for n in (0, 1, 3, 700, 2999):
        for d in (df, df.repartition(17)):
            assert {r["k"] for r in sampling.sample_n(d, n, "k", 5).collect()} == set(order[:n])
    assert sampling.sample_n(df, 5000, "k", 5).count() == 3000 and sampling.sample_n(df.limit(0), 5, "k", 5).count() == 0
    train, test = sampling.split_exact(df, 0.2, "k", 5)
    assert {r["k"] for r in test.collect()} == set(order[:600]) and train.count() == 2400


def test_equal_ids_have_an_order(spark):
    df = spark.range(400).select(F.lit(7).alias("k"), F.col("id").alias("v"))
    a = {r["v"] for r in sampling.sample_n(df, 150, "k", 5).collect()}
    b = {r["v"] for r in sampling.sample_n(df.repartition(9), 150, "k", 5).collect()}
    assert a == b and len(a) == 150
    train, test = sampling.split_exact(df, 0.25, "k", 5)
    assert test.count() == 100 and train.count() == 300


def test_equal_rows_are_cut_exactly(spark):
    """Half of the rows repeat; every fraction gives exactly ceil(p * rows) test rows and loses none."""
    import math
    from collections import Counter
    df = spark.range(600).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 40).alias("k")).repartition(5)
    want = Counter(r["k"] for r in df.collect())
    for p in (0.05, 0.3, 0.5, 0.77):
        train, test = sampling.split_exact(df, p, "k", 5)
        a, b = (Counter(r["k"] for r in d.collect()) for d in (train, test))
        assert b.total() == math.ceil(p * 600) and a + b == want


def test_splits_disjoint_complete(spark):
    df = spark.range(1234).select(F.col("id").alias("k"))
    for fn in (sampling.split_exact, sampling.split_hash):
        tr, te = fn(df, 0.01, "k", 42)
        a, b = {r["k"] for r in tr.collect()}, {r["k"] for r in te.collect()}
        assert not (a & b) and len(a | b) == 1234
    tr, te = sampling.split_exact(df, 0.01, "k", 42)
    assert te.count() == 13   # ceil(12.34)


def test_fair_coin_balanced(spark):
    df = spark.range(4000).select(sampling.fair_coin("id").alias("c"))
    n1 = df.where("c = 1").count()
    assert 1800 < n1 < 2200


def test_scale_conf_sizes():
    from seqforge.session import scale_conf
    big = scale_conf(100e12, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) >= 100e12 // int(big["spark.sql.files.maxPartitionBytes"])
    assert int(scale_conf(1e6, 4)["spark.sql.shuffle.partitions"]) == 12
