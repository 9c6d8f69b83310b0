"""Reproducible sampling and splitting.

All draws are functions of (seed, row id) through md5, so results do not depend on partitioning,
task retries or executor loss. The exact sample keeps the first N rows in md5 order, cut at a hash
bucket found from a small histogram, so no task merges N rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqforge.functions.text import col_of, hash32
from seqforge.session import stored

_BUCKET_HEX = 4   # 65,536 histogram buckets


def sample_key(id_col: Column | str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), col_of(id_col).cast("string")))


def _keyed(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Adds _k (md5 order), _t (a hash of the row: equal ids have an order too) and _b (bucket of _k)."""
    k = sample_key(id_col, seed)
    row = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]   # a map has no hash
    return df.withColumns({"_k": k, "_t": F.xxhash64(*row), "_b": F.conv(F.substring(k, 1, _BUCKET_HEX), 16, 10).cast("int")})


def _cut(keyed: DataFrame, n: Column) -> tuple[int, int] | None:
    """(bucket, rows to take from it) such that with all earlier buckets ``n`` rows are taken; ``n`` may
    use the total ``rows``. None if there are no more rows than that."""
    hist = keyed.groupBy("_b").agg(F.count("*").alias("c"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)   # over <= 65,536 rows
    cum = hist.select("_b", "c", F.sum("c").over(w).alias("cum"), F.sum("c").over(Window.partitionBy(F.lit(0))).alias("rows"))
    at = cum.where((F.col("cum") >= n) & (F.col("rows") > n)).orderBy("_b").select("_b", (n - F.col("cum") + F.col("c")).alias("take")).first()
    return (at["_b"], int(at["take"])) if at else None


def sample_n(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """exactly min(N, rows) rows: the first N in md5(seed:id) order (all rows when fewer).

    One plan for any N: a histogram of the first hex digits finds the bucket of the N-th row; the rows of
    the buckets before it are a filter, and only the rows of that bucket are ordered."""
    keyed = _keyed(df, id_col, seed)
    cut = _cut(keyed, F.lit(n))
    if cut is None:
        return df
    b, take = cut
    edge = keyed.where(F.col("_b") == b).orderBy("_k", "_t").limit(take)
    return keyed.where(F.col("_b") < b).unionByName(edge).select(*df.columns)


def split_exact(df: DataFrame, test_fraction: float, id_col: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """F2 exact: test = the first ceil(p * rows) rows in md5 order; train = the rest. Disjoint and complete: both are
    filters on the key against the last test row. Where that row occurs several times, its copies are numbered
    (and written) and the first ones that are needed go to test, so the size is exact whatever repeats."""
    keyed = _keyed(df, id_col, seed)
    cut = _cut(keyed, F.ceil(F.lit(float(test_fraction)) * F.col("rows")))
    if cut is None:
        return df.limit(0), df
    b, take = cut
    edge = keyed.where(F.col("_b") == b)
    last = edge.select("_k", "_t").orderBy("_k", "_t").limit(take).agg(F.max(F.struct("_k", "_t")).alias("x")).first()["x"]
    if last is None:
        return keyed.where(F.col("_b") >= b).select(*df.columns), keyed.where(F.col("_b") < b).select(*df.columns)
    at = (F.col("_b") == b) & (F.col("_k") == last["_k"]) & (F.col("_t") == last["_t"])
    before = (F.col("_b") < b) | ((F.col("_b") == b) & ((F.col("_k") < last["_k"]) | ((F.col("_k") == last["_k"]) & (F.col("_t") < last["_t"]))))
    n = edge.agg(F.count_if(at).alias("same"), F.count_if(before).alias("before")).first()
    if n["same"] == take - n["before"]:
        return keyed.where(~(before | at)).select(*df.columns), keyed.where(before | at).select(*df.columns)
    copies = stored(keyed.where(at).withColumn("_n", F.monotonically_increasing_id()), "equal-rows")
    limit = _first_ids(copies, "_n", take - n["before"])
    return (keyed.where(~(before | at)).unionByName(copies.where(F.col("_n") >= limit).drop("_n")).select(*df.columns),
            keyed.where(before).unionByName(copies.where(F.col("_n") < limit).drop("_n")).select(*df.columns))


def _first_ids(df: DataFrame, col: str, n: int) -> int:
    """A bound that ``n`` rows' ids (made by monotonically_increasing_id: partition and place) are below."""
    per = df.groupBy(F.shiftright(col, 33).alias("p")).agg(F.count("*").alias("c"))      # a row for each partition
    upto = per.withColumn("cum", F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    r = upto.where(F.col("cum") >= n).orderBy("p").select("p", (F.lit(n) - F.col("cum") + F.col("c")).alias("i")).first()
    return (r["p"] << 33) + r["i"]


def split_hash(df: DataFrame, test_fraction: float, id_col: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """F2 scalable: a row is test when hash32(seed, id) / 2^32 < p. One pass, no count, no shuffle."""
    is_test = (hash32(str(seed), col_of(id_col)) / F.lit(4294967296.0)) < F.lit(float(test_fraction))
    return df.where(~is_test), df.where(is_test)


def fair_coin(id_col: Column | str, seed: int = 42, salt: str = "role") -> Column:
    """0/1 per row, reproducible."""
    return F.pmod(hash32(f"{salt}{seed}", col_of(id_col)), F.lit(2)).cast("int")


def pick_k(df: DataFrame, k: int, id_col: str, seed: int = 42) -> DataFrame:
    """k rows for inspection (F1 with small k)."""
    return sample_n(df, k, id_col, seed)
