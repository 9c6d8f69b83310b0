"""Profiles, reports, top-k and the statistics sidecar.

Every report is one ``agg`` (partial aggregation map-side, one small exchange) or a group count
followed by ``orderBy().limit(k)`` (TakeOrderedAndProject: k rows per task, never the whole group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.functions.text import ws_split


def upper_median(c: Column | str) -> Column:
    """``sorted(v)[n // 2]``: the upper median."""
    name = c if isinstance(c, str) else None
    if name is None:
        raise TypeError("upper_median takes a column name")
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)")


def rating_profile(df: DataFrame, col: str = "rating_value") -> DataFrame:
    """A1: n, min, max, mean (0 decimals) and upper median over present values."""
    v = df.where(F.col(col).isNotNull())
    return v.agg(F.count("*").alias("n"), F.min(col).cast("bigint").alias("min_rating"),
                 F.max(col).cast("bigint").alias("max_rating"), F.round(F.avg(col), 0).alias("mean_rating"),
                 upper_median(col).cast("bigint").alias("median_rating"))


def top_tokens(tokens: DataFrame, k: int = 20, col: str = "token", denominator: Column | int | None = None) -> DataFrame:
    """A2: the k most frequent tokens (ties by token) with their share of ``denominator``."""
    counts = tokens.groupBy(col).agg(F.count("*").alias("cnt"))
    top = counts.orderBy(F.col("cnt").desc(), F.col(col)).limit(k)
    if denominator is None:
        return top
    d = F.lit(denominator) if isinstance(denominator, int) else denominator
    return top.select(col, "cnt", F.round(F.col("cnt") * 100.0 / d, 1).alias("pct"))


def length_profile(df: DataFrame, length: Column, prefix: str = "len") -> DataFrame:
    """A3: min/max/mean of a sequence length."""
    x = df.select(length.alias("_n"))
    return x.agg(F.min("_n").cast("bigint").alias(f"{prefix}_min"), F.max("_n").cast("bigint").alias(f"{prefix}_max"),
                 F.round(F.avg("_n"), 6).alias(f"{prefix}_mean"))


def eval_profile(evals: DataFrame) -> DataFrame:
    """A4: depth, knodes and pvs-per-eval min/max/mean over exploded evals."""
    aggs = []
    for c in ("depth", "knodes", "n_pvs"):
        aggs += [F.min(c).cast("bigint").alias(f"{c}_min"), F.max(c).cast("bigint").alias(f"{c}_max"),
                 F.round(F.avg(c), 6).alias(f"{c}_mean")]
    return evals.agg(F.count("*").alias("n_evals"), *aggs)


def score_kind_counts(pvs: DataFrame) -> DataFrame:
    """A5: non-exclusive presence counts of cp and mate."""
    return pvs.agg(F.count("cp").alias("n_cp"), F.count("mate").alias("n_mate"))


def rating_histogram(df: DataFrame, col: str = "rating", width: int = 100) -> DataFrame:
    """``rating // width * width`` buckets, ascending."""
    b = (F.floor(F.col(col) / width) * width).cast("bigint")
    return df.groupBy(b.alias("bucket")).agg(F.count("*").alias("cnt")).orderBy("bucket")


def extract_report(checked: DataFrame, positions_per_seq: Column, n_steps: Column | None = None) -> DataFrame:
    """Total, successful, failed, positions, success % and positions per success
    (denominator ``max(successful, 1)``). ``checked`` is the sequences with their ``valid_len``, and their number of
    steps ``n_steps`` (that of ``actions``, if not given)."""
    ok = F.col("valid_len") == (F.size("actions") if n_steps is None else n_steps)
    r = checked.agg(F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
              F.sum(F.when(ok, positions_per_seq).otherwise(0)).cast("bigint").alias("total_positions"))
    return r.select("total", "successful", "failed", "total_positions",
                    F.round(F.try_divide(F.col("successful") * 100.0, F.col("total")), 1).alias("success_pct"),
                    F.round(F.col("total_positions") / F.greatest(F.col("successful"), F.lit(1)), 1)
                    .alias("positions_per_success"))


def line_report(lines: DataFrame, valid: Column) -> DataFrame:
    """Records processed, valid lines, success %, line length and depth min/max/avg over the
    valid ones - one pass, one aggregate. ``lines`` has one row per parsed record (line NULL when
    the path is missing). Empty input gives NULLs (the reference raises)."""
    n = F.size(ws_split("line"))
    x = lines.select(valid.alias("_ok"), F.when(valid, n).alias("_n"), F.when(valid, F.col("depth")).alias("_d"))
    s = x.agg(F.count("*").alias("records"), F.count_if("_ok").alias("valid"),
              F.min("_n").cast("bigint").alias("len_min"), F.max("_n").cast("bigint").alias("len_max"),
              F.round(F.avg("_n"), 1).alias("len_avg"), F.min("_d").cast("bigint").alias("depth_min"),
              F.max("_d").cast("bigint").alias("depth_max"), F.round(F.avg("_d"), 1).alias("depth_avg"))
    return s.select("records", "valid", F.round(F.try_divide(F.col("valid") * 100.0, F.col("records")), 1)
                    .alias("success_pct"), "len_min", "len_max", "len_avg", "depth_min", "depth_max", "depth_avg")


def stats_sidecar(puzzles: DataFrame, ok: Column | None = None, top_k: int = 50) -> DataFrame:
    """One JSON row: counters, top themes, sorted rating buckets, move-count stats and a
    move-count histogram (instead of the raw per-puzzle list, which grows with the data). Puzzles that are not
    ``ok`` (all are, if it is not given) are counted as failed, in the same pass.

    One pass: themes, rating buckets and move counts are tagged rows of a single grouped count
    (partial aggregation); totals, positions (one per solver ply, ceil(n/2)) and min/max/mean come
    from the move-count histogram. Only the top ``top_k`` themes are kept before the final one-row
    collect, so that row is bounded by top_k + #buckets + #distinct move counts."""
    n = F.size("moves")
    bucket = (F.floor(F.col("rating") / 100) * 100).cast("bigint").cast("string")
    tagged = F.concat(F.transform("themes", lambda t: F.struct(F.lit("t").alias("kind"), t.alias("key"))),
                      F.array(F.struct(F.lit("b").alias("kind"), bucket.alias("key")),
                              F.struct(F.lit("n").alias("kind"), n.cast("string").alias("key"))))
    if ok is not None:
        tagged = F.when(F.coalesce(ok, F.lit(False)), tagged).otherwise(F.array(F.struct(F.lit("f").alias("kind"), F.lit("").alias("key"))))
    grouped = (puzzles.select(F.explode(tagged).alias("x"))
               .groupBy(F.col("x.kind").alias("kind"), F.col("x.key").alias("key")).agg(F.count("*").alias("cnt")))
    top = grouped.where(F.col("kind") == "t").orderBy(F.col("cnt").desc(), F.col("key")).limit(top_k)
    parts = top.unionByName(grouped.where(F.col("kind") != "t"))
    one = parts.agg(F.collect_list(F.struct("kind", "key", "cnt")).alias("p"))

    def of(kind: str) -> Column:
        return F.filter("p", lambda x: x["kind"] == F.lit(kind))

    failed_c = F.aggregate(of("f"), F.lit(0).cast("bigint"), lambda a, x: a + x["cnt"])
    lens = F.transform(of("n"), lambda x: F.struct(x["key"].cast("int").alias("n"), x["cnt"].alias("c")))
    total_ok = F.aggregate(lens, F.lit(0).cast("bigint"), lambda a, x: a + x["c"])
    positions = F.aggregate(lens, F.lit(0).cast("bigint"), lambda a, x: a + F.floor((x["n"] + 1) / 2) * x["c"])
    moves_sum = F.aggregate(lens, F.lit(0).cast("bigint"), lambda a, x: a + x["n"] * x["c"])
    n_min = F.array_min(F.transform(lens, lambda x: x["n"]))
    n_max = F.array_max(F.transform(lens, lambda x: x["n"]))
    themes = F.sort_array(F.transform(of("t"), lambda x: F.struct(x["cnt"].alias("c"), x["key"].alias("t"))), asc=False)
    buckets = F.sort_array(F.transform(of("b"), lambda x: F.struct(x["key"].cast("bigint").alias("b"), x["cnt"].alias("c"))))
    hist = F.sort_array(lens)
    return one.select(F.to_json(F.struct(
        (total_ok + failed_c).alias("total"), positions.alias("total_positions"), total_ok.alias("successful"),
        failed_c.alias("failed"),
        F.map_from_entries(F.transform(themes, lambda x: F.struct(x["t"], x["c"]))).alias("themes"),
        F.map_from_entries(F.transform(buckets, lambda x: F.struct(x["b"].cast("string"), x["c"]))).alias("rating_buckets"),
        F.struct(n_min.alias("min"), n_max.alias("max"), F.try_divide(moves_sum.cast("double"), total_ok.cast("double")).alias("mean")).alias("move_stats"),
        F.map_from_entries(F.transform(hist, lambda x: F.struct(x["n"].cast("string"), x["c"])))
        .alias("move_count_histogram"))).alias("stats_json"))


def preview(df: DataFrame, order_by: list[str], n: int = 3) -> DataFrame:
    """The first n rows on a stable key (callers truncate columns with slice/substring)."""
    return df.orderBy(*order_by).limit(n)
