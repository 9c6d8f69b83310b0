"""Completion scoring plans (W9, W11-W16, A9): lookups as joins, weights, totals, advantages.

Completions arrive as a table (prompt_id, completion_id, completion + aligned columns). Rule-based
rewards are plain columns (``functions.rewards``); the value lookup is one equi-join with an
``evals(state, action, depth, cp, mate)`` table; a key that occurs twice in it raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqforge.functions import fixed
from seqforge.functions import rewards as R
from seqforge.functions.tags import extract_move, extract_rationale


def unique_per_key(df: DataFrame, key: str, what: str) -> DataFrame:
    """``df`` grouped per key; a key that occurs twice raises when the rows are read."""
    rest = [c for c in df.columns if c != key]
    n = F.count("*")
    only = F.when(n > 1, F.raise_error(F.lit(f"{what}: more than one row for a {key}"))).otherwise(F.first(F.struct(*rest)))
    return df.groupBy(key).agg(only.alias("_row")).select(key, "_row.*")


def align_columns(completions: DataFrame, columns: DataFrame, key: str = "completion_id",
                  check: bool = True) -> DataFrame:
    """Explicit 1:1 equi-join of completions with their aligned prompt columns."""
    return completions.join(unique_per_key(columns, key, "aligned columns") if check else columns, key, "inner")


def _values(evals: DataFrame, depth: int) -> DataFrame:
    """(state, map action -> folded value). A (state, action) that occurs twice raises, as a map cannot
    hold it twice. The actions of a state are its legal moves, so the map is small."""
    e = evals.where(F.col("depth") == depth).select("state", "action", R.fold_mate("cp", "mate").alias("v"))
    return e.groupBy(F.col("state").alias("_s")).agg(F.map_from_entries(F.collect_list(F.struct("action", "v"))).alias("_values"))


def lookup_values(completions: DataFrame, evals: DataFrame, depth: int = 3, state_col: str = "fen",
                  move_col: str = "move", ref_col: str = "correct_move", asked: Column | None = None) -> DataFrame:
    """W9+W10: folded value of the predicted and the reference move; NULL when the key is missing, or where
    ``asked`` is false. One equi-join on the state serves both moves."""
    key = F.col(state_col)
    if asked is not None:   # a key of its own that no state has: rows not asked for stay spread out
        key = F.when(asked, key).otherwise(F.concat(F.lit("\u0000"), F.xxhash64(*completions.columns).cast("string")))
    j = completions.withColumn("_key", key).join(_values(evals, depth), F.col("_key") == F.col("_s"), "left")
    of = lambda c: F.try_element_at(F.col("_values"), F.col(c))
    return j.withColumn("cp_pred", of(move_col)).withColumn("cp_ref", of(ref_col)).drop("_key", "_s", "_values")


def quality_reward(completions: DataFrame, evals: DataFrame, depth: int = 3, completion: str = "completion",
                   legal: str = "legal_moves", state_col: str = "fen", ref_col: str = "correct_move") -> DataFrame:
    """Adds ``r_quality``. Completions are read once: rows that fail the cheap gate (no move, not a
    candidate) look nothing up; the rest are scored on the value curve (missing value -> -1.0)."""
    c = completions.withColumn("_gate", R.quality_gate(completion, legal)).withColumn("_move", extract_move(completion))
    v = lookup_values(c, evals, depth, state_col, "_move", ref_col, F.col("_gate").isNull())
    return (v.withColumn("r_quality", F.coalesce("_gate", R.quality_curve("cp_pred", "cp_ref")))
            .drop("cp_pred", "cp_ref", "_gate", "_move"))


def scaled_rewards(df: DataFrame, completion: str = "completion", legal: str = "legal_moves",
                   quality: str = "r_quality") -> DataFrame:
    """The five weighted reward columns of the mix, named like the logged metrics."""
    base = {"combined_format": R.r_combined_format(completion),
            "token_penalty": R.r_token_penalty(completion),
            "rationale_length": R.r_conciseness(completion),
            "legality": R.r_legality(completion, legal),
            "stockfish_eval": F.col(quality)}
    return df.select("*", *[R.scaled(base[name], w, name) for name, w in fixed.REWARD_MIX])


def total_reward(df: DataFrame) -> DataFrame:
    """Sum of the weighted columns in the trainer's order."""
    total: Column | None = None
    for name, w in fixed.REWARD_MIX:
        c = F.col(R.column_name(name, w))
        total = c if total is None else total + c
    return df.withColumn("total_reward", total)


def group_advantage(df: DataFrame, group: str = "prompt_id", reward: str = "total_reward",
                    eps: float = fixed.ADVANTAGE_EPS) -> DataFrame:
    """(r - mean) / (std + eps) within the generations of one prompt; a one-row group has no
    deviation and gets 0. A window per prompt: a group is the few generations of one prompt."""
    w = Window.partitionBy(group)
    mean, std = F.avg(reward).over(w), F.stddev_samp(reward).over(w)
    j = df.withColumn("_mean", mean).withColumn("_std", std)
    adv = F.when(F.col("_std").isNull() | F.isnan("_std"), F.lit(0.0)).otherwise(
        (F.col(reward) - F.col("_mean")) / (F.col("_std") + F.lit(eps)))
    return j.withColumn("advantage", adv).drop("_mean", "_std")


def reward_report(df: DataFrame) -> DataFrame:
    """Mean of each weighted reward under its metric name (unpivot + group mean)."""
    ids = [c for c in df.columns if c not in {R.column_name(n, w) for n, w in fixed.REWARD_MIX}][:1]
    long = df.unpivot(ids, [R.column_name(n, w) for n, w in fixed.REWARD_MIX], "column", "reward")
    names = F.create_map(*[x for n, w in fixed.REWARD_MIX for x in (F.lit(R.column_name(n, w)), F.lit(R.metric_name(n, w)))])
    return (long.groupBy("column").agg(F.avg("reward").alias("mean_reward"), F.count("*").alias("n"))
            .select(F.element_at(names, F.col("column")).alias("metric"), "mean_reward", "n"))


def validation_report(df: DataFrame, completion: str = "completion", legal: str = "legal_moves") -> DataFrame:
    """Membership and tag checks as counts."""
    m = extract_move(completion)
    legal_ok = F.coalesce(F.array_contains(F.col(legal), m), F.lit(False))
    return df.agg(F.count("*").alias("n"), F.count_if(legal_ok).alias("n_move_legal"),
                  F.count_if(extract_rationale(completion).isNotNull()).alias("n_has_rationale"),
                  F.count_if(m.isNotNull()).alias("n_has_move"))
