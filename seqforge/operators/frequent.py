"""A2 over a long tail: the most frequent tokens without shuffling every distinct one.

Each task keeps ``counters`` tokens (Misra-Gries: when there are more, the count of the first one too many is taken
off all), so it sends at most so many rows and its error, the sum of what it took off. Merged, a token's count lies
between its kept count and that plus the sum of errors. Candidates are the tokens that can reach the k-th best kept count;
they alone are counted exactly, by a filter on the tokens. If a token that no task kept could still be among the best (the sum of
errors reaches the k-th kept count), or there are too many candidates to send, all tokens are counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqforge.operators.profile import top_tokens
from seqforge.session import stored

COUNTERS, SENT = 20_000, 200_000     # counters of a task; candidates that may be sent to every task


def kept_counts(tokens: DataFrame, col: str = "token", counters: int = COUNTERS) -> DataFrame:
    """(token, n, error) of every task: its counters; the row with a null token holds its error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        error = 0
        for b in batches:
            met = pc.value_counts(b.column(0).drop_null())
            held.update(dict(zip(met.field("values").to_pylist(), met.field("counts").to_pylist(), strict=True)))
            if len(held) > 2 * counters:
                held, error = _cut(held, error, counters)
        held, error = _cut(held, error, counters)
        yield pa.RecordBatch.from_arrays([pa.array([*held, None], pa.string()), pa.array([*held.values(), 0], pa.int64()),
                                          pa.array([0] * len(held) + [error], pa.int64())], ["token", "n", "error"])

    return tokens.select(F.col(col).cast("string").alias("token")).mapInArrow(run, "token string, n bigint, error bigint")


def _cut(held: Counter, error: int, counters: int) -> tuple[Counter, int]:
    """The first ``counters`` tokens less the count of the next one."""
    if len(held) <= counters:
        return held, error
    off = held.most_common(counters + 1)[-1][1]
    return Counter({t: n - off for t, n in held.items() if n > off}), error + off


def candidates(tokens: DataFrame, k: int, col: str = "token", counters: int = COUNTERS) -> DataFrame | None:
    """(token) of all tokens that can be among the ``k`` most frequent, ties included; None where that cannot be told."""
    kept = stored(kept_counts(tokens, col, counters).groupBy("token").agg(F.sum("n").alias("n"), F.sum("error").alias("error")), "kept")
    error = kept.where("token IS NULL").agg(F.coalesce(F.sum("error"), F.lit(0))).first()[0]
    best = [r["n"] for r in kept.where("token IS NOT NULL").orderBy(F.col("n").desc()).limit(k).select("n").collect()]
    if error and (len(best) < k or best[-1] <= error):
        return None
    least = best[-1] - error if len(best) == k else 0
    return kept.where(F.col("token").isNotNull() & (F.col("n") >= least)).select("token")


def top_tokens_long_tail(tokens: DataFrame, k: int = 20, col: str = "token", counters: int = COUNTERS) -> DataFrame:
    """The rows of :func:`seqforge.operators.profile.top_tokens` (without shares); null tokens are not counted."""
    tokens = tokens.where(F.col(col).isNotNull())
    some = candidates(tokens, k, col, counters)
    if some is None or some.count() > SENT:
        return top_tokens(tokens, k, col)
    return top_tokens(tokens.join(F.broadcast(some.withColumnRenamed("token", col)), col, "left_semi"), k, col)
