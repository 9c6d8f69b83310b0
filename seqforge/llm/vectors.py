"""Vector columns in Arrow batches, and merging of nearest-row lists, for the two vector searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqforge.llm.common import reach


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows with an id and a vector that is not empty and has only finite components."""
    reach(df.sparkSession)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col("vec_id").isNotNull() & (F.size(vector) > 0) & ~bad)


def by_length(batch: pa.RecordBatch, name: str, kind) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each vector length in the batch; the column has no nulls."""
    column = batch.column(name)
    cut = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(kind)
    n = np.diff(cut)
    for d in np.unique(n):
        rows = np.nonzero(n == d)[0]
        yield rows, values[cut[rows][:, None] + np.arange(d)]


class Best:
    """The best ``k`` rows of each query so far: smaller ``cost`` first, then smaller id, then row."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.cost: list[np.ndarray] = [np.zeros(0)] * queries
        self.id: list[np.ndarray] = [np.zeros(0, np.int64)] * queries
        self.row: list[np.ndarray] = [np.zeros(0, np.int64)] * queries

    def worst(self, q: int):
        """Cost that a further row may have at most; None while there are fewer than ``k``."""
        return self.cost[q][-1] if len(self.cost[q]) == self.k else None

    def add(self, q: int, cost: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        cost = np.concatenate([self.cost[q], cost]) if len(self.cost[q]) else cost
        ids, rows = np.concatenate([self.id[q], ids]), np.concatenate([self.row[q], rows])
        first = np.lexsort((rows, ids, cost))[:self.k]
        self.cost[q], self.id[q], self.row[q] = cost[first], ids[first], rows[first]


def query_blocks(queries: DataFrame, block_rows: int) -> Iterator[pa.Table]:
    """The rows of ``queries`` in blocks of about ``block_rows``, one at a time, by hash of row_id. A block
    is bounded whatever the table's size, so it may go to every task."""
    blocks = -(-queries.count() // block_rows)
    for b in range(blocks):
        yield queries.where(F.pmod(F.xxhash64("row_id"), F.lit(blocks)) == b).toArrow()


def ranked(found: DataFrame, best_first: list, k: int) -> DataFrame:
    """The first ``k`` rows of each query of what the tasks found, with ``rank`` from 1."""
    w = Window.partitionBy("query_row").orderBy(*best_first, "vec_id", "row_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Usable vectors in SQL: r (a row number), vec_id and e, the components as given by ``component``.
ENTRIES_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: {component}) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
"""
