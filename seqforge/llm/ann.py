"""Approximate nearest neighbours by randomly rotated one-bit codes (operator 5).

Index (one pass, a row per vector): the vector less the mean of all, turned by a random rotation (seeded,
one for each vector length); the signs as packed bits; two correction scalars: its length, and the inner
product of the unit vector with the code's own direction.

Search: queries come in blocks of at most about ``QUERY_BLOCK`` rows, each sent to every task and held
against every indexed row. A query is rotated likewise and rounded to ``QUERY_BITS`` bits, kept as bit
planes; and-ing planes with codes and counting bits gives the inner product with a code, the scalars
correct it to an estimate of the distance. The estimate's error is at most ``CONFIDENCE`` standard errors
(times the spread the scalar tells, plus the rounding) with high probability; only rows whose lower bound
is not above the k-th distance found so far are measured on the original vectors. So what is returned has
exact distances, and the chance to miss a neighbour is that of passing the error bound.

Defined results: vectors that are null, empty, all zero, or hold a null or non-finite component take no
part, neither do rows with a null vec_id; vectors of different lengths are never compared; each repeated
row counts as a row of its own (a query leaves out its own row only); ties go to the smaller vec_id; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqforge.llm.common import chunks, stored, with_row_id
from seqforge.llm.vectors import ENTRIES_SQL, Best, by_length, query_blocks, ranked, usable

SEED = 5
QUERY_BITS = 6
CONFIDENCE = 2.5
QUERY_BLOCK = 2048
ROWS_AT_ONCE, QUERIES_AT_ONCE = 4096, 128


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _pack(bits: np.ndarray) -> np.ndarray:
    """(rows, d) of 0 and 1 -> (rows, words) of 64 bits."""
    pad = -bits.shape[1] % 64
    return np.packbits(np.pad(bits.astype(np.uint8), ((0, 0), (0, pad))), axis=1, bitorder="little").view(np.uint64)


def encode(x: np.ndarray, mean: np.ndarray, turn: np.ndarray):
    """Codes, lengths and corrections of vectors."""
    r = (x - mean) @ turn
    length = np.sqrt((r * r).sum(axis=1))
    unit = r / np.where(length > 0, length, 1)[:, None]
    inner = np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1])
    return _pack(r > 0), length, np.where(length > 0, inner, 1.0)


def means(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Mean vector of each length, over all rows; sums are made in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for b in chunks(batches, 4096):
            for rows, x in by_length(b, "embedding", np.float64):
                n, s = total.get(x.shape[1], (0, 0.0))
                total[x.shape[1]] = n + len(rows), s + x.sum(axis=0)
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([n]), pa.array([s.tolist()], pa.list_(pa.float64()))], ["d", "n", "s"])

    parts = vectors.select("embedding").mapInArrow(run, "d bigint, n bigint, s array<double>")
    sums = parts.select("d", "n", F.posexplode("s").alias("i", "s")).groupBy("d", "i").agg((F.sum("s") / F.sum("n")).alias("mean"))
    got = sums.orderBy("d", "i").toPandas()
    return {int(d): g["mean"].to_numpy() for d, g in got.groupby("d")}


def build_index(vectors: DataFrame) -> DataFrame:
    """row_id, vec_id, embedding, code, length, inner: a row per usable vector, written to the shared
    folder; every row is indexed and the mean covers all of them."""
    some = usable(vectors.select("vec_id", "embedding"), "embedding").where(F.exists("embedding", lambda x: x != 0))
    centre = means(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in chunks(batches, ROWS_AT_ONCE):
            for rows, x in by_length(b, "embedding", np.float64):
                d = x.shape[1]
                turn = turns.setdefault(d, rotation(d))
                code, length, inner = encode(x, centre[d], turn)
                part = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("embedding"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(inner)],
                    ["vec_id", "embedding", "code", "length", "inner"])

    schema = some.select("vec_id", "embedding").withColumn("code", F.lit(b"")).withColumn("length", F.lit(0.0)).withColumn("inner", F.lit(0.0)).schema
    return with_row_id(some.mapInArrow(run, schema), "one-bit-index")


class _Queries:
    """A block's queries of one vector length, rotated and rounded to bit planes."""

    def __init__(self, rows: np.ndarray, x: np.ndarray, mean: np.ndarray):
        self.row, self.x = rows, x
        r = (x - mean) @ rotation(x.shape[1])
        self.length = np.sqrt((r * r).sum(axis=1))
        unit = r / np.where(self.length > 0, self.length, 1)[:, None]
        self.low = unit.min(axis=1)
        self.step = (unit.max(axis=1) - self.low) / (2 ** QUERY_BITS - 1)
        whole = np.rint((unit - self.low[:, None]) / np.where(self.step > 0, self.step, 1)[:, None]).astype(np.int64)
        self.planes = [_pack(whole >> j & 1) for j in range(QUERY_BITS)]
        self.sum = (whole * self.step[:, None] + self.low[:, None]).sum(axis=1)

    def bounds(self, s: slice, code: np.ndarray, length: np.ndarray, inner: np.ndarray):
        """Estimated squared distance and its greatest error, (queries, rows)."""
        d = self.x.shape[1]
        dot = np.zeros((len(self.length[s]), len(code)))
        for w in range(code.shape[1]):
            for j in range(QUERY_BITS):
                dot += np.bitwise_count(self.planes[j][s, w, None] & code[None, :, w]).astype(np.float64) * (1 << j)
        ones = np.bitwise_count(code).sum(axis=1)
        dot = dot * self.step[s, None] + self.low[s, None] * ones[None, :]
        signed = (2 * dot - self.sum[s, None]) / np.sqrt(d)       # inner product with the code's direction
        error = (CONFIDENCE * np.sqrt(np.maximum(1 - inner ** 2, 0) / max(d - 1, 1))[None, :] + self.step[s, None] / 2 * np.sqrt(d)) / inner[None, :]
        both = 2 * self.length[s, None] * length[None, :]
        near = self.length[s, None] ** 2 + length[None, :] ** 2 - both * signed / inner[None, :]
        return near, both * error + 1e-9


def search(index: DataFrame, queries: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` nearest rows of ``index`` (of ``build_index``) for each row of ``queries``, which are rows of
    the index: query_id, rank, vec_id, score (Euclidean distance)."""
    spark = index.sparkSession
    parts = []
    centre = means(index)
    for block in query_blocks(queries.select("row_id", "vec_id", "embedding"), query_block):
        groups = {}
        ids = dict(zip(block["row_id"].to_pylist(), block["vec_id"].to_pylist(), strict=True))
        for b in block.combine_chunks().to_batches():
            for rows, x in by_length(b, "embedding", np.float64):
                groups[x.shape[1]] = b.column("row_id").to_numpy()[rows], x, centre[x.shape[1]]
        sent = spark.sparkContext.broadcast((groups, ids))
        found = index.mapInArrow(_searcher(sent, k), "query_row bigint, query_id bigint, vec_id bigint, row_id bigint, score double")
        parts.append(ranked(found, ["score"], k))
    if not parts:
        none = spark.createDataFrame([], "query_row bigint, query_id bigint, vec_id bigint, row_id bigint, score double")
        parts = [ranked(none, ["score"], k)]
    if len(parts) > 1:
        parts = [stored(p, "neighbours") for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query_id", "rank", "vec_id", "score")


def _searcher(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, names = sent.value
        groups = {d: _Queries(*g) for d, g in given.items()}
        best = {d: Best(len(g.row), k) for d, g in groups.items()}
        for b in chunks(batches, ROWS_AT_ONCE):
            vec_id, row_id = b.column("vec_id").to_numpy(), b.column("row_id").to_numpy()
            codes = b.column("code").to_pylist()
            length, inner = b.column("length").to_numpy(), b.column("inner").to_numpy()
            for rows, x in by_length(b, "embedding", np.float64):
                g = groups.get(x.shape[1])
                if g is None:
                    continue
                code = np.frombuffer(b"".join(codes[i] for i in rows), np.uint64).reshape(len(rows), -1)
                for q0 in range(0, len(g.row), QUERIES_AT_ONCE):
                    near, error = g.bounds(slice(q0, q0 + QUERIES_AT_ONCE), code, length[rows], inner[rows])
                    for i in range(len(near)):
                        _measure(best[x.shape[1]], q0 + i, g, x, vec_id[rows], row_id[rows], near[i], error[i], k)
        for d, g in groups.items():
            for q, row in enumerate(g.row.tolist()):
                n = len(best[d].id[q])
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * n), pa.array([names[row]] * n), pa.array(best[d].id[q]), pa.array(best[d].row[q]), pa.array(best[d].cost[q])],
                        ["query_row", "query_id", "vec_id", "row_id", "score"])

    return run


def _measure(best: Best, q: int, g: _Queries, x: np.ndarray, vec_id, row_id, near: np.ndarray, error: np.ndarray, k: int) -> None:
    """Measure the rows that may be among the query's best."""
    others = row_id != g.row[q]
    low = near - error
    done = np.zeros(len(x), bool)

    def exact(at: np.ndarray) -> None:
        diff = x[at] - g.x[q]
        best.add(q, np.sqrt(np.add.accumulate(diff * diff, axis=1)[:, -1]), vec_id[at], row_id[at])
        done[at] = True

    if best.worst(q) is None:
        at = np.nonzero(others)[0]
        exact(at[np.argpartition(near[at], k)[:k]] if len(at) > k else at)
    limit = best.worst(q)
    if limit is not None:
        at = np.nonzero(others & ~done & (low <= limit * limit * (1 + 1e-12)))[0]
        if len(at):
            exact(at)


def op5_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    index = build_index(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(index, index.where(F.col("vec_id") % 100 == 0))


OP5_SQL = ENTRIES_SQL.format(component="x::DOUBLE") + """
w AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.r AS query_row, q.vec_id AS query_id, c.vec_id, c.r,
        sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
      FROM w q JOIN w c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score, vec_id, r)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 10
"""
