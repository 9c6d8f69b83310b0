"""Exact top-k inner products with a bit-sliced index (operator 8).

Vectors become integers, floor(256 * x) for each component. The index holds blocks of up to ``BLOCK`` rows.
Each component is an attribute, shifted to begin at 0 in its block and cut into slices: slice j is a bitmap
over the block's rows of bit j. The lowest slices are left out, so that ``SLICES`` remain.

A query's score is a sum of attributes times whole weights. For each bit of a weight the attribute's slices
are added, shifted, into the sum's slices by bitmap full adders (for a negative weight the complements of
the slices, a constant makes up for it); many queries go through the adders side by side, each with its
own masks. From the most significant slice of the sum downward the bitmaps are narrowed to the k best rows.
Because low slices were left out, a row's true score lies in a known interval above its sum: all rows whose
interval reaches the k-th best lower end are the boundary, and those are resolved exactly on the integers.

Queries come in blocks of about ``QUERY_BLOCK`` rows sent to every task.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, neither
do rows with a null vec_id; zero vectors take part; vectors of different lengths are never compared; each
repeated row counts as a row of its own (a query leaves out its own row only); ties go to the smaller
vec_id; integers of 2**20 or more are multiplied in unlimited precision, and a score beyond 64 bits is
given as the nearest 64-bit number; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqforge.llm.common import chunks, stored, with_row_id
from seqforge.llm.vectors import ENTRIES_SQL, Best, by_length, query_blocks, ranked, usable

SCALE = 256
BLOCK = 8192
SLICES = 6
QUERY_BLOCK = 2048
QUERIES_AT_ONCE = 64
WIDE = 1 << 20      # from here on integers are multiplied in unlimited precision
LONG = (-(1 << 63), (1 << 63) - 1)
Words = np.ndarray


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 * x), as 64-bit integers or, where they are too large for that, Python integers."""
    y = np.floor(SCALE * x)
    if np.abs(y).max(initial=0) < 1 << 62:
        return y.astype(np.int64)
    return np.array([[int(v) for v in row] for row in y], object).reshape(y.shape)


def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Bitmaps (attribute, slice, word) of the upper slices, least significant first; the attributes' least
    values; the number of slices left out."""
    low = values.min(axis=0)
    shifted = values - low
    bits = max(int(shifted.max()).bit_length(), 1)
    out = max(bits - SLICES, 0)
    pad = -len(values) % 64
    shifted = np.pad(shifted, ((0, pad), (0, 0)))
    maps = [np.packbits((shifted >> j & 1).astype(np.uint8).T.copy(), axis=1, bitorder="little").view(np.uint64) for j in range(out, bits)]
    return np.stack(maps, axis=1), low, out


def build_index(vectors: DataFrame) -> DataFrame:
    """The index: a row per block (binary arrays), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, BLOCK):
            vec_id, row_id = b.column("vec_id").to_numpy(), b.column("row_id").to_numpy()
            for rows, x in by_length(b, "embedding", np.float64):
                big = (np.abs(x) >= WIDE / SCALE).any(axis=1)
                for wide in (False, True):
                    at = np.nonzero(big == wide)[0]
                    if not len(at):
                        continue
                    if wide:   # kept as they are, for unlimited precision
                        maps, low, out, values = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, x[at]
                    else:
                        values = quantised(x[at])
                        maps, low, out = slices_of(values)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in ((x.shape[1], pa.int32()), (wide, pa.bool_()), (out, pa.int32()), (vec_id[rows[at]].tobytes(), pa.binary()),
                         (row_id[rows[at]].tobytes(), pa.binary()), (values.tobytes(), pa.binary()), (low.tobytes(), pa.binary()), (maps.tobytes(), pa.binary()))],
                        ["d", "wide", "left_out", "vec_ids", "row_ids", "integers", "low", "maps"])

    return stored(vectors.select("vec_id", "row_id", "embedding").mapInArrow(
        run, "d int, wide boolean, left_out int, vec_ids binary, row_ids binary, integers binary, low binary, maps binary"), "bit-sliced-index")


def add_slices(inputs: Iterator[tuple[int, Words]]) -> list[Words]:
    """Sum of bitmaps, each of a place value: the slices of the sum, least significant first. Three bitmaps
    of a place make a full adder's sum and carry."""
    places: list[list[Words]] = []

    def put(place: int, bitmap: Words) -> None:
        while True:
            while len(places) <= place:
                places.append([])
            held = places[place]
            if len(held) < 2:
                held.append(bitmap)
                return
            a, b = held
            half = a ^ b
            places[place] = [half ^ bitmap]
            bitmap = (a & b) | (half & bitmap)
            place += 1

    for place, bitmap in inputs:
        put(place, bitmap)
    out = []
    place = 0
    while place < len(places):
        if len(places[place]) == 2:
            a, b = places[place]
            places[place] = [a ^ b]
            put(place + 1, a & b)
        out.append(places[place][0] if places[place] else None)
        place += 1
    shape = next((s for s in out if s is not None), None)
    return [np.zeros_like(shape) if s is None else s for s in out] if shape is not None else []


def _mask(bits: np.ndarray) -> np.ndarray:
    """(queries, 1): all ones where the bit is set."""
    return (np.uint64(0) - (bits.astype(np.uint64) & np.uint64(1)))[:, None]


def top(total: list[Words], valid: Words, k: np.ndarray) -> list[int]:
    """For each query the ``k``-th largest sum among its valid rows, found from the most significant slice
    downward (-1 if ``k`` is 0)."""
    sure, equal = np.zeros_like(valid), valid.copy()
    kth = np.zeros(len(valid), object)
    for place in range(len(total) - 1, -1, -1):
        with_bit = equal & total[place]
        enough = np.bitwise_count(sure | with_bit).sum(axis=1) >= k
        m = _mask(enough)
        sure |= with_bit & ~m
        equal = np.where(m != 0, with_bit, equal & ~total[place])
        kth = kth + enough.astype(object) * (1 << place)
    return [int(v) if n else -1 for v, n in zip(kth, k, strict=True)]


def at_least(total: list[Words], valid: Words, least: list[int]) -> Words:
    """Bitmap of each query's valid rows whose sum is ``least`` or more."""
    above, equal = np.zeros_like(valid), valid.copy()
    least = [max(v, 0) for v in least]
    beyond = np.array([v >> len(total) > 0 for v in least])
    for place in range(len(total) - 1, -1, -1):
        m = _mask(np.array([v >> place & 1 for v in least]))
        above |= equal & total[place] & ~m
        equal &= ~(total[place] ^ m)
    return np.where(beyond[:, None], np.uint64(0), above | equal)


def search_block(q: np.ndarray, q_rows: np.ndarray, block: dict, best: Best, first: int, k: int) -> None:
    """Queries ``q`` (integers) against a block; results go to ``best`` at ``first`` and on."""
    values, maps, low, out = block["values"], block["maps"], block["low"], block["left_out"]
    n, width = len(values), maps.shape[2]
    weight, negative = np.abs(q), q < 0
    bits = int(weight.max(initial=0)).bit_length()

    def inputs():
        for d in range(q.shape[1]):
            if not weight[:, d].any():
                continue
            flip = _mask(negative[:, d])
            turned = [maps[d, s][None, :] ^ flip for s in range(maps.shape[1])]
            for j in range(bits):
                set_bit = weight[:, d] >> j & 1
                if set_bit.any():
                    m = _mask(set_bit)
                    for s, bitmap in enumerate(turned):
                        yield j + s, bitmap & m

    total = add_slices(inputs()) or [np.zeros((len(q), width), np.uint64)]
    rows = np.zeros(width * 64, np.uint8)
    rows[:n] = 1
    valid = np.repeat(np.packbits(rows, bitorder="little").view(np.uint64)[None, :], len(q), axis=0)
    here = block["row_of"]
    for i, row in enumerate(q_rows.tolist()):
        if (at := here.get(row)) is not None:
            valid[i, at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
    count = np.bitwise_count(valid).sum(axis=1)
    kth = top(total, valid, np.minimum(count, k))
    # score = 2**out * sum + rest + constant, with 0 <= rest <= slack
    slack = weight.sum(axis=1) * ((1 << out) - 1)
    most = (1 << (out + maps.shape[1])) - 1
    constant = np.where(negative, -weight * (most + low), weight * low).sum(axis=1)
    least = []
    for i in range(len(q)):
        reach = kth[i] - (int(slack[i]) >> out)
        if (w := best.worst(first + i)) is not None:   # not below what other blocks have given
            reach = max(reach, -((int(w) + int(constant[i]) + int(slack[i])) >> out))   # w is minus the score
        least.append(reach)
    hits = at_least(total, valid, least)
    qi, at = np.nonzero(np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little"))
    exact = np.einsum("ij,ij->i", values[at], q[qi])
    cut = np.searchsorted(qi, np.arange(len(q) + 1))
    for i in range(len(q)):
        s = slice(cut[i], cut[i + 1])
        if s.stop > s.start:
            best.add(first + i, -exact[s], block["vec_ids"][at[s]], block["row_ids"][at[s]])


def _wide(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, block: dict, best: Best, first: int) -> None:
    """Scores in unlimited precision: integers of any size, on either side."""
    for i in range(len(q)):
        at = np.nonzero(block["row_ids"] != q_rows[i])[0]
        score = [min(max(sum(int(a) * int(b) for a, b in zip(x[r], q[i], strict=True)), LONG[0] + 1), LONG[1]) for r in at]
        best.add(first + i, -np.array(score, np.int64), block["vec_ids"][at], block["row_ids"][at])


def search(index: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` highest-scoring rows of ``index`` for each row of ``queries`` (row_id, vec_id, embedding):
    query_id, rank, vec_id, score."""
    spark = index.sparkSession
    schema = "query_row bigint, query_id bigint, vec_id bigint, row_id bigint, score bigint"
    parts = []
    for block in query_blocks(queries.select("row_id", "vec_id", "embedding"), query_block):
        groups = {}
        for b in block.combine_chunks().to_batches():
            for rows, x in by_length(b, "embedding", np.float64):
                q = quantised(x)
                big = (np.abs(x) >= WIDE / SCALE).any(axis=1)
                for wide in (False, True):
                    at = np.nonzero(big == wide)[0]
                    if len(at):
                        kind = object if wide else np.int64
                        groups[x.shape[1], wide] = (q[at].astype(kind), b.column("row_id").to_numpy()[rows[at]], b.column("vec_id").to_numpy()[rows[at]])
        found = index.mapInArrow(_searcher(spark.sparkContext.broadcast(groups), k), schema)
        parts.append(ranked(found, [F.col("score").desc()], k))
    if not parts:
        parts = [ranked(spark.createDataFrame([], schema), [F.col("score").desc()], k)]
    if len(parts) > 1:
        parts = [stored(p, "top") for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query_id", "rank", "vec_id", "score")


def _searcher(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = sent.value
        best = {g: Best(len(rows), k) for g, (_, rows, _) in groups.items()}
        for b in chunks(batches, 1):
            r = {c: b.column(c)[0].as_py() for c in b.schema.names}
            d = r["d"]
            block = {"vec_ids": np.frombuffer(r["vec_ids"], np.int64), "row_ids": np.frombuffer(r["row_ids"], np.int64), "left_out": r["left_out"]}
            if r["wide"]:
                values = quantised(np.frombuffer(r["integers"]).reshape(-1, d))
            else:
                values = np.frombuffer(r["integers"], np.int64).reshape(-1, d)
                width = -(-len(values) // 64)
                block |= {"values": values, "low": np.frombuffer(r["low"], np.int64), "maps": np.frombuffer(r["maps"], np.uint64).reshape(d, -1, width),
                          "row_of": {v: i for i, v in enumerate(block["row_ids"].tolist())}}
            for wide_query in (False, True):
                if (g := (d, wide_query)) not in groups:
                    continue
                q, q_rows, _ = groups[g]
                if wide_query or r["wide"]:
                    _wide(q, q_rows, values, block, best[g], 0)
                    continue
                for i in range(0, len(q), QUERIES_AT_ONCE):
                    s = slice(i, i + QUERIES_AT_ONCE)
                    search_block(q[s], q_rows[s], block, best[g], i, k)
        for g, (_, q_rows, q_ids) in groups.items():
            for i, row in enumerate(q_rows.tolist()):
                if n := len(best[g].id[i]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * n), pa.array([int(q_ids[i])] * n), pa.array(best[g].id[i]), pa.array(best[g].row[i]),
                         pa.array((-best[g].cost[i]).astype(np.int64))], ["query_row", "query_id", "vec_id", "row_id", "score"])

    return run


def op8_top_inner_products(spark, sf_dir: str) -> DataFrame:
    vectors = with_row_id(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "embedding"), "vectors")
    return search(build_index(vectors), vectors.where(F.col("vec_id") % 50 == 0))


OP8_SQL = ENTRIES_SQL.format(component="floor(256 * x::DOUBLE)") + """
s AS (SELECT q.r AS query_row, q.vec_id AS query_id, c.vec_id, c.r, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, r)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""
