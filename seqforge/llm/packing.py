"""Packing documents into fixed-length sequences: cutting stock by column generation (operator 9).

1. Documents become pieces: full pieces of ``SEQUENCE`` ids and one remainder (a piece's place in its
   document follows from its length alone, so its checksum is made while encoding).
2. The pieces' lengths, rounded up to ``WIDTH`` ids, give a histogram of SEQUENCE / WIDTH classes.
3. On the histogram (the only thing the driver sees, and bounded): a linear program over patterns, where a
   pattern says how many pieces of each class share a sequence. Columns are generated: the program's dual
   prices go into a knapsack dynamic programme, whose best pattern enters the basis until none is worth
   more than one sequence. The solution is rounded down; what is left is packed largest first.
4. Patterns are laid out one after the other. In every class the pieces are ranked (in two levels, so a
   class with a third of all pieces spreads over many tasks); a rank belongs to one place of one pattern's
   copy, found by binary search. Offsets are running lengths within a sequence.

Defined results: null text counts as empty and gives one piece, the end id; null and repeated doc_ids each
keep their pieces; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqforge.llm.common import chunks, reach, small_batches, with_row_id
from seqforge.llm.tokens import encoder
from seqforge.operators.ordering import bucket_prefix

SEQUENCE, WIDTH, END_ID = 2048, 8, 1
BUCKETS = 1024
TOLERANCE = 1e-3
Pattern = tuple[tuple[int, int], ...]   # (class, pieces of it), largest class first


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, spaced: bool = True, with_ids: bool = False) -> DataFrame:
    """Pieces of the encoded documents: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids
    (little-endian unsigned 32-bit integers)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, spaced)
        for b in chunks(batches, 1024):
            out: list[tuple] = []
            for name, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text")), strict=True):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, sequence):
                    part = ids[4 * at:4 * (at + sequence)]
                    out.append((name, at, len(part) // 4, zlib.crc32(part), n, part if with_ids else None))
            cols = [*zip(*out, strict=True)] if out else [()] * 6
            kinds = [pa.int64()] * 5 + [pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)][:5 + with_ids], names[:5 + with_ids])

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids
    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, schema)


def _best_pattern(prices: np.ndarray, widths: np.ndarray, size: int) -> tuple[float, dict[int, int]]:
    """Most valuable pattern at these prices: unbounded knapsack, by dynamic programming over the size."""
    value, choice = np.zeros(size + 1), np.full(size + 1, -1)
    for s in range(1, size + 1):
        fit = widths <= s
        got = value[s - widths[fit]] + prices[fit]
        value[s] = value[s - 1]
        if len(got) and got.max() > value[s] + 1e-12:
            k = int(got.argmax())
            value[s], choice[s] = got[k], np.nonzero(fit)[0][k]
    pattern: dict[int, int] = {}
    s = size
    while s > 0:
        if choice[s] < 0:
            s -= 1
            continue
        k = int(choice[s])
        pattern[k] = pattern.get(k, 0) + 1
        s -= int(widths[k])
    return float(value[size]), pattern


def column_generation(demand: dict[int, int], size: int) -> list[tuple[float, Pattern]]:
    """Linear programme: least sequences so that patterns cover the ``demand`` (class -> pieces), classes being
    widths of at most ``size``. Returns how often each basic pattern is used."""
    classes = np.array(sorted(demand))
    m = len(classes)
    need = np.array([demand[c] for c in classes.tolist()], float)
    columns = np.diag(size // classes).astype(float)     # to begin with: sequences of one class
    inverse = np.diag(1 / np.diag(columns)) if m else columns
    for step in range(40 * m):       # the program ends long before; any basis on the way is a full solution
        x, prices = inverse @ need, inverse.sum(axis=0)
        worth, pattern = _best_pattern(prices, classes, size)
        least = max(x.sum() / max(worth, 1.0), classes @ need / size)    # dual bound; all widths end to end
        if worth <= 1 + 1e-9 or x.sum() <= (1 + TOLERANCE) * least:
            break
        column = np.zeros(m)
        for k, n in pattern.items():
            column[k] = n
        direction = inverse @ column
        up = direction > 1e-9
        if not up.any():
            break
        leave = int(np.where(up, x / np.where(up, direction, 1), np.inf).argmin())
        columns[:, leave] = column
        pivot = inverse[leave] / direction[leave]
        inverse = inverse - np.outer(direction, pivot)
        inverse[leave] = pivot
        if step % 512 == 511:    # against rounding: one Newton step towards the inverse
            inverse = 2 * inverse - np.einsum("ij,jk->ik", inverse, np.einsum("ij,jk->ik", columns, inverse))
    x = inverse @ need
    return [(float(x[p]), tuple((int(classes[k]), int(columns[k, p])) for k in range(m - 1, -1, -1) if columns[k, p])) for p in range(m)]


def plan(demand: dict[int, int], size: int) -> list[tuple[int, Pattern]]:
    """Copies of patterns that hold exactly the ``demand``."""
    left = dict(demand)
    out = []
    for used, pattern in column_generation(demand, size):
        copies = min([int(used + 1e-6), *(left[c] // n for c, n in pattern)])
        if copies > 0:
            out.append((copies, pattern))
            for c, n in pattern:
                left[c] -= copies * n
    # What rounding left: the largest that fits, again and again; equal fillings are made at once.
    while any(left.values()):
        room, pattern = size, []
        for c in sorted((c for c, n in left.items() if n), reverse=True):
            if n := min(room // c, left[c]):
                pattern.append((c, n))
                room -= c * n
        copies = min(left[c] // n for c, n in pattern)
        out.append((copies, tuple(pattern)))
        for c, n in pattern:
            left[c] -= copies * n
    return out


class Layout:
    """Where the r-th piece of a class goes."""

    def __init__(self, patterns: list[tuple[int, Pattern]]):
        self.at: dict[int, list[tuple[int, int, int, int]]] = {}
        rank: dict[int, int] = {}
        first = 0
        for copies, pattern in patterns:
            for place, (c, n) in enumerate(pattern):
                self.at.setdefault(c, []).append((rank.get(c, 0), first, n, place))
                rank[c] = rank.get(c, 0) + copies * n
            first += copies
        self.tables = {c: np.array(v, np.int64).T for c, v in self.at.items()}
        del self.at

    def places(self, classes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence, and place within it, of pieces."""
        sequence, place = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for c in np.unique(classes).tolist():
            rows = np.nonzero(classes == c)[0]
            begin, first, n, at = self.tables[c]
            k = np.searchsorted(begin, ranks[rows], "right") - 1
            index = ranks[rows] - begin[k]
            sequence[rows] = first[k] + index // n[k]
            place[rows] = at[k] * SEQUENCE + index % n[k]
        return sequence, place


def pack(parts: DataFrame, sequence: int = SEQUENCE, width: int = WIDTH) -> DataFrame:
    """``parts`` (any columns, among them ``length`` of 1 to ``sequence``) with sequence_id and offset. They
    are written to the shared folder first, with a row id."""
    reach(parts.sparkSession)
    rows = with_row_id(parts, "pieces").withColumn("_class", F.ceil(F.col("length") / width).cast("int"))
    demand = {r["_class"]: r["n"] for r in rows.groupBy("_class").agg(F.count("*").alias("n")).collect()}
    layout = Layout(plan(demand, sequence // width))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("row_id"), F.lit(BUCKETS)))
    ranked = bucket_prefix(rows, "_bucket", [F.col("row_id")], F.lit(1), ["_class"], "_rank").drop("_bucket")
    schema = ranked.withColumn("sequence_id", F.lit(0).cast("bigint")).withColumn("_place", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, place = layout.places(b.column("_class").to_numpy(), b.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(place)], [*b.schema.names, "sequence_id", "_place"])

    placed = ranked.mapInArrow(run, schema)
    before = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
            .select(*parts.columns, "sequence_id", "offset"))


def op9_pack(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))
