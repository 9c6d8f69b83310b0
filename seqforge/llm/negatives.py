"""Hard negatives by Four-Russians scoring (operator 13).

Vectors become integers, floor(256 * x) for each component. The index holds blocks of up to ``BLOCK`` rows in two's
complement bit planes: for every plane and every group of eight dimensions a byte per row. An anchor's table holds, for
every group, the sums of all 256 subsets of its eight components. A row's plane byte looks up what the plane's bits
contribute in that group; the planes' sums are shifted and added from the sign plane down. Every score is a full exact one.

Anchors come in blocks of about ``ANCHORS``, index blocks in parts. Each (part, anchor block) is a cell; a task
takes the cells dealt to it one after the other: first the cell's anchors, whose tables it builds, then the index
blocks, one at a time, with the best rows so far. There are so many parts that all cores have cells, however few
the anchor blocks; once these alone are enough, there is a single part and the anchors travel once. The first pass
finds each anchor's positives, the second the negatives in each positive's band of scores; what the cells
found is ranked per anchor, or per anchor and positive.

Defined results: rows with a null vec_id, a null label, or a vector that is null, empty or holds a null or non-finite component take
no part; zero vectors do; vectors of different lengths are never compared; each repeated row counts as a row of its
own (an anchor leaves out its own row only); ties go to the smaller vec_id; a score beyond 64 bits counts as the
nearest 64-bit number; an anchor without another row of its label has no positive, a positive without a row
in its band (as with a negative score) no negative; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqforge.llm.common import chunks, stored, with_row_id
from seqforge.llm.topk import LONG, quantised
from seqforge.llm.vectors import ENTRIES_SQL, Best, by_length, ranked, usable

GROUP = 8                     # dimensions of a table
BLOCK, ANCHORS = 2048, 512    # rows of an index block, about so many anchors of an anchor block
AT_ONCE = 64                  # anchors scored side by side
CELLS_A_CORE, MOST_TASKS = 3, 100_000
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95            # a negative's score, in hundredths of its positive's


# ---- index -----------------------------------------------------------------------------------------

def bit_planes(values: np.ndarray) -> np.ndarray:
    """(plane, group, row) bytes of integers (row, dimension): two's complement, lowest plane first."""
    most = max((abs(int(v) if v >= 0 else int(v) + 1) for v in (values.min(initial=0), values.max(initial=0))), default=0)
    bits = most.bit_length() + 1
    pad = -values.shape[1] % GROUP
    wide = np.concatenate([values, np.zeros((len(values), pad), values.dtype)], axis=1)
    planes = [np.packbits(((wide >> j) & 1).astype(np.uint8), axis=1, bitorder="little").T for j in range(bits)]
    return np.ascontiguousarray(np.stack(planes))


def build_index(vectors: DataFrame) -> DataFrame:
    """Blocks of the rows (row_id, vec_id, label, embedding) of one vector length each, written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, BLOCK):
            labels, ids, row_ids = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "vec_id", "row_id"))
            for rows, x in by_length(b, "embedding", np.float64):
                planes = bit_planes(quantised(x))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(row_ids[rows[0]])], pa.int64()), pa.array([x.shape[1]], pa.int32()), pa.array([len(planes)], pa.int32()),
                     *[pa.array([v[rows].tobytes()], pa.binary()) for v in (ids, row_ids, labels)], pa.array([planes.tobytes()], pa.binary())],
                    ["block", "d", "bits", "vec_ids", "row_ids", "labels", "planes"])

    made = vectors.select("row_id", "vec_id", "label", "embedding").mapInArrow(
        run, "block bigint, d int, bits int, vec_ids binary, row_ids binary, labels binary, planes binary")
    return stored(made, "bit-planes")


# ---- scoring ---------------------------------------------------------------------------------------

def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(group, subset, anchor): the sums of all subsets of eight components, by doubling."""
    pad = -anchors.shape[1] % GROUP
    wide = np.concatenate([anchors, np.zeros((len(anchors), pad), anchors.dtype)], axis=1)
    parts = wide.reshape(len(anchors), -1, GROUP).transpose(1, 2, 0)      # (group, dimension, anchor)
    table = np.zeros((parts.shape[0], 1, len(anchors)), anchors.dtype)
    for k in range(GROUP):
        table = np.concatenate([table, table + parts[:, k:k + 1]], axis=1)
    return table


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Exact inner products (row, anchor) from looked-up sums, shifted and added from the sign plane down."""
    total = None
    for j in range(len(planes) - 1, -1, -1):
        plane = np.take(tables[0], planes[j, 0], axis=0)
        for g in range(1, len(tables)):
            plane += np.take(tables[g], planes[j, g], axis=0)
        if total is None:
            total = -plane                   # the sign plane
        else:
            total += total
            total += plane
    return total


class Cell:
    """An anchor block of one vector length in a task: its tables, and the best rows so far."""

    def __init__(self, rows: list[dict], slots: int, k: int):
        self.rows, self.slots = rows, slots
        self.q = quantised(np.array([r["embedding"] for r in rows], np.float64))
        self.label, self.row_id = np.array([r["label"] for r in rows]), np.array([r["row_id"] for r in rows])
        self.most = int(np.abs(self.q).max(initial=0))
        self.best = Best(len(rows) * slots, k)
        self.tables: dict[tuple[int, type], np.ndarray] = {}

    def kind(self, bits: int, d: int):
        """Integers wide enough for every partial sum against so many planes."""
        need = (max(self.most, 1) * d).bit_length() + bits + 1
        return np.int32 if need < 31 else np.int64 if need < 63 else object

    def scored(self, block: dict) -> Iterator[tuple[int, np.ndarray]]:
        """(first anchor, scores (row, anchor)) of the block, some anchors at a time."""
        kind = self.kind(block["bits"], block["d"])
        for i in range(0, len(self.rows), AT_ONCE):
            if (i, kind) not in self.tables:
                self.tables[i, kind] = subset_sums(self.q[i:i + AT_ONCE].astype(kind))
            s = scores(self.tables[i, kind], block["planes"])
            if kind is object:
                s = np.clip(s, LONG[0] + 1, LONG[1])
            yield i, s.astype(np.int64)

    def positives(self, block: dict) -> None:
        """The best rows of the anchor's label."""
        for i, s in self.scored(block):
            same = (block["labels"][:, None] == self.label[i:i + AT_ONCE]) & (block["row_ids"][:, None] != self.row_id[i:i + AT_ONCE])
            self._add(i, s, same, np.full(s.shape[1], LONG[0]), np.full(s.shape[1], LONG[1]), 0)

    def negatives(self, block: dict) -> None:
        """For each positive, the best rows of other labels in its band."""
        for i, s in self.scored(block):
            other = block["labels"][:, None] != self.label[i:i + AT_ONCE]
            each = [r["scores"] for r in self.rows[i:i + AT_ONCE]]
            for slot in range(self.slots):
                band = [band_of(p[slot]) if slot < len(p) else (1, 0) for p in each]
                self._add(i, s, other, np.array([b[0] for b in band]), np.array([b[1] for b in band]), slot)

    def _add(self, i: int, s: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, slot: int) -> None:
        places = [(i + a) * self.slots + slot for a in range(s.shape[1])]
        worst = np.array([-int(w) if (w := self.best.worst(q)) is not None else LONG[0] for q in places])
        row, anchor = np.nonzero(allowed & (s >= np.maximum(low, worst)) & (s <= high))
        order = np.argsort(anchor, kind="stable")
        row, anchor = row[order], anchor[order]
        cut = np.searchsorted(anchor, np.arange(s.shape[1] + 1))
        for a in np.unique(anchor).tolist():
            at = row[cut[a]:cut[a + 1]]
            self.best.add(places[a], -s[at, a], self.ids[at], self.row_ids[at])

    def see(self, block: dict, mode: str) -> None:
        self.ids, self.row_ids = block["vec_ids"], block["row_ids"]
        getattr(self, mode)(block)

    def found(self) -> Iterator[tuple]:
        """(query_row, slot, vec_id, row_id, score)."""
        for q in range(len(self.rows) * self.slots):
            for cost, i, r in zip(self.best.cost[q].tolist(), self.best.id[q].tolist(), self.best.row[q].tolist(), strict=True):
                yield int(self.row_id[q // self.slots]), q % self.slots, i, r, -int(cost)


def band_of(score: int) -> tuple[int, int]:
    """Least and greatest score of a negative of a positive with this one (exact integers)."""
    return -(-LOW * score // 100), HIGH * score // 100


def cells(index: DataFrame, anchors: DataFrame, mode: str, slots: int, k: int, parts: int, blocks: int) -> DataFrame:
    """What every cell found: query_row, slot, vec_id, row_id, score."""
    anchor = F.struct("row_id", "label", "embedding", *(["scores"] if mode == "negatives" else []))
    rows = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
                          F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int").alias("anchor_block"), anchor.alias("anchor"))
    held = index.select(F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"),
                        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("anchor_block"),
                        F.struct("d", "bits", "vec_ids", "row_ids", "labels", "planes").alias("block"))
    both = (rows.unionByName(held, allowMissingColumns=True)
            .repartition(min(parts * blocks, MOST_TASKS), "part", "anchor_block")
            .sortWithinPartitions("part", "anchor_block", F.col("block").isNotNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, open_ = None, [], {}

        def close() -> Iterator[pa.RecordBatch]:
            for cell in open_.values():
                cols = [*zip(*cell.found(), strict=True)] or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), *[pa.int64()] * 3], strict=True)],
                                                 ["query_row", "slot", "vec_id", "row_id", "score"])

        for b in chunks(batches, 16):
            for place, one, r in zip(zip(b.column("part").to_pylist(), b.column("anchor_block").to_pylist(), strict=True),
                                     b.column("anchor").to_pylist(), b.column("block").to_pylist(), strict=True):
                if place != now:
                    yield from close()
                    now, waiting, open_ = place, [], {}
                if r is None:
                    waiting.append(one)
                    continue
                if waiting:                       # the cell's anchors are complete
                    for d in {len(a["embedding"]) for a in waiting}:
                        open_[d] = Cell([a for a in waiting if len(a["embedding"]) == d], slots, k)
                    waiting = []
                if r["d"] in open_:
                    n = len(r["vec_ids"]) // 8
                    open_[r["d"]].see({"d": r["d"], "bits": r["bits"], "planes": np.frombuffer(r["planes"], np.uint8).reshape(r["bits"], -1, n),
                                       **{c: np.frombuffer(r[c], np.int64) for c in ("vec_ids", "row_ids", "labels")}}, mode)
        yield from close()

    return both.mapInArrow(run, "query_row bigint, slot int, vec_id bigint, row_id bigint, score bigint")


def mine(vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """Hard negatives of the ``anchors``, rows of ``vectors`` (row_id, vec_id, label, embedding; written, with unique row_id): anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score."""
    index = build_index(vectors)
    blocks = max(-(-anchors.count() // ANCHORS), 1)
    parts = max(min(index.count(), -(-CELLS_A_CORE * index.sparkSession.sparkContext.defaultParallelism // blocks)), 1)
    found = cells(index, anchors, "positives", 1, POSITIVES, parts, blocks)
    best = ranked(found, [F.col("score").desc()], POSITIVES)
    per_anchor = best.groupBy("query_row").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "row_id", "score"))).alias("p"))
    told = stored(anchors.join(per_anchor, anchors["row_id"] == per_anchor["query_row"])
                  .select("row_id", F.col("vec_id").alias("anchor_id"), "label", "embedding", F.col("p.vec_id").alias("positive_ids"), F.col("p.score").alias("scores")), "positives")
    found = cells(index, told, "negatives", POSITIVES, NEGATIVES, parts, blocks)
    w = Window.partitionBy("query_row", "slot").orderBy(F.col("score").desc(), "vec_id", "row_id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= NEGATIVES)
    names = told.select(F.col("row_id").alias("query_row"), "anchor_id", "positive_ids", "scores")
    return best.join(names, "query_row").select(
        "anchor_id", F.element_at("positive_ids", F.col("slot") + 1).alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.element_at("scores", F.col("slot") + 1).alias("positive_score"), F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"), "embedding").where("label IS NOT NULL")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    vectors = with_row_id(rows.withColumn("label", label), "labelled-vectors")
    return mine(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP13_SQL = ENTRIES_SQL.replace("FROM embeddings", ", CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings").replace(
    "WHERE", "WHERE label IS NOT NULL AND").format(component="floor(256 * x::DOUBLE)") + f"""
s AS (SELECT a.r AS anchor_row, a.vec_id AS anchor_id, c.vec_id, c.r, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score
      FROM v a JOIN v c ON a.r <> c.r AND len(a.e) = len(c.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, vec_id, r) AS k FROM s WHERE same) WHERE k <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_row, p.k ORDER BY s.score DESC, s.vec_id, s.r)::INTEGER AS rank
      FROM p JOIN s ON s.anchor_row = p.anchor_row AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
